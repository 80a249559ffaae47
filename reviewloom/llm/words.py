"""Hashes of words and of runs of words, vectorised over the bytes of many texts.

Words are runs of other bytes than ASCII white space. Hashes are 64-bit: polynomial sums
of scrambled values, so that the hash of any run is the difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes that are hashed with one array of powers; a longer word has one of its own.
SPAN = 1 << 19
#: Bytes of texts that are worked on together.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the splitmix64 finalizer)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is no digit and no letter.
SYMBOLS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _powers(log: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    n, inverse = 1 << log, pow(step, -1, 1 << 64)
    out = []
    for base in (step, inverse):
        values = np.full(n, base, dtype=U64)
        values[0] = 1
        out.append(np.multiply.accumulate(values))
    return out[0], out[1]


def powers(n: int, step: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(12, int(n).bit_length()), step)


class Chunk:
    """Words of some texts: bounds of each word in ``data``, hashes, first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False, gaps: np.ndarray = _GAP):
        self.data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        gap = np.concatenate(([True], gaps[self.data], [True]))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = self._bounds(edges[::2], edges[1::2])
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.base = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.base)
        self.hashes = self._hash()

    def _bounds(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return starts, ends

    def _hash(self) -> np.ndarray:
        starts, ends = self.starts, self.ends
        out, i = np.empty(len(starts), dtype=U64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            power, inverse = powers(b - a + 1)
            sums = np.zeros(b - a + 1, dtype=U64)
            np.cumsum(_BYTES[self.data[a:b]] * power[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(_BASE))
            i = j
        return out

    def text(self, word: int, stop: int) -> bytes:
        """Words from one to another, joined by one space."""
        data = self.data
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.starts[word:stop], self.ends[word:stop]))


def chunks(
    texts: list, lower: bool = False, gaps: np.ndarray = _GAP, kind: type[Chunk] = Chunk
) -> Iterator[tuple[int, int, Chunk]]:
    """Runs of texts of about ``CHUNK`` bytes: (from, to, their words). None is empty.

    ``gaps`` marks the bytes between words; ``kind`` may cut words further.
    """
    held, size, start = [], 0, 0
    for i, text in enumerate(texts):
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > CHUNK:
            yield start, i, kind(held, lower, gaps)
            held, size, start = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield start, len(texts), kind(held, lower, gaps)


class Runs:
    """Hashes of runs of consecutive words (or other 64-bit values)."""

    def __init__(self, values: np.ndarray, step: int = _STEP):
        self.power, self.inverse = powers(len(values) + 1, step)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(mix(values) * self.power[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        start, stop = np.asarray(start), np.asarray(stop)
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(U64) * U64(_BASE))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, span = np.arange(len(values), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
