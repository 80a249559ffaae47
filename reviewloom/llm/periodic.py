"""Runs: stretches of words that repeat with a period, found by block convolution.

A run has a smallest period q, at least ``EXPONENT`` whole periods and ``LEAST`` words, and
no neighbouring word extends it. For each scale B = 1, 2, 4, ... the words are cut into
blocks of B. A run with B <= q < 2B holds a whole block in its first 2B words, and that block
occurs again exactly q words on. So:

1. Words become numbers modulo a prime. The sum of squared differences between a block and
   each place of the window after it is two sums of squares and a convolution, which a
   number-theoretic transform gives exactly. Zeros are where the block occurs again; a sum
   that is a multiple of the prime by chance is sorted out by step 3.
2. Blocks that cannot be in a run of this scale are left out ahead of the transform: those
   with a word that does not come again within 2B words, and those whose window lies in a
   run that is known already, as all their distances are multiples of its period.
3. Distances are seeds: from a block and its next occurrence the stretch of equal words is
   extended to both sides. Long enough stretches are runs; those whose period is a multiple
   of a smaller one are that run again.

Texts are worked on together, with a number of its own between any two, so that the many
short ones cost few calls. A document is one row and its work n log(n)^2 for n words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared

U64 = np.uint64
#: A prime with roots of unity for all sizes in use, and a generator of its group.
PRIME, GENERATOR = 998_244_353, 3
#: Largest transform: 2**23 divides the prime less one.
LARGEST = 1 << 23
#: Shortest run in words and in periods.
LEAST, EXPONENT = 6, 4
#: Bytes of texts that are worked on together, and numbers in the transforms of one step.
CHUNK, STEP = 1 << 20, 1 << 20

FIELDS = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
Run = tuple[int, int, int]  # start, length, period


def _roots(n: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order n, the first half."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(max(1, n // 2), dtype=U64)
    size = 1
    while size < len(out):
        out[size : 2 * size] = out[:size] * U64(pow(root, size, PRIME)) % U64(PRIME)
        size *= 2
    return out


def ntt(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Transform of each row (a power of two long) modulo the prime; the inverse unscaled.

    Forward leaves bit-reversed order and inverse takes it, so no row is reordered.
    """
    rows = rows.copy()
    m, n = rows.shape
    roots = _roots(n, inverse)
    half = n // 2 if not inverse else 1
    while 1 <= half < n:
        pairs = rows.reshape(m, n // (2 * half), 2, half)
        a, b = pairs[:, :, 0, :], pairs[:, :, 1, :]
        w = roots[:: n // (2 * half)][:half]
        if inverse:
            t = b * w % U64(PRIME)
            low, high = a + t, a + (U64(PRIME) - t)
        else:
            low, high = a + b, (a + (U64(PRIME) - b)) % U64(PRIME) * w
        pairs[:, :, 0, :], pairs[:, :, 1, :] = low % U64(PRIME), high % U64(PRIME)
        half = half * 2 if inverse else half // 2
    return rows


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of blocks (m, B) with each place of
    windows (m, 2B - 1): (m, B)."""
    m, size = blocks.shape
    n = 1 << (3 * size - 2).bit_length()
    p = U64(PRIME)
    left, right = np.zeros((m, n), dtype=U64), np.zeros((m, n), dtype=U64)
    left[:, :size] = blocks[:, ::-1]
    right[:, : 2 * size - 1] = windows
    product = ntt(ntt(left) * ntt(right) % p, inverse=True)[:, size - 1 : 2 * size - 1]
    cross = product * U64(pow(n, -1, PRIME)) % p
    squares = np.zeros((m, 2 * size), dtype=U64)
    np.cumsum(windows * windows % p, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % p).sum(axis=1, dtype=U64) % p
    held = (squares[:, size:] - squares[:, :size]) % p
    return (held + own[:, None] + U64(2) * (p - cross)) % p


def _scrambled(ids: np.ndarray) -> np.ndarray:
    """Numbers below the prime for word ids, spread so that chance sums are rare."""
    x = ids.astype(U64) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return (x ^ (x >> U64(32))) % U64(PRIME)


def _again(ids: np.ndarray) -> np.ndarray:
    """Words up to the next occurrence of each word; a large number where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), np.iinfo(np.int64).max, dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _stretch(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """First and last + 1 of the places around ``at`` whose word is the same ``d`` words on."""
    end, step = at, 64
    while True:
        a = ids[end : end + step]
        b = ids[end + d : end + d + step]
        odd = np.flatnonzero(a[: len(b)] != b)
        if len(odd):
            end += int(odd[0])
            break
        end += len(b)
        if len(b) < step:
            break
        step *= 2
    start, step = at, 64
    while start:
        low = max(0, start - step)
        odd = np.flatnonzero(ids[low:start] != ids[low + d : start + d])
        if len(odd):
            start = low + int(odd[-1]) + 1
            break
        start, step = low, 2 * step
    return start, end


def find_runs(ids: np.ndarray, longest: int | None = None) -> list[Run]:
    """All runs of a sequence of word ids, by start and period.

    ``longest`` is the length of the longest text in it, if it holds several.
    """
    n = len(ids)
    longest = longest or n
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    again, values = _again(ids), _scrambled(ids)
    until = np.zeros(n, dtype=np.int64)  # end of the known run that reaches furthest, for each word
    least, size = again, 1  # largest distance to a next occurrence in each block
    while size * EXPONENT <= longest:
        if 4 * size > LARGEST:
            raise ValueError(f"texts of over {EXPONENT * LARGEST // 4} words need a larger prime")
        blocks = np.flatnonzero(least < 2 * size)
        at = blocks * size
        # the window ends where the last place of the block does
        open_ = (at + 3 * size - 1 > until[at]) & (at + 2 * size <= n)
        seeds = _seeds(ids, values, at[open_], size)
        for d in sorted(set(seeds[:, 1].tolist())):
            last = -1
            for i in seeds[seeds[:, 1] == d, 0].tolist():
                if i < last:
                    continue
                start, last = _stretch(ids, i, d)
                end = last + d
                if end - start < max(LEAST, EXPONENT * d) or (start, end) in found:
                    continue
                found[start, end] = d
                until[start:end] = np.maximum(until[start:end], end)
        half = len(least) // 2
        least = np.maximum(least[: 2 * half : 2], least[1 : 2 * half : 2])
        size *= 2
    return sorted((start, end - start, d) for (start, end), d in found.items())


def _seeds(ids: np.ndarray, values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rows (place of a block, distance of an occurrence), distances from size to 2 size - 1."""
    out, most = [np.zeros((0, 2), dtype=np.int64)], max(1, STEP // (4 * size))
    # places beyond the end hold what no block ends with
    padded = np.concatenate((values, np.zeros(2 * size, dtype=U64)))
    for i in range(0, len(at), most):
        start = at[i : i + most, None]
        zero = mismatches(padded[start + np.arange(size)], padded[start + np.arange(size, 3 * size - 1)]) == 0
        block, shift = np.nonzero(zero)
        out.append(np.column_stack((at[i : i + most][block], shift + size)))
    seeds = np.concatenate(out)
    return seeds[_promising(ids, seeds[:, 0], seeds[:, 1], size)]


def _promising(ids: np.ndarray, at: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Seeds that may be the first block of a run: equal words at some of the places, the
    first and last included, that such a run has after its first block's start."""
    ok = np.ones(len(at), dtype=bool)
    for part in (0, 1, 2, 3, 5, 7, 8):
        place = at + ((EXPONENT - 1) * d - size) * part // 8
        inside = place + d < len(ids)
        place = np.where(inside, place, 0)
        ok &= inside & (ids[place] == ids[np.where(inside, place + d, 0)])
    return ok


def word_ids(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of several texts, with a number of its own after each text, and
    where each text starts."""
    number = {word: i for i, word in enumerate(set().union(*lists))} if lists else {}
    starts = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(words) + 1 for words in lists], out=starts[1:])
    ids = np.empty(int(starts[-1]), dtype=np.int64)
    for k, words in enumerate(lists):
        a, b = int(starts[k]), int(starts[k + 1])
        ids[a : b - 1] = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
        ids[b - 1] = len(number) + k
    return ids, starts


def described(words: list[bytes], runs: list[Run]) -> tuple:
    """A row of ``FIELDS`` for one text. All of a run but its first period is dropped."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    if best is None:
        kept, main = words, (None, None, None, None)
    else:
        gone = np.zeros(len(words), dtype=bool)
        for s, n, q in runs:
            gone[s + q : s + n] = True
        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
        main = (*best, 1000 * best[1] // best[2])
    return (
        len(runs),
        *main,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def runs(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Rows (key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    One row per text: the number of runs, the longest one (ties: smallest start, then
    period; nulls without runs), the digest of all runs, and that of the words that are
    kept. Words lie between ASCII white space. A null or empty text has no words and no
    runs; its digests are those of the empty string. Repeated rows and null keys give rows
    of their own; an empty table has none; other columns are left out. ``edit`` may change
    the words of a document (key, words) before runs are looked for. Nothing is shuffled.
    """
    prepared(df.sparkSession)
    named = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, rows, size = [], [], 0
            names = batch["k"].astype(object).where(batch["k"].notna(), None)
            for name, value in zip(names, batch["t"]):
                words = (value or "").encode("utf-8", "replace").split()
                held.append(edit(name, words) if edit else words)
                size += len(value or "")
                if size > CHUNK:
                    rows += _rows(held)
                    held, size = [], 0
            rows += _rows(held)
            out = pd.DataFrame(rows, columns=[part.split()[0] for part in FIELDS.split(", ")])
            out = out.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})
            out.insert(0, key, batch["k"].values)
            yield out

    return named.mapInPandas(work, f"`{key}` {dict(named.dtypes)['k']}, {FIELDS}")


def _rows(lists: list[list[bytes]]) -> list[tuple]:
    ids, starts = word_ids(lists)
    of: list[list[Run]] = [[] for _ in lists]
    for start, n, q in find_runs(ids, max(map(len, lists), default=0)):
        k = int(np.searchsorted(starts, start, "right")) - 1
        of[k].append((start - int(starts[k]), n, q))
    return [described(words, found) for words, found in zip(lists, of)]
