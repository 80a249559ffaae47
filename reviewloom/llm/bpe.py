"""Byte-pair encoding and decoding of whole texts with a public tokenizer.

Words between ASCII white space are encoded once per task and looked up. Text that has
no such gap is encoded by tree concatenation: halves apart, then growing windows around
each join are encoded again until they agree with both sides. Very long texts are cut
into pieces that Spark encodes in parallel and joins in the same way.

This holds for tokenizers that drop white space and split at it, have no decoder and add
nothing at the edges; ``WordTable`` refuses others.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared
from .words import LOWER, SYMBOLS, Chunk, chunks

#: Characters that are encoded as one text at most; longer runs are halved.
LEAF = 2048
#: Characters of a text above which its pieces are encoded by tasks of their own.
PIECE = 1 << 18
#: Words remembered by a task, in a table of objects and in one of arrays.
REMEMBERED, KNOWN = 400_000, 500_000

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, first and last character of each


def load(path: str, special_as_text: bool = False):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = special_as_text
    if tokenizer.decoder is not None or tokenizer.encode("a b").ids != tokenizer.encode("a").ids + tokenizer.encode("b").ids:
        raise ValueError("the tokenizer must split at white space, drop it, and have no decoder")
    return tokenizer


def _plain(tokenizer, text: str) -> Tokens:
    made = tokenizer.encode(text, add_special_tokens=False)
    spans = np.array(made.offsets, dtype=np.int64).reshape(-1, 2)
    return np.array(made.ids, dtype=np.uint32), spans[:, 0], spans[:, 1]


def _clean(tokens: Tokens) -> np.ndarray:
    """Tokens that share no character with a neighbour."""
    _, start, end = tokens
    apart = np.ones(len(start) + 1, dtype=bool)
    apart[1:-1] = start[1:] >= end[:-1]
    return apart[1:] & apart[:-1] & (end > start)


def _agreeing(window: Tokens, side: Tokens) -> np.ndarray:
    """For each token of the window its index in the side, or -1.

    It counts if the next or the previous token agrees as well.
    """
    place = {key: i for i, (key, ok) in enumerate(zip(zip(*map(np.ndarray.tolist, side)), _clean(side))) if ok}
    found = np.array(
        [place.get(key, -1) if ok else -1 for key, ok in zip(zip(*map(np.ndarray.tolist, window)), _clean(window))],
        dtype=np.int64,
    )
    good = found >= 0
    chained = np.zeros(len(found), dtype=bool)
    pair = good[1:] & good[:-1] & (found[1:] == found[:-1] + 1)
    chained[1:] |= pair
    chained[:-1] |= pair
    return np.where(chained, found, -1)


def _cut(tokens: Tokens, lo: int, hi: int | None = None) -> Tokens:
    return tokens[0][lo:hi], tokens[1][lo:hi], tokens[2][lo:hi]


def join(tokenizer, left: str, right: str, a: Tokens, b: Tokens) -> Tokens:
    """Tokens of ``left + right`` from the tokens of both.

    In an encoding every two neighbours are what their joined text encodes to, and that
    is enough for it to be the encoding. So the window's tokens may take over at a token
    that both have, and hand over at one that the right side has.
    """
    edge, width = len(left), 32
    b = (b[0], b[1] + edge, b[2] + edge)
    while True:
        lo, hi = max(0, edge - width), min(len(right), width)
        ids, start, end = _plain(tokenizer, left[lo:] + right[:hi])
        window = (ids, start + lo, end + lo)
        if lo == 0 and hi == len(right):
            return window
        first = 0 if lo == 0 else None
        last = len(ids) if hi == len(right) else None
        before, after = len(a[0]), 0
        skip = int(np.searchsorted(a[2], lo))
        if first is None:
            at = _agreeing(window, _cut(a, skip))
            at = np.flatnonzero((at >= 0) & (window[2] <= edge) & (window[1] > lo))
            if len(at):
                first = int(at[0])
                before = skip + int(_agreeing(window, _cut(a, skip))[first])
        else:
            before = 0
        if last is None:
            upto = int(np.searchsorted(b[1], edge + hi))
            found = _agreeing(window, _cut(b, 0, upto))
            at = np.flatnonzero((found >= 0) & (window[1] >= edge) & (window[2] < edge + hi))
            if len(at):
                last = int(at[-1])
                after = int(found[last])
        else:
            after = len(b[0])
        if first is not None and last is not None and first <= last:
            parts = (_cut(a, 0, before), _cut(window, first, last), _cut(b, after))
            return tuple(np.concatenate(x) for x in zip(*parts))
        width *= 2


def encode_tree(tokenizer, text: str, leaf: int = LEAF) -> Tokens:
    """Tokens of a text: whole if it is short, else from its halves."""
    if len(text) <= leaf:
        return _plain(tokenizer, text)
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join(tokenizer, left, right, encode_tree(tokenizer, left, leaf), encode_tree(tokenizer, right, leaf))


class WordTable(dict):
    """Word (UTF-8) -> what ``make`` gives for its tokens; encodes words it doesn't have.

    ASCII capitals, a closing mark after letters, and words met before are looked up in
    the table itself. When it is full it becomes the old one, from which words that come
    again are taken over, so the frequent ones stay and memory is bounded.
    """

    def __init__(self, path: str, make: Callable, plus: Callable, special_as_text: bool = False):
        super().__init__()
        self.tokenizer, self.make, self.plus = load(path, special_as_text), make, plus
        self.old: dict = {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith(_WORD_END)]
        self.ends = np.zeros(max(ends, default=0) + 2, dtype=bool)
        self.ends[ends] = True

    def words(self, texts: list) -> list[list[bytes]]:
        """Words of each text; those that are new are encoded together."""
        lists = [(text or "").encode("utf-8", "replace").split() for text in texts]
        made, bases = [], set()
        for word in set().union(*lists):
            if word in self or len(word) > 64:
                continue
            if word in self.old:
                self._keep(word, self.old[word])
                continue
            base = word.lower()
            tail = base[-1:] if base[-1:] in _CLOSING else b""
            base = base[:-1] if tail else base
            made.append((word, base, tail))
            if base not in self:
                bases.add(base)
        letters = [(b, t) for b, t in ((b, b.decode("utf-8", "replace")) for b in bases) if t.isalpha()]
        if letters:
            # letters alone are one word to the tokenizer, whose last token says so
            text = " ".join(t for _, t in letters)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            last = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(last) == len(letters):
                flat, start, fresh = ids.tolist(), 0, {}
                for (base, _), end in zip(letters, last.tolist()):
                    fresh[base] = self.make(flat[start:end])
                    start = end
                for word, base, tail in made:
                    if base in fresh:
                        self._keep(word, self.plus(fresh[base], self[tail]) if tail else fresh[base])
                        if word != base:
                            self._keep(base, fresh[base])
        return lists

    def _keep(self, word: bytes, value) -> None:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = value

    def __missing__(self, word: bytes):
        value = self.old.get(word)
        if value is None:
            value = self._made(word)
        if len(word) <= 64:
            self._keep(word, value)
        return value

    def _made(self, word: bytes):
        text = word.decode("utf-8", "replace")
        if b"<|" not in word:  # capitals may tell a word from a special token
            low = word.lower()
            if low != word:
                return self[low]
            if word[-1:] in _CLOSING and len(word) > 1 and text[:-1].isalpha():
                return self.plus(self[word[:-1]], self[word[-1:]])
        if len(text) <= LEAF:
            return self.make(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.make(encode_tree(self.tokenizer, text)[0].tolist())


_WORD_END = "</w>"
_CLOSING = frozenset([b".", b",", b";", b":", b"!", b"?", b")"])
_TABLES: dict = {}


def task_table(kind, path: str, *more) -> WordTable:
    """The table of this Python worker, kept from one task to the next."""
    key = (kind, path, *more)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = kind(path, *more)
    return _TABLES[key]


def binary(ids) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class IdTable(WordTable):
    """Whole texts to their ids as little-endian 32-bit numbers."""

    def __init__(self, path: str, special_as_text: bool = False):
        super().__init__(path, binary, bytes.__add__, special_as_text)

    def ids(self, texts: list) -> list[bytes]:
        return [b"".join(map(self.__getitem__, words)) for words in self.words(texts)]


class Units(Chunk):
    """Words without ASCII capitals, with the marks after a last letter as a word of their own.

    To the tokenizer letters end where marks begin. Capitals may tell a word from a special
    token, so words that could hold one stay as they are.
    """

    def _bounds(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = self.data
        low = LOWER[data]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        kept = np.unique(np.searchsorted(starts, special, "right") - 1) if len(special) else special
        for i in kept.tolist():
            low[starts[i] : ends[i]] = data[starts[i] : ends[i]]
        self.data = low
        mark = np.concatenate(([False], _MARK[low], [False]))
        edges = np.flatnonzero(mark[1:] != mark[:-1])
        cuts = edges[::2][np.isin(edges[1::2], ends)]
        cuts = cuts[cuts > 0]
        cuts = cuts[_LETTER[low[cuts - 1]]]
        if len(kept):
            cuts = cuts[~np.isin(np.searchsorted(starts, cuts, "right") - 1, kept)]
        return np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))


class FlatTable:
    """Whole texts to their ids as little-endian 32-bit numbers, by arrays.

    The words of a run of texts are hashed together, and each distinct one is looked up
    once among the sorted hashes of the known ones; the ids of the texts are then gathered
    in one step. Words are those of ``Units``, so one with other capitals or marks is not
    new. New words are encoded together, or, if they are small Latin letters, which the
    tokenizer neither changes nor cuts, by its model alone. Words are told apart by 64-bit
    hashes. A full table starts anew, so memory is bounded.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        # how the tokenizer spells letters to its model; the model alone must then give its ids
        spelt = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {ord(c): "".join(x for x, _ in spelt(c)) for c in _SMALL}
        words = [*_SMALL, *(a + b for a in _SMALL for b in _SMALL), *_SAMPLE]
        whole = self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        self.plain = whole == [i for word in words for i in self._alone(word)]
        self._clear()

    def _alone(self, word: str) -> list[int]:
        """Ids of a word of small letters."""
        if not word.isascii():
            word = word.translate(self.spelling)
        return [token.id for token in self.model.tokenize(word)]

    def _clear(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        self.place = self.start = self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the table, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.searchsorted(self.hash, hashes)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == hashes, self.place[at], -1)

    def _insert(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Take in new words."""
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(count.sum()))
        places = len(self.start) + np.arange(len(hashes))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hash, hashes[order])
        self.hash = np.insert(self.hash, at, hashes[order])
        self.place = np.insert(self.place, at, places[order])

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and where those of each end."""
        count = self.count[places]
        ends = np.concatenate(([0], np.cumsum(count)))
        return self.flat[np.repeat(self.start[places] - ends[:-1], count) + np.arange(ends[-1])], ends

    def _places(self, chunk: Chunk, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of distinct words; those that are new come in."""
        if len(self.start) > KNOWN or len(self.flat) > 8 * KNOWN:
            self._clear()
        out = self._find(hashes)
        new = np.flatnonzero(out < 0)
        if len(new):
            raw, at = chunk.data.tobytes(), first[new]
            words = [raw[a:b] for a, b in zip(chunk.starts[at].tolist(), chunk.ends[at].tolist())]
            out[new] = len(self.start) + np.arange(len(new))
            self._insert(hashes[new], self._encoded(words))
        return out

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        texts = [word.decode("utf-8", "replace") for word in words]
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if len(text) > LEAF:
                out[i] = encode_tree(self.tokenizer, text)[0].tolist()
            elif self.plain and _LATIN(text):
                out[i] = self._alone(text)
            else:
                rest.append(i)
        made = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, one in zip(rest, made):
            out[i] = one.ids
        return out

    def ids(self, texts: list) -> list[bytes]:
        out = []
        for _, _, chunk in chunks(texts, kind=Units):
            hashes, first, which = np.unique(chunk.hashes, return_index=True, return_inverse=True)
            flat, ends = self._gathered(self._places(chunk, hashes, first)[which])
            flat, cuts = flat.tobytes(), (4 * ends[chunk.first]).tolist()
            out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out


#: ASCII marks that a letter before them is no part of, letters after ``LOWER``, small
#: letters of Latin 1, words of these alone, and some of them.
_MARK = SYMBOLS & (np.arange(256) > 32) & (np.arange(256) < 127)
_LETTER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_SMALL = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_LATIN = re.compile(f"[{_SMALL}]+").fullmatch
_SAMPLE = "the quick brown fox jumps over a lazy dog zzzzqqqq internationalisation straße garçon ÿñéñ".split()


class ShortTable(IdTable):
    """The same with 16-bit numbers, for vocabularies below 65,536."""

    def __init__(self, path: str, special_as_text: bool = False):
        WordTable.__init__(self, path, lambda ids: array("H", ids).tobytes(), bytes.__add__, special_as_text)


class DecimalTable(WordTable):
    """Words to their ids in decimal, joined by a space."""

    def __init__(self, path: str):
        super().__init__(path, lambda ids: " ".join(map(str, ids)), lambda a, b: f"{a} {b}" if a and b else a or b)
        self.decoder = WordDecoder(self.tokenizer)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): tokens of each whole text and back.

    A null or empty text has no tokens; its digests are those of the empty string.
    Repeated rows and keys give as many rows. Other columns are left out, whatever their
    names. Texts of over ``PIECE`` characters go the way of ``encode_long``; the others
    stay where they are read, nothing of them is shuffled.
    """
    prepared(df.sparkSession)
    named = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = task_table(DecimalTable, path)
        for batch in batches:
            rows = []
            for words in table.words(batch["t"].tolist()):
                parts = list(map(table.__getitem__, words))
                ids = " ".join(filter(None, parts))
                rows.append((ids.count(" ") + 1 if ids else 0, _digest(ids), _digest(table.decoder.text(parts))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, key, batch["k"].values)
            yield out

    schema = f"`{key}` {dict(named.dtypes)['k']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    long = F.length("t") > PIECE
    short = named.where(~F.coalesce(long, F.lit(False))).mapInPandas(work, schema)
    return short.union(encode_long(named.where(long), path, schema))


class WordDecoder(dict):
    """Decimal ids of a word -> its text, as the library's decode gives it."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}

    def __missing__(self, ids: str) -> str:
        text = self.old.get(ids)
        if text is None:
            text = self.tokenizer.decode([int(x) for x in ids.split()], skip_special_tokens=False)
        if len(ids) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[ids] = text
        return text

    def text(self, parts: list[str]) -> str:
        """Without a decoder, tokens are joined by a space, within and between words."""
        return " ".join(map(self.__getitem__, filter(None, parts)))


def encode_long(named: DataFrame, path: str, schema: str) -> DataFrame:
    """The same for very long texts (k, t): pieces in parallel, joined per text."""
    key = schema.split("`")[1]
    rows = named.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "n", F.explode(F.expr(f"sequence(0, int(ceil(length(t) / {PIECE})) - 1)"))
    )
    pieces = rows.select("k", "row", "n", F.expr(f"substring(t, n * {PIECE} + 1, {PIECE})").alias("t"))
    pieces = pieces.repartition(F.col("row"), F.col("n"))

    def work(batches):
        tokenizer = load(path)
        for batch in batches:
            made = [encode_tree(tokenizer, text) for text in batch["t"]]
            yield batch.assign(
                ids=[binary(m[0]) for m in made],
                spans=[np.stack(m[1:]).astype("<i4").tobytes() for m in made],
            )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        tokenizer, parts = load(path), []
        for piece in group.sort_values("n").itertuples():
            spans = np.frombuffer(piece.spans, "<i4").astype(np.int64).reshape(2, -1)
            parts.append((piece.t, (np.frombuffer(piece.ids, "<u4"), spans[0], spans[1])))
        while len(parts) > 1:
            pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
            parts = [
                p[0] if len(p) == 1 else (p[0][0] + p[1][0], join(tokenizer, p[0][0], p[1][0], p[0][1], p[1][1]))
                for p in pairs
            ]
        ids = parts[0][1][0].tolist()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        return pd.DataFrame(
            [(group["k"].iloc[0], len(ids), _digest(" ".join(map(str, ids))), _digest(decoded))],
            columns=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = dict(named.dtypes)["k"]
    coded = pieces.mapInPandas(work, f"k {kind}, row long, n int, t string, ids binary, spans binary")
    return coded.groupBy("row").applyInPandas(merge, schema)
