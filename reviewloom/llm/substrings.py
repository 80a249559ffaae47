"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage counts when a window of ``size`` words occurs at least twice. Window starts are
the suffixes. Keeping them all in one tree, or shipping each with its words, is out of
reach, so they are split by prefixes that the text itself chooses:

1. A window belongs to its smallest run of ``GRAM`` words by hash, the leftmost of equal
   ones. Equal windows have the same run at the same place, and neighbouring windows
   mostly share one, so a block of windows is one row: (prefix, whole block, place).
2. A prefix that occurs once holds no repeat and ends here. So does one whose blocks are
   all the same: they are repeats throughout.
3. Equal blocks of other prefixes are repeats throughout too. One of each goes with its
   words to the group of its prefix. A prefix with more than ``FULL`` blocks is made
   longer, to the whole window, so that no group outgrows memory.
4. Tasks sort the suffixes of their groups by words, which with the lengths of common
   prefixes is the suffix tree. Inner nodes at least ``size`` words deep are the maximal
   repeats; every suffix below one is marked.
5. Marks go back to the documents, where covered words are taken out.

Blocks with equal words are recognised by two independent 64-bit hashes, of the prefix
and of the block; what is not the same throughout is compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, stored
from .words import Chunk, Runs, chunks, signed, sliding_least

#: Words of the run that makes a prefix.
GRAM = 8
#: Blocks of a prefix from which it is made as long as the window.
FULL = 20_000
#: Suffixes that a task sorts at once, but for those of a single larger group.
SUFFIXES = 60_000


def _blocks(chunk: Chunk, size: int):
    """Blocks of windows of each text: (text, first window, windows, prefix hash, block hash)."""
    gram = min(GRAM, size)
    n = len(chunk.hashes)
    runs, other = Runs(chunk.hashes), Runs(chunk.hashes, 0xAF251AF3B0F025B5)
    if n < size:
        return
    at = np.arange(n - gram + 1)
    grams = runs.hash(at, at + gram)
    least = sliding_least(grams, size - gram + 1)  # one for each window start
    for i in range(len(chunk.first) - 1):
        a, b = int(chunk.first[i]), int(chunk.first[i + 1])
        if b - a < size:
            continue
        anchor = least[a : b - size + 1]
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        start = np.concatenate(([0], cut))
        stop = np.concatenate((cut, [len(anchor)]))
        place = anchor[start] - a
        body = other.hash(a + start, a + stop + size - 1) + (place - start).astype(np.uint64)
        yield i, start, stop - start, signed(grams[anchor[start]]), signed(body)


def _anchors(named: DataFrame, size: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["id"].to_numpy()
            for lo, _, chunk in chunks(batch["t"].tolist()):
                parts = []
                for i, start, count, prefix, body in _blocks(chunk, size):
                    parts.append((np.full(len(start), keys[lo + i], dtype=np.int64), start, count, prefix, body))
                if parts:
                    doc, start, count, prefix, body = map(np.concatenate, zip(*parts))
                    yield pd.DataFrame({"prefix": prefix, "body": body, "id": doc, "start": start, "n": count})

    return named.mapInPandas(work, "prefix long, body long, id long, start int, n int")


def _segments(met: DataFrame, size: int) -> DataFrame:
    """Suffix groups of the documents' unsettled blocks, with their words.

    In: id, t, and ``spots``, an array of (start, n, prefix, body, many). Out: a row per
    block, or per window where the prefix was made longer.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            spots, keys = batch["spots"].tolist(), batch["id"].tolist()
            for lo, hi, chunk in chunks(batch["t"].tolist()):
                runs, other = Runs(chunk.hashes), Runs(chunk.hashes, 0xAF251AF3B0F025B5)
                for i in range(lo, hi):
                    first = int(chunk.first[i - lo])
                    for spot in spots[i]:
                        start, n = int(spot["start"]), int(spot["n"])
                        if not spot["many"]:
                            words = chunk.text(first + start, first + start + n + size - 1)
                            out.append((spot["prefix"], spot["body"], keys[i], start, n, words))
                            continue
                        w = first + start + np.arange(n)
                        whole = zip(signed(runs.hash(w, w + size)).tolist(), signed(other.hash(w, w + size)).tolist())
                        for k, (one, two) in enumerate(whole):
                            out.append((one, two, keys[i], start + k, 1, chunk.text(first + start + k, first + start + k + size)))
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=["grp", "body", "id", "start", "n", "words"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["grp", "body", "id", "start", "n", "words"])

    return met.mapInPandas(work, "grp long, body long, id long, start int, n int, words binary")


def deep_nodes(groups: np.ndarray, segments: list[bytes], copies: np.ndarray, size: int) -> list[np.ndarray]:
    """For each segment, which of its windows lie below an inner node ``size`` words deep.

    The suffixes of all segments are sorted by group and words; a node is a run of
    neighbours whose common prefix has ``size`` words.
    """
    codes: dict[bytes, int] = {}
    rows, owner, at = [], [], []
    for i, segment in enumerate(segments):
        words = np.array([codes.setdefault(w, len(codes)) for w in segment.split(b" ")], dtype=">u4")
        windows = np.lib.stride_tricks.sliding_window_view(words, size)
        rows.append(windows)
        owner.append(np.full(len(windows), i))
        at.append(np.arange(len(windows)))
    suffixes = np.concatenate(rows)
    owner, at = np.concatenate(owner), np.concatenate(at)
    group = np.unique(groups, return_inverse=True)[1][owner].astype(">u4")
    table = np.ascontiguousarray(np.column_stack((group, suffixes)).astype(">u4"))
    order = np.argsort(table.view(np.dtype((np.void, table.shape[1] * 4))).ravel(), kind="stable")
    table = table[order]
    same = table[1:] == table[:-1]
    # words that each suffix has in common with the one before it, 0 across groups
    common = np.where(same.all(axis=1), size, np.maximum(same.argmin(axis=1) - 1, 0))
    deep = np.zeros(len(order), dtype=bool)
    deep[1:] |= common >= size
    deep[:-1] |= common >= size
    marked = np.zeros(len(order), dtype=bool)
    marked[order] = deep
    marked |= copies[owner] > 1
    ends = np.cumsum([len(r) for r in rows])
    return np.split(marked, ends[:-1])


def _trees(distinct: DataFrame, size: int) -> DataFrame:
    """Marks (grp, body, mask) of distinct blocks (grp, body, words, copies)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sort(rows: list) -> pd.DataFrame:
            marks = deep_nodes(
                np.array([r.grp for r in rows]), [r.words for r in rows], np.array([r.copies for r in rows]), size
            )
            bits = [int((m.astype(np.int64) << np.arange(len(m))).sum()) for m in marks]
            return pd.DataFrame(
                {"grp": [r.grp for r in rows], "body": [r.body for r in rows], "mask": np.array(bits, dtype=np.int64)}
            )

        held, suffixes, last = [], 0, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.grp != last and suffixes >= SUFFIXES:
                    yield sort(held)
                    held, suffixes = [], 0
                last = row.grp
                held.append(row)
                suffixes += row.n
        if held:
            yield sort(held)

    ordered = distinct.repartition("grp").sortWithinPartitions("grp")
    return ordered.mapInPandas(work, "grp long, body long, mask long")


def covered(df: DataFrame, size: int) -> DataFrame:
    """Spans (id, spans) of windows that occur elsewhere, from (id, t); ids must be unique."""
    if not 2 <= size <= 64:
        raise ValueError("a window has 2 to 64 words")
    anchors = stored(_anchors(df, size), "anchors")
    # equal blocks are repeats throughout; the first of them stands for all where blocks meet
    bodies = anchors.groupBy("prefix", "body").agg(F.count("*").alias("equal"), F.min(F.struct("id", "start")).alias("one"))
    bodies = stored(bodies, "bodies")
    prefixes = bodies.groupBy("prefix").agg(F.sum("equal").alias("many"), F.count("*").alias("bodies"))
    prefixes = prefixes.where("many > 1").select(
        "prefix", (F.col("bodies") == 1).alias("same"), (F.col("many") > FULL).alias("many")
    )
    met = anchors.join(bodies.join(prefixes, "prefix"), ["prefix", "body"]).withColumn(
        "first", F.expr("not same and one.id = id and one.start = start")
    )
    met = stored(met.select("id", "start", "n", "prefix", "body", "many", "equal", "first"), "met")
    spots = met.where("first").groupBy("id").agg(
        F.collect_list(F.struct("start", "n", "prefix", "body", "many")).alias("spots")
    )
    segments = stored(_segments(df.join(spots, "id"), size), "segments")
    distinct = segments.groupBy("grp", "body").agg(
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("words").alias("words")
    )
    masks = stored(_trees(distinct, size).where("mask <> 0"), "marks")
    found = segments.select("grp", "body", "id", "start").join(masks, ["grp", "body"])
    settled = met.where("equal > 1")
    spans = settled.select("id", "start", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    spans = spans.union(found.select("id", "start", "mask"))
    return spans.groupBy("id").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))


def dedup(df: DataFrame, size: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``df`` and n_words, n_removed, kept (text), kept_sha256.

    Words are separated by ASCII white space. A word goes if a window of ``size`` words
    that covers it also starts anywhere else; windows are judged on the input. Null and
    empty texts have no words, texts with fewer than ``size`` no window. Repeated rows
    are repeats of one another. The kept words are joined by one space; a null text keeps
    the empty string here. Columns of the same names as those added are replaced. Null and
    repeated keys are allowed: rows are told apart by a number of their own, given when
    the table is first written. An empty table stays empty.
    """
    spark = prepared(df.sparkSession)
    added = ["n_words", "n_removed", "kept", "kept_sha256"]
    plain = df.drop(*[c for c in added if c != text])
    inner = {name: f"c{i}" for i, name in enumerate(plain.columns)}
    # ids that hold for good: unique keys as they are, others numbered in a written table
    keyed = plain.select(F.col(f"`{key}`").alias("k"))
    unique = dict(plain.dtypes)[key] in ("bigint", "int") and not keyed.groupBy("k").count().where(
        "count > 1 or k is null"
    ).limit(1).count()
    numbered = plain.toDF(*inner.values())
    numbered = numbered.withColumn("id", F.col(inner[key]).cast("long") if unique else F.monotonically_increasing_id())
    if not unique:
        numbered = stored(numbered, "numbered")
    texts = numbered.select("id", F.col(inner[text]).alias("t"))
    spans = covered(texts, size)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, marks = [], batch["spans"].tolist()
            for lo, hi, chunk in chunks(batch[inner[text]].tolist()):
                data = chunk.data.tobytes()
                for i in range(lo, hi):
                    a, b = int(chunk.first[i - lo]), int(chunk.first[i - lo + 1])
                    gone = np.zeros(b - a + 1, dtype=np.int64)
                    if marks[i] is not None and len(marks[i]):
                        start = np.array([s["start"] for s in marks[i]], dtype=np.int64)
                        mask = np.array([s["mask"] for s in marks[i]], dtype=np.int64)
                        bits = (mask[:, None] >> np.arange(64)) & 1
                        at = (start[:, None] + np.arange(64))[bits == 1]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + size, -1)
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    if len(keep) == b - a:
                        start, end = int(chunk.base[i - lo]), int(chunk.base[i - lo + 1])
                        kept = b" ".join(data[start:end].split())
                    else:
                        kept = b" ".join(
                            data[s:e] for s, e in zip(chunk.starts[keep].tolist(), chunk.ends[keep].tolist())
                        )
                    rows.append((b - a, b - a - len(keep), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            out = batch.drop(columns=["id", "spans"])
            out[added] = pd.DataFrame(rows, columns=added, index=out.index)
            yield out

    fields = ", ".join(f"{inner[n]} {kind}" for n, kind in plain.dtypes)
    schema = f"{fields}, n_words long, n_removed long, kept string, kept_sha256 string"
    out = numbered.join(spans, "id", "left").mapInPandas(work, schema)
    return out.select(*[F.col(inner[n]).alias(n) for n in plain.columns], *added)
