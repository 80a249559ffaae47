"""Ranked lexical search by NRA: lists read in order of impact, with score intervals.

1. Documents become shards of a bounded number of documents and postings: the sorted terms,
   and for each the documents that hold it, with counts. Shards are cut where texts are
   read and written; no posting is shuffled, so a frequent term is split by nature.
2. Queries are taken in blocks of bounded size. One scan of the shards counts the documents
   of a block's terms, a second one ranks.
3. In a shard each term's list is put in order of impact. A query reads its lists from the
   top, some steps at a time, and never looks a document up. What was read of a document is
   the lower end of its score; with the last impact of each list that it was not met in,
   the upper end. It reads on until every document that may be among the best has its
   exact score, equal scores included.
4. A task keeps the best documents of each query over its shards, so a score that is too
   low for it ends the reading of later shards sooner. The best of all tasks are ranked by
   Spark, which cuts each group ahead of its shuffle.

Terms are told apart by 64-bit hashes; all scores are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored
from .words import SYMBOLS, chunks

#: Documents and postings of a shard, but for a single larger document.
DOCUMENTS, POSTINGS = 8192, 500_000
#: Queries of a block, and terms of all of them, but for a single larger query.
QUERIES, TERMS = 1000, 100_000
#: Postings that a list is read by at first, and the growth from one step to the next.
FIRST_READ, GROWTH = 32, 4

# Fixed values of the score: saturation and length normalisation in hundredths.
SCALE, SATURATION, FLAT, LENGTH = 1_000_000_000, 12, 75, 25
# ---- end of fixed values

INDEX = (
    "n_docs long, n_terms long, ids binary, nulls binary, lengths binary, "
    "terms binary, offsets binary, docs binary, counts binary"
)


def term_counts(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: (first text, terms of each, and by term: hash, text, occurrences)."""
    for start, _, chunk in chunks(texts, lower=True, gaps=SYMBOLS):
        lengths = np.diff(chunk.first)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((doc, chunk.hashes))
        term, doc = chunk.hashes[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))[: len(term)])
        yield start, lengths, term[new], doc[new], np.diff(np.append(new, len(term)))


class Shard:
    """Postings of some documents while they are gathered."""

    def __init__(self):
        self.ids, self.lengths, self.parts, self.size = [], [], [], 0

    def add(self, ids: list, lengths: np.ndarray, term, doc, count) -> None:
        """Documents without any term are left out."""
        has = np.flatnonzero(lengths)
        place = np.zeros(len(lengths), dtype=np.int64)
        place[has] = len(self.ids) + np.arange(len(has))
        self.ids += [ids[i] for i in has.tolist()]
        self.lengths += lengths[has].tolist()
        self.parts.append((term, place[doc], count))
        self.size += len(term)

    def row(self) -> tuple:
        term, doc, count = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((doc, term))
        term, doc, count = term[order], doc[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        return (
            len(self.ids),
            sum(self.lengths),
            np.array([0 if i is None else i for i in self.ids], dtype=np.int64).tobytes(),
            np.array([i is None for i in self.ids], dtype=bool).tobytes(),
            np.array(self.lengths, dtype=np.int64).tobytes(),
            term[first].tobytes(),
            np.append(first, len(term)).astype(np.int32).tobytes(),
            doc.astype(np.int32).tobytes(),
            count.astype(np.int32).tobytes(),
        )


def index(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shards of all documents with a term, as rows of ``INDEX``. Write them before use.

    Null and empty texts have no terms. Keys are integers or null; repeated rows are
    documents of their own; an empty table has no shards; other columns are left out.
    """
    prepared(df.sparkSession)
    named = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard()
        names = [part.split()[0] for part in INDEX.split(", ")]
        for batch in batches:
            ids = [None if pd.isna(k) else int(k) for k in batch["k"]]
            for start, lengths, term, doc, count in term_counts(batch["t"].tolist()):
                if shard.ids and (len(shard.ids) + len(lengths) > DOCUMENTS or shard.size + len(term) > POSTINGS):
                    yield pd.DataFrame([shard.row()], columns=names)
                    shard = Shard()
                shard.add(ids[start : start + len(lengths)], lengths, term, doc, count)
        if shard.ids:
            yield pd.DataFrame([shard.row()], columns=names)

    return named.mapInPandas(work, INDEX)


def queries(df: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """Rows (item_id, terms, counts) of the queries that have a term."""
    prepared(df.sparkSession)
    named = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = batch["k"].astype("Int64").tolist(), []
            for start, lengths, term, doc, count in term_counts(batch["t"].tolist()):
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(lengths) + 1)).tolist()
                for i in np.flatnonzero(lengths).tolist():
                    own = order[cuts[i] : cuts[i + 1]]
                    rows.append((ids[start + i], term[own].tobytes(), count[own].astype(np.int64).tobytes()))
            out = pd.DataFrame(rows, columns=["item_id", "terms", "counts"])
            yield out.assign(item_id=out["item_id"].astype("Int64"))

    return named.mapInPandas(work, "item_id long, terms binary, counts binary")


def _blocks(asked: DataFrame) -> Iterator[list[tuple]]:
    """The queries in blocks: (item_id, terms, counts). One partition is held at a time."""
    held, size = [], 0
    for row in asked.toLocalIterator():
        terms = np.frombuffer(row.terms, np.uint64)
        if held and (len(held) >= QUERIES or size + len(terms) > TERMS):
            yield held
            held, size = [], 0
        held.append((row.item_id, terms, np.frombuffer(row.counts, np.int64)))
        size += len(terms)
    if held:
        yield held


def _matches(terms: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted terms among those of a shard: (which wanted, where)."""
    have = np.frombuffer(terms, np.uint64)
    at = np.searchsorted(have, wanted)
    at[at == len(have)] = 0
    which = np.flatnonzero(have[at] == wanted)
    return which, at[which]


def document_counts(shards: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many documents hold each of the wanted terms (sorted hashes)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for terms, offsets in zip(batch["terms"], batch["offsets"]):
                which, at = _matches(terms, wanted)
                total[which] += np.diff(np.frombuffer(offsets, np.int32))[at]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    counted = shards.select("terms", "offsets").mapInPandas(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(wanted), dtype=np.int64)
    for row in counted.collect():
        out[row.term] = row.n
    return out


class Lists:
    """The lists of the wanted terms in a shard, in order of impact."""

    def __init__(self, row, wanted: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.nulls = np.frombuffer(row.nulls, bool)
        offsets = np.frombuffer(row.offsets, np.int32).astype(np.int64)
        which, at = _matches(row.terms, wanted)
        sizes = offsets[at + 1] - offsets[at]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.repeat(offsets[at] - cuts[:-1], sizes) + np.arange(cuts[-1])
        docs = np.frombuffer(row.docs, np.int32)[flat].astype(np.int64)
        count = np.frombuffer(row.counts, np.int32)[flat].astype(np.int64)
        norm = FLAT + LENGTH * np.frombuffer(row.lengths, np.int64) * n_docs // n_terms
        impact = SCALE * count // (1000 * count + SATURATION * norm[docs])
        order = np.lexsort((-impact, np.repeat(np.arange(len(at)), sizes)))
        docs, impact = docs[order], impact[order]
        cuts = cuts.tolist()
        self.of = {w: (docs[a:b], impact[a:b]) for w, a, b in zip(which.tolist(), cuts[:-1], cuts[1:])}


def best_of_shard(lists: Lists, terms: list[int], factors: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard) that may be among the k best, and their scores.

    ``factors`` are the weights of the query's terms, with repeats. Left out are documents
    that cannot reach ``floor`` or the k-th best of the shard; all others have exact scores.
    """
    open_ = [(*lists.of[t], f) for t, f in zip(terms, factors) if t in lists.of and f > 0]
    lower = np.zeros(len(lists.ids), dtype=np.int64)
    read, upto = 0, FIRST_READ
    while True:
        ends = []
        for docs, impact, factor in open_:
            lower[docs[read:upto]] += factor * impact[read:upto]
            if upto < len(docs):
                ends.append((docs[:upto], factor * int(impact[upto - 1])))
        # what a document may still get: the last impact of each list it was not met in
        more = np.full(len(lower), sum(end for _, end in ends), dtype=np.int64)
        for met, end in ends:
            more[met] -= end
        least = max(1, floor)
        if len(lower) > k:
            least = max(least, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
        may = np.flatnonzero(lower + more >= least)
        if not more[may].any():
            return may, lower[may]
        open_ = [part for part in open_ if len(part[0]) > upto]
        read, upto = upto, upto * GROWTH


def _top(score, null, ids, k: int):
    order = np.lexsort((ids, null, -score))[:k]
    return score[order], null[order], ids[order]


def rank(shards: DataFrame, block: list[tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Rows (item, doc_id, score): the k best of each task for each query of a block."""
    wanted = np.unique(np.concatenate([terms for _, terms, _ in block]))
    df = document_counts(shards, wanted)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    asked = []
    for _, terms, counts in block:
        at = np.searchsorted(wanted, terms)
        asked.append((at.tolist(), (weights[at] * counts).tolist()))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * len(asked)
        for batch in batches:
            for row in batch.itertuples(index=False):
                lists = Lists(row, wanted, n_docs, n_terms)
                for i, (terms, factors) in enumerate(asked):
                    floor = int(best[i][0][-1]) if len(best[i][0]) == k else 0
                    docs, score = best_of_shard(lists, terms, factors, k, floor)
                    if len(docs):
                        new = (score, lists.nulls[docs], lists.ids[docs])
                        best[i] = _top(*[np.concatenate(x) for x in zip(best[i], new)], k)
        score, null, ids = (np.concatenate(x) for x in zip(*best))
        item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        doc = pd.array(ids, dtype="Int64")
        doc[null] = pd.NA
        yield pd.DataFrame({"item": item, "doc_id": doc, "score": score})

    return shards.mapInPandas(work, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each query, score above 0.

    Equal scores go by key, null keys last. Null and empty texts match nothing. Repeated
    rows are documents or queries of their own, the latter ranked apart from each other.
    Without documents or queries there are no rows.
    """
    spark = prepared(docs.sparkSession)
    shards = stored(index(docs, text, key), "shards")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked = stored(queries(items, text, item_key), "queries")
    out = None
    for block in _blocks(asked):
        if not n_docs:
            break
        names = spark.createDataFrame([(i, item) for i, (item, _, _) in enumerate(block)], "item long, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = rank(shards, block, n_docs, n_terms, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = stored(found.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
