"""The most frequent words with a bounded shuffle, exact and proven."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as textfn
from ..session import shared_folder
from .clean import require_columns
from .ranking import explode_items, top_k

SUMMARY = "word string, count long, error long"


class Summary:
    """Counts of at most ``size`` words, each too low by ``error`` at most.

    A word that is not there occurred ``error`` times at most. When more than twice as
    many words are held, the count that comes next after the ``size`` largest is taken off
    all of them, and those without a count go: the counters of Misra and Gries, with the
    reduction put off.
    """

    def __init__(self, size: int):
        self.size, self.error, self.counts = size, 0, Counter()

    def add(self, words: list[str]) -> None:
        self.counts.update(words)
        if len(self.counts) > 2 * self.size:
            self.reduce()

    def reduce(self) -> None:
        if len(self.counts) <= self.size:
            return
        off = sorted(self.counts.values(), reverse=True)[self.size]
        self.error += off
        self.counts = Counter({word: n - off for word, n in self.counts.items() if n > off})


def word_summaries(df: DataFrame, column: str = "comment", counters: int = 20_000) -> DataFrame:
    """One summary of each partition: rows (word, count, null) and (null, null, error).

    Summaries merge by adding up counts and errors, those of other loads too. At most
    ``counters`` rows and one more leave a task.
    """
    require_columns(df, column)
    if counters < 1:
        raise ValueError("counters must be 1 or more")
    # words hold no white space, so one blank between them is a safe mark
    joined = df.select(F.array_join(textfn.tokens(F.col(f"`{column}`").cast("string")), " ").alias("words"))

    def summarise(batches: Iterator) -> Iterator:
        import pandas as pd

        held = Summary(counters)
        for batch in batches:
            for text in batch["words"]:
                if text:
                    held.add(text.split(" "))
        held.reduce()
        words = list(held.counts.items())
        out = pd.DataFrame([(w, n, None) for w, n in words] + [(None, None, held.error)], columns=["word", "count", "error"])
        yield out.astype({"count": "Int64", "error": "Int64"})

    return joined.mapInPandas(summarise, SUMMARY)


def frequent_words(df: DataFrame, column: str = "comment", k: int = 10, counters: int = 20_000) -> DataFrame:
    """The k most frequent tokens with their exact counts; ties by word.

    The whole vocabulary never goes through a shuffle. Summaries of the partitions give
    the words that may be among the k; those are counted again exactly. A word that no
    summary names occurs no more often than the sum of their errors: if the k-th count is
    not above that, nothing is proven, and it raises; give more ``counters``. Runs jobs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/words-{uuid4().hex}"
    word_summaries(df, column, counters).write.parquet(path)
    summaries = spark.read.schema(SUMMARY).parquet(path)
    error = summaries.agg(F.coalesce(F.sum("error"), F.lit(0)).alias("e")).first().e
    merged = summaries.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("count").alias("count"))
    best = top_k(merged, "word", k).collect()
    least = best[-1]["count"] if len(best) == k else 0
    candidates = merged.where(F.col("count") + F.lit(error) >= F.lit(least)).select("word")
    words = explode_items(df, textfn.tokens(F.col(f"`{column}`").cast("string")), "word")
    counts = words.join(candidates, "word", "left_semi").groupBy("word").agg(F.count("*").alias("count"))
    out = f"{shared_folder(spark)}/words-{uuid4().hex}"
    top_k(counts, "word", k).write.parquet(out)
    exact = spark.read.schema(counts.schema).parquet(out)
    found = exact.agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
    if error and (found.n < k or found.least <= error):
        raise ValueError(f"{counters} counters do not prove the {k} most frequent words: errors add up to {error}")
    return top_k(exact, "word", k)
