"""Word statistics of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as textfn
from .clean import require_columns
from .ranking import explode_items, item_counts, top_k


def _counts(df: DataFrame, column: str, words, first_seen: list[str] | None) -> DataFrame:
    require_columns(df, column, *(first_seen or []))
    return item_counts(df, words(F.col(column).cast("string")), "word", first_seen=first_seen)


def word_counts(df: DataFrame, column: str = "comment", first_seen=None) -> DataFrame:
    """Every whitespace-separated token with its count."""
    return _counts(df, column, textfn.tokens, first_seen)


def word_frequency(df: DataFrame, column: str = "comment", k: int = 10, first_seen=None) -> DataFrame:
    """The k most frequent tokens; ``first_seen`` orders ties by appearance."""
    tie = "first_seen" if first_seen else None
    return top_k(word_counts(df, column, first_seen), "word", k, tie)


def vocabulary() -> Column:
    """Number of words, as an aggregate over their counts.

    It reads the count, so that its plan keeps the same aggregation as a ranking
    over the same words and both share one shuffle.
    """
    return F.count_if(F.col("count") > 0)


def vocabulary_size(df: DataFrame, column: str = "comment", approximate: bool = False) -> DataFrame:
    """Number of different tokens; the approximate form keeps a sketch only."""
    if approximate:
        require_columns(df, column)
        words = explode_items(df, textfn.tokens(F.col(column).cast("string")), "word")
        return words.agg(F.approx_count_distinct("word").alias("total_unique_words"))
    return word_counts(df, column).agg(vocabulary().alias("total_unique_words"))


def letter_words(df: DataFrame, column: str = "comment", k: int = 20, first_seen=None) -> DataFrame:
    """The k most frequent words made of letters only."""
    tie = "first_seen" if first_seen else None
    return top_k(_counts(df, column, textfn.letter_words, first_seen), "word", k, tie)


def digit_runs(df: DataFrame, column: str = "comment", *keys: str) -> DataFrame:
    """T4: one row per run of digits, with the key columns of its text."""
    require_columns(df, column, *keys)
    runs = textfn.digit_runs(F.col(column).cast("string"))
    placed = explode_items(df, runs, "digits", *keys)
    return placed.select(*keys, F.col("_pos").alias("position"), "digits")
