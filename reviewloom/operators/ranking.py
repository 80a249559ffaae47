"""Counting values and ranking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.numbers import tally
from .clean import require_columns


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), most frequent first, nulls left out."""
    require_columns(df, column)
    name = f"`{column}`"
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(tally().alias("count"))
    return counts.orderBy(F.desc("count"), name)


def value_percent(df: DataFrame, column: str) -> DataFrame:
    """(value, percent) of the rows that have a value.

    The total is a scalar subquery over the counts, whose shuffle it shares: one scan, no
    join and no one-task window.
    """
    require_columns(df, column)
    name = f"`{column}`"
    present = df.where(F.col(name).isNotNull())
    counts = present.groupBy(name).agg(tally().alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    percent = (F.lit(100.0) * F.col("count") / total).alias("percent")
    return counts.select(name, percent).orderBy(F.desc("percent"), name)


def explode_items(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row per array item with its place ``_pos``, beside the ``keep`` columns.

    The outer form, less its empty rows: for the inner one the optimizer adds a test
    that the array is not empty and so computes the array twice.
    """
    placed = df.select(*keep, F.posexplode_outer(items).alias("_pos", name))
    return placed.where(F.col("_pos").isNotNull())


def _place(df: DataFrame, order: list[str]) -> Column:
    """Something to order items by: the row's place, then the place in the row.

    For a whole-number row key it is one decimal, of fixed width, so that its minimum
    is kept by a hash aggregation; a struct would have all items sorted first.
    """
    kinds = [df.schema[name].dataType for name in order]
    if len(order) == 1 and isinstance(kinds[0], IntegralType):
        row = F.col(order[0]).cast("decimal(20,0)")
        return (row * F.lit(2**31).cast("decimal(10,0)") + F.col("_pos")).cast("decimal(38,0)")
    return F.struct(*order, "_pos")


def item_counts(
    df: DataFrame,
    items: Column,
    name: str,
    weight: str | None = None,
    first_seen: list[str] | None = None,
) -> DataFrame:
    """Explode an array and count its items, counting before the shuffle.

    ``first_seen`` names the columns that order the rows; it adds the earliest
    place of each item, for ties that go by first appearance.
    """
    measures = [tally(weight).alias("count")]
    if first_seen:
        measures.append(F.min(_place(df, first_seen)).alias("first_seen"))
    carried = list(first_seen or []) + ([weight] if weight else [])
    return explode_items(df, items, name, *carried).groupBy(name).agg(*measures)


def top_k(counts: DataFrame, name: str, k: int, tie: str | None = None) -> DataFrame:
    """L4: the k most frequent; ties by value, or by ``first_seen`` when counted."""
    return counts.orderBy(F.desc("count"), tie or name).limit(k).select(name, "count")


def top_k_per_group(counts: DataFrame, group: str, name: str, k: int) -> DataFrame:
    """The k most frequent of each group, with their rank.

    The rank filter lets Spark cut every map-side partition to k rows per group
    before the shuffle, so few groups with many items do no harm.
    """
    order = Window.partitionBy(group).orderBy(F.desc("count"), name)
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(group, "rank", name, "count")
