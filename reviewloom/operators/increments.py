"""Profiles that grow with each load: stored states that merge without the old rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as textfn
from ..functions.keys import distinct_key
from .clean import numeric_rating, require_columns
from .quantiles import histogram_quantiles

#: Precision of the sketches: 2**12 registers, a standard error of 1.6 percent.
PRECISION = 12


def distinct_sketches(df: DataFrame, precision: int = PRECISION) -> DataFrame:
    """(column, sketch) of one load, one HyperLogLog sketch per column.

    One scan; a task sends a sketch per column through the shuffle. Nulls are left out.
    """
    row = df.agg(
        *[
            F.hll_sketch_agg(distinct_key(F.col(f"`{f.name}`"), f.dataType).cast("string"), precision).alias(f.name)
            for f in df.schema.fields
        ]
    )
    cells = [F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("sketch")) for f in df.schema.fields]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def merged_sketches(*loads: DataFrame) -> DataFrame:
    """One sketch per column for all loads: equal to that of their union."""
    return reduce(DataFrame.unionByName, loads).groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_counts(sketches: DataFrame) -> DataFrame:
    """(column, distinct_count), approximately."""
    return sketches.select("column", F.hll_sketch_estimate("sketch").alias("distinct_count"))


def profile_state(df: DataFrame) -> DataFrame:
    """(kind, value, n) of one load: histograms of lengths, words and ratings.

    It has as many rows as there are values, whatever the load's size; missing values are
    a row with a null. One scan and one shuffle.
    """
    require_columns(df, "comment", "rating")
    texts = df.select(F.col("comment").cast("string").alias("c"), numeric_rating(df).alias("r"))
    values = {"length": F.length("c"), "words": F.size(textfn.tokens(F.col("c"))), "rating": F.col("r")}
    # the size of a missing list is -1 or null, by setting
    values["words"] = F.when(F.col("c").isNotNull(), values["words"])
    cells = [F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value")) for kind, v in values.items()]
    exploded = texts.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    return exploded.groupBy("kind", "value").agg(F.count("*").alias("n"))


def merged_states(*loads: DataFrame) -> DataFrame:
    """The state of all loads together: equal to that of their union."""
    return reduce(DataFrame.unionByName, loads).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def state_statistics(state: DataFrame) -> DataFrame:
    """(kind, count, mean, min, q25, median, q75, max) of a state; quartiles are exact."""
    value, n = F.col("value"), F.col("n")
    present = F.when(value.isNotNull(), n)
    quartiles = histogram_quantiles(value, [0.25, 0.5, 0.75], n)
    return state.groupBy("kind").agg(
        F.coalesce(F.sum(present), F.lit(0)).alias("count"),
        F.try_divide(F.sum(value * n), F.sum(present)).alias("mean"),
        F.min(value).alias("min"),
        *[quartiles[i].alias(name) for i, name in enumerate(("q25", "median", "q75"))],
        F.max(value).alias("max"),
    )
