"""Exact interpolated quantiles that hold for any number of distinct values."""

from __future__ import annotations

from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_quantiles(value: Column, probabilities: list[float], weight: Column) -> Column:
    """Quantiles of an already counted column, as an aggregate.

    The aggregate holds one entry per distinct value in one task, so it is for
    values whose number is bounded (lengths, word counts), not for any column.
    """
    return F.percentile(value, F.array(*[F.lit(p) for p in probabilities]), weight)


def _splits(df: DataFrame, columns: list[str], buckets: int) -> list[list[float]]:
    """Bucket bounds near the quantiles of each column: at most ``buckets`` numbers
    per column come to the driver. They only balance the work; any bounds are right,
    but infinities, which are the outer ones already.
    """
    grid = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    row = df.agg(
        *[F.percentile_approx(F.col(c), grid, 10 * buckets).alias(c) for c in columns]
    ).first()
    bounds = []
    for column in columns:
        inner = sorted({b for b in row[column] or [] if isfinite(b)}) or [0.0]
        bounds.append([float("-inf"), *inner, float("inf")])
    return bounds


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], buckets: int = 256
) -> DataFrame:
    """(column, probability, quantile) with linear interpolation between ranks.

    ``percentile`` keeps every distinct value of a column in one task. Here bucket
    totals (``buckets`` per column) tell in which bucket each wanted rank lies, and
    only the values of those buckets are shuffled, counted and put in order, each
    bucket in its own task. NaN counts as missing. Infinities are values like others; a
    quantile between two different infinite ranks is NaN, as their interpolation is.
    """
    # Names of our own: those of the columns may hold dots.
    plain = [f"c{i}" for i in range(len(columns))]
    numbers = df.select(
        *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(p) for c, p in zip(columns, plain)]
    )
    bucketed = Bucketizer(
        splitsArray=_splits(numbers, plain, buckets),
        inputCols=plain,
        outputCols=[f"{p}__bucket" for p in plain],
        handleInvalid="keep",
    ).transform(numbers)
    tall = bucketed.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"{p}__bucket").cast("int").alias("bucket"),
                        F.col(p).alias("value"),
                    )
                    for c, p in zip(columns, plain)
                ]
            )
        ).alias("cell")
    ).select("cell.*").where(F.col("value").isNotNull())

    # One row per column and bucket: small, whatever the data.
    totals = tall.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per_column = Window.partitionBy("column")
    upto = per_column.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(
        "column",
        "bucket",
        (F.sum("n").over(upto) - F.col("n")).alias("before"),
        F.sum("n").over(upto).alias("upto"),
        F.sum("n").over(per_column).alias("total"),
    )
    wanted = offsets.withColumn(
        "probability", F.explode(F.array(*[F.lit(p) for p in probabilities]))
    ).withColumn("position", (F.col("total") - 1) * F.col("probability"))
    low, high = F.floor("position"), F.ceil("position")
    wanted = wanted.where((F.col("upto") > low) & (F.col("before") <= high)).select(
        "column", "bucket", "before", "probability", "position"
    )

    in_bucket = (
        Window.partitionBy("column", "bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    needed = wanted.select("column", "bucket").distinct()
    ranked = (
        tall.join(F.broadcast(needed), ["column", "bucket"], "left_semi")
        .groupBy("column", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto_value", F.sum("n").over(in_bucket))
        .join(F.broadcast(wanted), ["column", "bucket"])
        .withColumn("last", F.col("before") + F.col("upto_value") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    at_low = F.max(F.when(F.floor("position").between(F.col("first"), F.col("last")), F.col("value")))
    at_high = F.max(F.when(F.ceil("position").between(F.col("first"), F.col("last")), F.col("value")))
    fraction = F.col("position") - F.floor("position")
    return (
        ranked.groupBy("column", "probability", "position")
        .agg(at_low.alias("low"), at_high.alias("high"))
        .select(
            "column",
            "probability",
            F.when(F.col("low") == F.col("high"), F.col("low"))
            .otherwise(F.col("low") + (F.col("high") - F.col("low")) * fraction)
            .alias("quantile"),
        )
    )
