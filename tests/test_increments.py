"""States of loads that merge."""

from pyspark.sql import functions as F

from reviewloom.operators import increments

SCHEMA = "comment string, rating string, n int"


def test_states_merge_to_that_of_the_union(spark):
    rows = [("a bc", "4.5 out", 1), (None, "x", 2), ("  ", None, 3), ("d", "2.0", None), ("a bc", "2.0", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [df.where("n = 1"), df.where("n > 1"), df.where("n is null"), df.limit(0)]
    merged = increments.merged_states(*map(increments.profile_state, parts))
    whole = increments.profile_state(df)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
    got = {r.kind: tuple(r)[1:] for r in increments.state_statistics(merged).collect()}
    assert got["length"] == (4, 11 / 4, 1.0, 1.75, 3.0, 4.0, 4.0)
    assert got["words"] == (4, 5 / 4, 0.0, 0.75, 1.5, 2.0, 2.0)
    assert got["rating"] == (3, 8.5 / 3, 2.0, 2.0, 2.0, 3.25, 4.5)
    assert increments.state_statistics(increments.profile_state(df.limit(0))).count() == 0


def test_sketches_merge_to_that_of_the_union(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("a"), F.concat(F.lit("text " * 10), F.col("id") % 500).alias("b"),
        F.lit(None).cast("string").alias("c"), (F.col("id") % 7 / 2).alias("d e"),
    )
    loads = [increments.distinct_sketches(df.where(F.col("a") % 3 == i)) for i in range(3)]
    merged = {r["column"]: r.distinct_count for r in increments.estimated_counts(increments.merged_sketches(*loads)).collect()}
    whole = {r["column"]: r.distinct_count for r in increments.estimated_counts(increments.distinct_sketches(df)).collect()}
    assert abs(merged["a"] - 20_000) < 1000 and abs(merged["b"] - 500) < 25
    assert merged["c"] == 0 and merged["d e"] == 7
    assert all(abs(merged[name] - whole[name]) <= 0.02 * whole[name] for name in whole)
