"""P1 to P18, L1, L5."""

import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import profile, ranking
from reviewloom.operators.quantiles import exact_quantiles

RATINGS = {5.0: 144, 4.0: 44, 3.0: 23, 2.0: 6, 1.0: 42}
CATEGORIES = {"Others": 168, "Display": 32, "Battery": 27, "Camera": 26, "Delivery": 6}


@pytest.fixture(scope="module")
def published(spark):
    """A frame with the published counts of a real run."""
    ratings = [r for r, n in RATINGS.items() for _ in range(n)]
    categories = [c for c, n in CATEGORIES.items() for _ in range(n)]
    rows = [
        (category, rating, "x" * (i % 7), datetime(2018, 9, 15 + i % 15))
        for i, (category, rating) in enumerate(zip(categories, ratings, strict=True))
    ]
    return spark.createDataFrame(rows, "Category string, rating double, comment string, date timestamp")


def test_published_profile(published):
    lines = {(r.metric, r.key): r.text or r.value for r in profile.data_summary(published).collect()}
    assert lines[("total_records", None)] == 259
    assert lines[("average_rating", None)] == 3.9343629343629343
    for rating, count in RATINGS.items():
        assert lines[("rating_distribution", str(rating))] == count
    for category, count in CATEGORIES.items():
        assert lines[("categories", category)] == count
    assert lines[("date_range", "start")] == "2018-09-15T00:00:00"
    assert lines[("date_range", "end")] == "2018-09-29T00:00:00"


def test_summary_row_keeps_the_order_of_counts(published):
    # As JSON: a map that is collected loses its order on the way to Python.
    summary = profile.data_summary_row(published)
    maps = summary.select(F.to_json("categories"), F.to_json("rating_distribution")).first()
    assert list(json.loads(maps[0]).items()) == list(CATEGORIES.items())
    assert list(json.loads(maps[1])) == ["5.0", "4.0", "1.0", "3.0", "2.0"]
    row = summary.first()
    lengths = [i % 7 for i in range(259)]
    assert row.comment_length_stats.average == round(float(np.mean(lengths)), 2)
    assert row.comment_length_stats.median == float(np.median(lengths))
    assert (row.comment_length_stats.min, row.comment_length_stats.max) == (0, 6)


def test_summary_without_optional_columns(spark):
    row = profile.data_summary_row(spark.createDataFrame([("ab",), (None,)], "Comments string")).first()
    assert row.total_records == 2 and row.average_rating is None
    assert row.categories == {} and row.rating_distribution == {}
    assert row.comment_length_stats.average == 2.0 and row.date_range.start is None


def test_summary_reads_ratings_from_text(spark):
    df = spark.createDataFrame([("4.0 of 5", "a"), ("none", "b"), ("1", "c")], "rating string, comment string")
    row = profile.data_summary_row(df).first()
    assert row.average_rating == 2.5 and row.rating_distribution == {"1.0": 1, "4.0": 1}


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "comment string, rating double, category string, date timestamp")
    lines = {(r.metric, r.key): r.value for r in profile.data_summary(df).collect()}
    assert lines[("total_records", None)] == 0 and lines[("average_rating", None)] is None


def test_lengths_are_code_points(spark):
    df = spark.createDataFrame([("é",), ("😀😀",), ("",), (None,)], "comment string")
    row = profile.length_stats(df).first()
    assert tuple(row) == (1.0, 1.0, 0, 2)
    assert tuple(profile.column_length(df.withColumn("n", F.lit(12345)), "n").first()) == (5.0, 5.0)


def test_counts_and_percentages(published):
    first = ranking.value_counts(published, "rating").first()
    assert tuple(first) == (5.0, 144)
    shares = {r.rating: r.percent for r in ranking.value_percent(published, "rating").collect()}
    assert shares[5.0] == pytest.approx(100 * 144 / 259) and sum(shares.values()) == pytest.approx(100)
    ordered = [tuple(r) for r in profile.rating_distribution(published).collect()]
    assert ordered == sorted(RATINGS.items())
    assert [r.rating for r in profile.distinct_ratings(published).collect()] == sorted(RATINGS)
    assert profile.average_rating(published).first()[0] == 3.9343629343629343


@pytest.fixture(scope="module")
def untidy(spark):
    long = "x" * 5000
    rows = [
        (1, "a", 0.0, long, [1, 2]),
        (1, "a", -0.0, long, [1, 2]),
        (2, None, None, "", None),
        (2, None, None, "", None),
        (2, "", None, None, None),
        (3, "a|b", 1.5, "x" * 4999 + "y", []),
    ]
    return spark.createDataFrame(rows, "i int, s string, d double, t string, xs array<int>")


def test_nulls_distincts_duplicates(untidy):
    assert {r.column: r.null_count for r in profile.null_counts(untidy).collect()} == {
        "i": 0, "s": 2, "d": 3, "t": 1, "xs": 3,
    }
    assert {r.column: r.distinct_count for r in profile.distinct_counts(untidy).collect()} == {
        "i": 3, "s": 3, "d": 2, "t": 3, "xs": 2,
    }
    approximate = {r.column: r.distinct_count for r in profile.distinct_counts(untidy.drop("xs"), True).collect()}
    assert approximate["t"] == 3
    assert profile.duplicate_count(untidy).first()[0] == untidy.count() - untidy.distinct().count() == 2
    assert profile.duplicate_count(untidy.where("false")).first()[0] == 0


def test_schema_profile(untidy):
    rows = [tuple(r) for r in profile.schema_profile(untidy).orderBy("position").collect()]
    assert rows[1] == (1, "s", "string", 4, 6) and rows[4] == (4, "xs", "array<int>", 3, 6)


def test_describe_texts(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("a", None), ("b", None), (None, None)], "s string, n string")
    rows = {r.column: tuple(r)[1:] for r in profile.describe(df).collect()}
    assert rows == {"s": (4, 2, "a", 2), "n": (0, 0, None, None)}


def _numpy_quantiles(values, probabilities):
    return [float(q) for q in np.quantile(values, probabilities)]


@pytest.mark.parametrize(
    "name, make",
    [
        ("uniform", lambda g: g.uniform(-50, 50, 4000)),
        ("heavy tail", lambda g: np.exp(g.normal(0, 12, 3000)) * g.choice([-1, 1], 3000)),
        ("hot value", lambda g: np.where(g.random(3000) < 0.4, 7.0, g.normal(7, 1e-6, 3000))),
        ("constant", lambda g: np.full(100, 3.0)),
        ("two", lambda g: np.array([1.0, 2.0])),
        ("one", lambda g: np.array([5.0])),
    ],
)
def test_exact_quantiles(spark, name, make):
    values = make(np.random.default_rng(7))
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    rows = exact_quantiles(df, ["x"], probabilities, buckets=16).collect()
    found = {r.probability: r.quantile for r in rows}
    expected = dict(zip(probabilities, _numpy_quantiles(values, probabilities)))
    assert found.keys() == expected.keys()
    for p, q in expected.items():
        assert math.isclose(found[p], q, rel_tol=1e-12, abs_tol=1e-12), (name, p)


def test_describe_numbers(spark):
    values = [3.0, 1.0, None, 10.0, float("nan")]
    df = spark.createDataFrame([(v, i, "t") for i, v in enumerate(values)], "x double, i int, s string")
    rows = {r.column: r for r in profile.describe(df).collect()}
    assert set(rows) == {"x", "i"}
    x, clean = rows["x"], [1.0, 3.0, 10.0]
    assert x["count"] == 3 and x["mean"] == pytest.approx(np.mean(clean))
    assert x["std"] == pytest.approx(np.std(clean, ddof=1))
    assert [x["q25"], x["median"], x["q75"]] == _numpy_quantiles(clean, [0.25, 0.5, 0.75])
    assert (x["min"], x["max"]) == (1.0, 10.0)


def test_describe_of_a_column_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "x double, i int")
    rows = {r.column: r for r in profile.describe(df).collect()}
    assert rows["x"]["count"] == 0 and rows["x"]["median"] is None and rows["i"]["median"] == 1.5


def test_boxplot(spark):
    counts = [1, 2, 2, 3, 3, 3, 4, 4, 30]
    df = spark.createDataFrame([(5.0, " ".join(["w"] * n)) for n in counts], "rating double, comment string")
    row = profile.boxplot_stats(df).first()
    q1, median, q3 = _numpy_quantiles(counts, [0.25, 0.5, 0.75])
    assert (row["count"], row.q1, row.median, row.q3) == (9, q1, median, q3)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 4.0, 1)
    assert [tuple(r) for r in profile.boxplot_outliers(df).collect()] == [(5.0, 30, 1)]


def test_stats_bundle(published):
    rows = profile.stats_bundle(published).collect()
    lines = {(r.metric, r.key): r.value for r in rows}
    assert lines[("count", None)] == 259 and lines[("rating_distribution", "5.0")] == 144
    assert lines[("word_frequency", "x")] == 37 and lines[("total_unique_words", None)] == 6
    assert {m for m, _ in lines} == {
        "count", "avg_length", "median_length", "rating_distribution", "word_frequency", "total_unique_words",
    }


def test_describe_infinities_dots_and_nothing(spark):
    inf = float("inf")
    rows = [(v, None) for v in (-inf, 1.0, 2.0, 3.0, 4.0, inf, inf, inf)]
    df = spark.createDataFrame(rows, "`a.b` double, none double")
    got = {r.column: r for r in profile.describe(df).collect()}
    assert (got["a.b"].q25, got["a.b"].median, got["a.b"].q75) == (1.75, 3.5, inf)
    assert got["none"].asDict() | {"column": "", "count": 0} == dict.fromkeys(got["none"].asDict()) | {"column": "", "count": 0}


def test_describe_texts_that_begin_alike(spark):
    long = "x" * 100
    rows = [(long + "b", None), (long + "a", None), (long + "a", None), (long + "b", None), ("z", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, `n.ull` string")
    got = {r["column"]: tuple(r)[1:] for r in profile.describe(df).collect()}
    assert got == {"t": (5, 3, long + "a", 2), "n.ull": (0, 0, None, None)}
