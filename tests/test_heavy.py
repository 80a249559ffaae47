"""Heavy hitters with bounded summaries."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.operators.clean import clean_reviews, drop_duplicate_rows
from reviewloom.operators.heavy import Summary, frequent_words, word_summaries
from reviewloom.operators.words import word_frequency


@given(st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=30), max_size=20), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_counts_are_too_low_by_the_error_at_most(texts, size):
    held, exact = Summary(size), Counter()
    for words in texts:
        held.add(words)
        exact.update(words)
    held.reduce()
    assert len(held.counts) <= size
    for word, n in exact.items():
        assert n - held.error <= held.counts[word] <= n
    # each unit of error took one from more than ``size`` words
    assert held.error * (size + 1) <= sum(exact.values())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows = [" ".join([f"Hot{min(int(rng.expovariate(0.4)), 30)}" for _ in range(8)] + rng.sample(words, 12)) for _ in range(600)]
    return spark.createDataFrame([(t,) for t in [*rows, None, "", "  "]], "comment string").repartition(4)


def test_equal_to_the_whole_count(spark, texts):
    want = word_frequency(texts, k=8).collect()
    for counters in (60, 500, 20_000):
        assert frequent_words(texts, k=8, counters=counters).collect() == want
    assert word_summaries(texts, counters=60).count() <= 4 * 61
    assert frequent_words(texts.limit(0)).count() == 0
    assert frequent_words(texts.limit(1), k=500).count() == texts.limit(1).selectExpr("size(array_distinct(split(comment, ' ')))").first()[0]


def test_too_few_counters_are_told(texts):
    with pytest.raises(ValueError, match="5 counters do not prove"):
        frequent_words(texts, k=30, counters=5)


def test_narrow_cleaning_gives_the_same_rows(tables):
    raw = tables.raw()
    whole = clean_reviews(raw)
    for columns in (["rating"], ["date", "category"], ["review_id", "useful"], ["comment"]):
        narrow = clean_reviews(raw, columns=columns)
        assert narrow.columns == columns and narrow.dtypes == whole.select(*columns).dtypes
        assert narrow.exceptAll(whole.select(*columns)).count() == 0
        assert narrow.count() == whole.count()
    with pytest.raises(ValueError, match="nope"):
        drop_duplicate_rows(raw, ["nope"])


def test_narrow_rows_differ_by_all_columns(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "y", 1), (None, "y", 1), (None, "y", 1), ("a", "x", None)]
    df = spark.createDataFrame(rows, "_digest string, b string, c int")
    assert sorted(map(tuple, drop_duplicate_rows(df, ["_digest", "c"]).collect()), key=str) == sorted(
        [("a", 1), ("a", 1), (None, 1), ("a", None)], key=str
    )
    assert drop_duplicate_rows(df, []).count() == 4
