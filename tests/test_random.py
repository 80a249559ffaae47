"""Text and key expressions against plain Python on random Unicode."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import text as textfn
from reviewloom.functions.keys import row_key

ALPHABET = [
    *textfn.WHITESPACE,
    *"abzAZéÉñçãüßÿ÷×áúûùΣσςжЖ日本ﬁ_-.,!?0179٣५²½Ⅷ́​᠎😀",
    *"  \n\t",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    made = ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 24))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(made)), "i int, c string").repartition(4)
    row = df.select(
        "i",
        textfn.strip(F.col("c")).alias("strip"),
        textfn.tokens(F.col("c")).alias("tokens"),
        textfn.word_count(F.col("c")).alias("word_count"),
        textfn.letter_words(F.col("c")).alias("letter_words"),
        textfn.digit_runs(F.col("c")).alias("digit_runs"),
        F.length("c").alias("length"),
    )
    return made, {r.i: r for r in row.collect()}


@pytest.mark.parametrize(
    "name, expected",
    [
        ("strip", lambda t: t.strip()),
        ("tokens", lambda t: t.lower().split()),
        ("word_count", lambda t: len(t.split())),
        ("letter_words", lambda t: re.findall(r"\b[a-zá-ú]+\b", t.lower())),
        ("digit_runs", lambda t: re.findall(r"\d+", t)),
        ("length", len),
    ],
)
def test_text_functions(texts, name, expected):
    made, found = texts
    wrong = [(t, found[i][name], expected(t)) for i, t in enumerate(made) if found[i][name] != expected(t)]
    assert wrong[:3] == []


def test_row_key_tells_rows_apart(spark):
    """Values are chosen so that joined texts of different rows could look the same."""
    rng = random.Random(5)
    values = [None, "", "-", "1:", "1:a", "a", "a|1:a", "|", "0:"]
    rows = [(rng.choice(values), rng.choice(values), rng.choice([None, 0.0, -0.0, 1.5])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string, d double")
    assert df.select(row_key(df)).distinct().count() == df.distinct().count()
