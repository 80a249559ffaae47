"""C1 to C19, L2, L3."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import parsing
from reviewloom.functions import text as textfn
from reviewloom.operators import clean
from reviewloom.schema import CLEAN_REVIEWS, RAW_REVIEWS

RAW = [
    ("Good", "Ann", "4.0 out of 5 stars", "on 1 October 2018", "Camera", "  Nice Phone ", "7 people found this helpful"),
    ("Good", "Ann", "4.0 out of 5 stars", "on 1 October 2018", "Camera", "  Nice Phone ", "7 people found this helpful"),
    ("Good", "Bob", "4.0 out of 5 stars", "on 1 October 2018", "Camera", "  Nice Phone ", "7 people found this helpful"),
    ("Bad", "Cid", "no rating", "on 15 September 2018", "Battery", "\tDies ", None),
    ("Gone", "Dan", "1.0 out of 5 stars", "2018-10-01", "Battery", "no date", ""),
    ("Void", "Eve", "1.0 out of 5 stars", "on 2 May 2018", "Battery", None, ""),
    ("Mute", "Flo", None, "on 3 May 2018", None, "   ", "One person found this helpful"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, RAW_REVIEWS)


def test_rating(column):
    texts = ["4.0 out of 5 stars", "4.5 out of 5", "no rating", None, "3", "", "top 10.25.3", "4.", "٤"]
    assert column(parsing.rating, texts) == [4.0, 4.5, 0.0, 0.0, 3.0, 0.0, 10.25, 4.0, 0.0]
    kept = column(lambda c: parsing.rating(c, missing=None), texts)
    assert kept == [4.0, 4.5, None, None, 3.0, None, 10.25, 4.0, None]


def test_rating_whole_part(column):
    assert column(parsing.rating_whole, ["4.5 out of 5", "none", None]) == [4.0, None, None]


def test_rating_kept_when_already_a_number(spark):
    df = spark.createDataFrame([(4.5,), (None,)], "rating double")
    assert [r[0] for r in df.select(clean.numeric_rating(df)).collect()] == [4.5, None]


def test_useful(column):
    texts = [
        "7 people found this helpful",
        "One person found this helpful",
        "",
        None,
        "helpful",
        "ONE PERSON, not 12",
        "one person\nand 3 more",
        "3 and one person",
        "99999999999 people",
        "9" * 30,
    ]
    assert column(parsing.useful_votes, texts) == [7, 1, 0, 0, 0, 1, 1, 3, 99999999999, 0]


def test_date(column):
    texts = [
        "on 1 October 2018",
        "ON 15 september 2018",
        "London 1 May 2018x",
        "on 1\t october\n2018",
        "on 01 may 20189",
        "on 31 February 2018",
        "on 29 february 2020",
        "on 1 oct 2018",
        "on 1 sept 2018",
        "2023-01-01",
        "",
        None,
    ]
    day = datetime
    assert column(parsing.review_date, texts) == [
        day(2018, 10, 1),
        day(2018, 9, 15),
        day(2018, 5, 1),
        day(2018, 10, 1),
        day(2018, 5, 1),
        None,
        day(2020, 2, 29),
        *[None] * 5,
    ]


def test_comment_strips_every_kind_of_whitespace(column):
    texts = ["\tA b ", "   ", "", None, "x ", "\x1cY\x85", "ÀÉ　", "a​"]
    expected = [t if t is None else t.strip().lower() for t in texts]
    assert column(parsing.comment, texts) == expected


def test_whitespace_set_is_the_one_of_str_isspace():
    every = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert set(textfn.WHITESPACE) == every


def test_word_count(column):
    texts = ["a b  c", " x ", "", None, "a b\x1cc d", "one\ntwo"]
    expected = [None if t is None else len(t.split()) for t in texts]
    assert column(textfn.word_count, texts) == expected


def test_headers(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["Review Title", "Customer name", "Useful"])
    assert clean.lower_headers(df).columns == ["review_title", "customer_name", "useful"]
    assert clean.canonical_names(df).columns == ["title", "Customer name", "useful"]
    assert clean.drop_personal(df).columns == ["Review Title", "Useful"]
    assert df.columns == ["Review Title", "Customer name", "Useful"]


def test_duplicates_count_the_customer(raw):
    assert clean.drop_duplicate_rows(raw).count() == len(RAW) - 1
    assert clean.drop_duplicate_rows(clean.drop_personal(raw)).count() == len(RAW) - 2


def test_clean_reviews(raw):
    df = clean.clean_reviews(raw)
    assert {f.name: f.dataType for f in df.schema} == {f.name: f.dataType for f in CLEAN_REVIEWS}
    rows = sorted((r.title, r.rating, r.comment, r.useful, r.category or "") for r in df.collect())
    assert rows == [
        ("Bad", 0.0, "dies", 0, "Battery"),
        ("Good", 4.0, "nice phone", 7, "Camera"),
        ("Good", 4.0, "nice phone", 7, "Camera"),
        ("Mute", 0.0, "", 1, ""),
    ]


def test_clean_reviews_can_drop_missing_ratings(raw):
    assert {r.title for r in clean.clean_reviews(raw, missing_rating=None).collect()} == {"Good"}


def test_cleaning_ignores_missing_columns(spark):
    df = spark.createDataFrame([(" A ", "on 1 May 2018")], ["Comments", "Date"])
    assert clean.clean_reviews(df).columns == ["comment", "date"]


def test_timestamps_are_no_long_dates_and_drop_out(spark):
    df = spark.createDataFrame([("a", datetime(2023, 1, 1), "4.0 out of 5")], ["Comments", "Date", "Rating"])
    assert clean.clean_reviews(df).count() == 0


def test_guards(raw, spark):
    with pytest.raises(ValueError, match="nope"):
        clean.require_columns(raw, "Rating", "nope")
    clean.require_rows(raw)
    with pytest.raises(ValueError, match="no rows"):
        clean.require_rows(raw.where("false"))


def test_text_casts_and_flags(raw):
    df = clean.enrich(clean.clean_reviews(raw))
    flags = {(r.useful, r.is_useful, r.word_count) for r in df.collect()}
    assert flags == {(7, 1, 2), (0, 0, 1), (1, 1, 0)}
    assert dict(clean.as_text(df, "rating", "useful").dtypes)["rating"] == "string"


def test_first_and_last_rows(spark):
    df = spark.range(20)
    assert [r.id for r in clean.first_rows(df, 3, "id").collect()] == [0, 1, 2]
    assert [r.id for r in clean.last_rows(df, 2, "id").collect()] == [19, 18]
    assert clean.first_rows(df, None, "id").count() == 20


def test_row_local_cleaning_accepts_a_stream(raw, spark, tmp_path):
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW_REVIEWS).parquet(str(tmp_path / "in"))
    parsed = clean.drop_incomplete(clean.parse_columns(clean.canonical_names(stream)))
    query = parsed.writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("cleaned").count() == 5
    assert spark.table("cleaned").agg(F.sum("useful")).first()[0] == 22
