"""Cleaning."""

from uuid import uuid4

from pyspark.sql import functions as F

from reviewloom.functions import parsing
from reviewloom.operators import clean
from reviewloom.schema import RAW_REVIEWS
from reviewloom.session import shared_folder
from reviewloom.sources.reviews import read_reviews

from .inputs import COMMENT_SQL, DATE_SQL, ISO, RATING_INT_SQL, RATING_SQL, TOKENS, VOTES_SQL, ctes
from .registry import query

_CLEAN = f"""select review_id, title, rating, strftime(date, {ISO}) as date, category, comment, useful
from clean"""


def _dated(df):
    """Dates as text, the same on both engines."""
    return df.withColumn("date", parsing.iso_text(F.col("date")))


@query("clean_reviews", ctes("clean") + _CLEAN)
def clean_reviews(t):
    return _dated(t.clean())


@query(
    "csv_scan",
    ctes("raw") + "select title, rating, date, category, comments as comment, nullif(useful, '') as useful from raw",
)
def csv_scan(t):
    """Writes the reviews as CSV files under their original headers, and reads them.

    In UTF-8: texts may hold characters that Latin-1 has no place for.
    """
    path = f"{shared_folder(t.spark)}/reviews-{uuid4().hex}"
    columns = ["title", "customer_name", "rating", "date", "category", "comments", "useful"]
    named = t.raw().repartition("review_id").select(*columns).toDF(*RAW_REVIEWS.names)
    named.write.options(
        header=True, encoding="UTF-8", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return clean.canonical_names(clean.drop_personal(read_reviews(t.spark, path, encoding="UTF-8")))


# Lines without quotes or newlines; every eleventh has two fields too many, the first empty.
_SURPLUS = "case when doc_id % 11 = 0 then ',,more' else '' end"
_LINE = f"concat('Review ', doc_id, ',cust,', 1 + doc_id % 5, '.0,on 1 May 2018,', source, ',plain,', {_SURPLUS})"


@query(
    "csv_rejects",
    f"""select concat('Review ', doc_id) as title, source as category,
 case when doc_id % 11 = 0 then {_LINE} end as rejected from documents""",
)
def csv_rejects(t):
    """Writes lines of which some have too many fields, and reads them all."""
    path = f"{shared_folder(t.spark)}/lines-{uuid4().hex}"
    lines = t.read("documents").select(F.expr(_LINE).alias(",".join(RAW_REVIEWS.names)))
    lines.write.options(header=True, sep="\u0001", quote="\u0002", encoding="UTF-8").csv(path)
    rows = read_reviews(t.spark, path, multi_line=False, encoding="UTF-8", rejected="rejected")
    return rows.select(F.col("`Review Title`").alias("title"), F.col("Category").alias("category"), "rejected")


@query("dedup_rows", ctes("raw") + "select distinct * from raw")
def dedup_rows(t):
    return clean.drop_duplicate_rows(t.raw())


@query("parse_rating", ctes("raw") + f"select review_id, coalesce({RATING_SQL}, 0) as stars from raw")
def parse_rating(t):
    return t.raw().select("review_id", parsing.rating(F.col("rating")).alias("stars"))


@query("parse_rating_nullable", ctes("raw") + f"select review_id, {RATING_SQL} as stars from raw")
def parse_rating_nullable(t):
    raw = t.raw()
    return raw.select("review_id", clean.numeric_rating(raw).alias("stars"))


@query("parse_rating_int", ctes("raw") + f"select review_id, {RATING_INT_SQL} as stars from raw")
def parse_rating_int(t):
    return t.raw().select("review_id", parsing.rating_whole(F.col("rating")).alias("stars"))


@query("parse_useful", ctes("raw") + f"select review_id, {VOTES_SQL} as votes from raw")
def parse_useful(t):
    return t.raw().select("review_id", parsing.useful_votes(F.col("useful")).alias("votes"))


@query("parse_date", ctes("raw") + f"select review_id, strftime({DATE_SQL}, {ISO}) as day from raw")
def parse_date(t):
    day = parsing.iso_text(parsing.review_date(F.col("date")))
    return t.raw().select("review_id", day.alias("day"))


@query("normalize_comment", ctes("raw") + f"select review_id, {COMMENT_SQL} as comment from raw")
def normalize_comment(t):
    return t.raw().select("review_id", parsing.comment(F.col("comments")).alias("comment"))


@query(
    "text_casts",
    ctes("clean")
    + """select review_id, cast(rating as varchar) as rating, cast(useful as varchar) as useful, category
from clean""",
)
def text_casts(t):
    return clean.as_text(t.clean(), "rating", "useful", "category").select(
        "review_id", "rating", "useful", "category"
    )


@query(
    "word_count_flag",
    ctes("clean")
    + f"""select review_id, cast(len(regexp_extract_all(comment, '{TOKENS}')) as int) as word_count,
 case when useful >= 1 then 1 else 0 end as is_useful from clean""",
)
def word_count_flag(t):
    return clean.enrich(t.clean()).select("review_id", "word_count", "is_useful")


@query(
    "rating_points",
    ctes("clean")
    + f"""select rating, cast(len(regexp_extract_all(comment, '{TOKENS}')) as int) as word_count
from clean""",
)
def rating_points(t):
    return clean.rating_points(t.clean())


@query("head_rows", ctes("clean") + _CLEAN + " order by review_id limit 5")
def head_rows(t):
    return _dated(clean.first_rows(t.clean(), 5, "review_id"))


@query("tail_rows", ctes("clean") + _CLEAN + " order by review_id desc limit 5")
def tail_rows(t):
    return _dated(clean.last_rows(t.clean(), 5, "review_id"))
