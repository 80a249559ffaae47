"""Cleaning of a review table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.keys import row_key
from ..functions import text as textfn

# Headers of a review file and the names used from there on.
PERSONAL_COLUMNS = ["Customer name", "customer_name"]
CANONICAL_NAMES = {
    "Review Title": "title",
    "Rating": "rating",
    "Date": "date",
    "Category": "category",
    "Comments": "comment",
    "comments": "comment",
    "Useful": "useful",
}
REQUIRED_VALUES = ["rating", "date", "comment"]
# ---- end of fixed values


def require_columns(df: DataFrame, *columns: str) -> None:
    """C17: fail while the plan is built when a column is missing."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}; have {', '.join(df.columns)}")


def require_rows(df: DataFrame) -> None:
    """Fail when the table is empty. Runs a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError("no rows to analyse")


def _on(df: DataFrame, column: str, change) -> DataFrame:
    """Apply a column change when the column is there."""
    return df.withColumn(column, change(F.col(column))) if column in df.columns else df


def drop_duplicate_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Exact duplicates over all columns.

    A hash aggregation on the whole row: copies collapse before the shuffle, so a
    row repeated a billion times reaches a reducer once per map task. With ``columns``
    only those come back, and a 128-bit digest of the whole row, taken where it is read,
    goes through the shuffle in place of the other columns. Rows are still told apart by
    all columns.
    """
    if columns is None:
        return df.dropDuplicates()
    columns = list(columns)
    require_columns(df, *columns)
    digest = "_digest"
    while digest in columns:
        digest += "_"
    names = [f"`{name}`" for name in columns]
    return df.select(row_key(df).alias(digest), *names).dropDuplicates().select(*names)


def drop_personal(df: DataFrame) -> DataFrame:
    """C2."""
    return df.drop(*PERSONAL_COLUMNS)


def canonical_names(df: DataFrame) -> DataFrame:
    """Names not in the map stay."""
    return df.withColumnsRenamed(CANONICAL_NAMES)


def lower_headers(df: DataFrame) -> DataFrame:
    """C4: lower case, underscores for spaces."""
    return df.toDF(*[name.lower().replace(" ", "_") for name in df.columns])


def parse_columns(df: DataFrame, missing_rating: float | None = 0.0) -> DataFrame:
    """C5, C10, C8, C11 on the columns that exist."""
    df = _on(df, "rating", lambda c: parsing.rating(c, missing_rating))
    df = _on(df, "date", parsing.review_date)
    df = _on(df, "useful", parsing.useful_votes)
    return _on(df, "comment", parsing.comment)


def drop_incomplete(df: DataFrame, columns: Iterable[str] = REQUIRED_VALUES) -> DataFrame:
    """Keep rows that have all required values."""
    for name in columns:
        if name in df.columns:
            df = df.where(F.col(name).isNotNull())
    return df


def clean_reviews(
    df: DataFrame, missing_rating: float | None = 0.0, columns: Iterable[str] | None = None
) -> DataFrame:
    """The whole cleaning. Duplicates go first, while the name still counts.

    Name the ``columns`` that are read when those are few: the others, long comments for
    one, then stay out of the shuffle. It gives the same rows, with those columns.

    A comment is missing after cleaning only if it was before, so that test comes
    ahead of the shuffle and costs nothing. Tested at the end, it would be moved there
    by the optimizer together with the cleaning of the text, which would then run on
    every copy and once more on the rows kept.
    """
    if columns is not None:
        columns = list(columns)
        named = canonical_names(df)
        needed = dict.fromkeys([*columns, *(n for n in ("rating", "date") if n in named.columns)])
        narrow = named.transform(drop_incomplete, ["comment"]).transform(drop_duplicate_rows, needed)
        cleaned = narrow.transform(parse_columns, missing_rating).transform(drop_incomplete, ["rating", "date"])
        return cleaned.select(*[f"`{name}`" for name in columns])
    return (
        df.transform(canonical_names)
        .transform(drop_incomplete, ["comment"])
        .transform(drop_duplicate_rows)
        .transform(drop_personal)
        .transform(parse_columns, missing_rating)
        .transform(drop_incomplete, ["rating", "date"])
    )


def numeric_rating(df: DataFrame, column: str = "rating") -> Column:
    """The rating as a number, parsed only when it is text; null stays null."""
    if dict(df.dtypes)[column] == "string":
        return parsing.rating(F.col(column), missing=None)
    return F.col(column).cast("double")


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """C14: cast columns to text."""
    require_columns(df, *columns)
    return df.withColumns({name: F.col(name).cast("string") for name in columns})


def enrich(df: DataFrame) -> DataFrame:
    """Word count of the comment, usefulness flag of the votes."""
    require_columns(df, "comment", "useful")
    return df.withColumns(
        {
            "word_count": textfn.word_count(F.col("comment")),
            "is_useful": parsing.is_useful(F.col("useful")),
        }
    )


def rating_points(df: DataFrame) -> DataFrame:
    """(rating, word count) per review."""
    require_columns(df, "rating", "comment")
    return df.select("rating", textfn.word_count(F.col("comment")).alias("word_count"))


def first_rows(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """L2, L3: the first n rows in key order; all of them for ``n=None``."""
    return df if n is None else df.orderBy(*keys).limit(n)


def last_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """L3: the last n rows in key order."""
    return df.orderBy(*[F.desc(key) for key in keys]).limit(n)
