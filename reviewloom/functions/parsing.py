"""Cleaning expressions for ratings, votes, dates and comments.

Raw text never raises: casts are ``try_`` forms, since ANSI mode is on by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, strip

# The shapes of the texts in a review file.
NUMBER = r"\d+(?:\.\d+)?"  # "4.0 out of 5 stars"
WHOLE_NUMBER = r"\d+"  # "7 people found this helpful"
ONE_PERSON = rf"one[{SPACE_CLASS}]+person[^\n]*"  # "One person found this helpful"
LONG_DATE = rf"on[{SPACE_CLASS}]+\d{{1,2}}[{SPACE_CLASS}]+[a-z]+[{SPACE_CLASS}]+\d{{4}}"
LONG_DATE_FORMAT = "'on' d MMMM yyyy"  # "on 1 October 2018"
# ---- end of fixed values


def _first(text: Column, pattern: str) -> Column:
    """first match, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def rating(text: Column, missing: float | None = 0.0) -> Column:
    """First number in the text; ``missing=None`` keeps null."""
    value = _first(text.cast("string"), NUMBER).try_cast("double")
    return value if missing is None else F.coalesce(value, F.lit(float(missing)))


def rating_whole(text: Column) -> Column:
    """First whole number only, so "4.5" gives 4."""
    return _first(text.cast("string"), WHOLE_NUMBER).try_cast("double")


def useful_votes(text: Column) -> Column:
    """Number of helpful votes; "one person" is 1, nothing is 0."""
    digits = F.regexp_replace(F.lower(text.cast("string")), ONE_PERSON, "1")
    return F.coalesce(_first(digits, WHOLE_NUMBER).try_cast("bigint"), F.lit(0).cast("bigint"))


def review_date(text: Column) -> Column:
    """C10, F5: "on D Month YYYY" anywhere in the text; anything else is null."""
    found = _first(F.lower(text.cast("string")), LONG_DATE)
    return F.try_to_timestamp(
        F.regexp_replace(found, f"[{SPACE_CLASS}]+", " "), F.lit(LONG_DATE_FORMAT)
    )


def comment(text: Column) -> Column:
    """C11: stripped and lower-cased."""
    return F.lower(strip(text))


def is_useful(votes: Column) -> Column:
    """1 from one vote on, else 0."""
    return F.when(votes >= 1, 1).otherwise(0)


def iso_text(moment: Column) -> Column:
    """ISO 8601 text of a timestamp, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
