"""Small numeric expressions used by several aggregations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, total: Column, digits: int = 2) -> Column:
    """part of total in percent, 0 when there is nothing."""
    share = F.coalesce(F.try_divide(part, total), F.lit(0.0))
    return F.round(share * 100, digits)


def tally(weight: str | None = None, when: Column | None = None) -> Column:
    """Count rows, or sum their weights, over those that meet a condition.

    A weight lets one row stand for many equal ones, so that a table collapsed on
    its hot keys gives the same totals as the full one.
    """
    if when is None:
        total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    elif weight is None:
        total = F.count_if(when)
    else:
        total = F.sum(F.when(when, F.col(weight)).otherwise(0))
    return F.coalesce(total, F.lit(0)).cast("bigint")
