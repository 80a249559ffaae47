"""128-bit keys that stand in for long values in a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    FloatType,
    MapType,
    StringType,
    StructType,
)


def prompt_key(model: Column, prompt: Column) -> Column:
    """cache key of a prompt sent to a model; null for a null prompt."""
    return F.md5(F.concat(model, F.lit(":"), prompt))


def _as_text(column: Column, kind: DataType) -> Column:
    """One text per distinct value of the column's type."""
    if isinstance(kind, (DoubleType, FloatType)):
        column = column + F.lit(0.0)  # -0.0 equals 0.0
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.to_json(column)
    return column.cast("string")


def distinct_key(column: Column, kind: DataType) -> Column:
    """A value to count distinct: long text becomes its digest, the rest stays.

    Texts shorter than a digest stay as they are and so cannot equal one.
    """
    if isinstance(kind, StringType):
        return F.when(F.octet_length(column) < 32, column).otherwise(F.md5(column))
    if isinstance(kind, MapType):
        return F.to_json(column)
    return column


def row_key(df: DataFrame) -> Column:
    """Digest of a whole row; values carry their length, nulls equal nulls."""
    parts = []
    for field in df.schema.fields:
        text = _as_text(F.col(f"`{field.name}`"), field.dataType)
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.md5(F.concat_ws("|", *parts))
