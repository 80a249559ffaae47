"""Reading model answers: code fences, JSON objects, packed JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..schema import SENTIMENT_ANSWER, TOPIC_ANSWER
from .text import strip

# The answer that stands in for one that cannot be read, and the
# code fence that models put around JSON.
FALLBACK_SENTIMENT = "neutral"
FALLBACK_CONFIDENCE = 0.5
FALLBACK_REASONING = "Parse error"
FENCE = "```"
JSON_FENCE = "```json"
# ---- end of fixed values

_STRICT = {"allowSingleQuotes": "false"}


def strip_fences(content: Column) -> Column:
    """take a code fence off an answer that starts with one."""
    text = strip(content)

    def without(opening: str) -> Column:
        body = F.replace(text, F.lit(opening + "\n"), F.lit(""))
        return strip(F.replace(body, F.lit(FENCE), F.lit("")))

    return (
        F.when(F.startswith(text, F.lit(JSON_FENCE)), without(JSON_FENCE))
        .when(F.startswith(text, F.lit(FENCE)), without(FENCE))
        .otherwise(text)
    )


def object_list(content: Column, schema: StructType) -> Column:
    """the answer's JSON object as the only element of an array.

    Empty, null or longer when the answer is not exactly one object. A parser that is
    handed bare text stops after the first value and gives a struct of nulls for text
    that is no object; in brackets, both show.
    """
    wrapped = F.concat(F.lit("["), strip_fences(content), F.lit("]"))
    return F.from_json(wrapped, ArrayType(schema), _STRICT)


def with_sentiment_answer(df: DataFrame, content: str, into: str) -> DataFrame:
    """M5: add the sentiment struct of an answer, or the neutral fallback.

    In two steps, so that the text is parsed once although its list is used twice.
    """
    fallback = F.struct(
        F.lit(FALLBACK_SENTIMENT).alias("sentiment"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        F.lit(FALLBACK_REASONING).alias("reasoning"),
        F.lit(None).cast("array<string>").alias("key_emotions"),
    )
    listed = df.withColumn(into, object_list(F.col(content), SENTIMENT_ANSWER))
    answer = F.when(F.size(into) == 1, F.get(into, F.lit(0)))
    return listed.withColumn(into, F.coalesce(answer, fallback))


def with_topic_list(df: DataFrame, content: str, into: str) -> DataFrame:
    """M6: add a list of one topic struct; null when the answer cannot be read."""
    listed = df.withColumn(into, object_list(F.col(content), TOPIC_ANSWER))
    return listed.withColumn(into, F.when(F.size(into) == 1, F.col(into)))


def packed_items(content: Column) -> Column:
    """M4: elements of a JSON array answer, each as JSON text."""
    return F.from_json(strip_fences(content), ArrayType(StringType()), _STRICT)


def items(values: Column) -> Column:
    """an array, empty when it is missing."""
    return F.coalesce(values, F.array().cast("array<string>"))
