"""U4: aggregates by name. An unknown name is an error."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ..operators import profile, sentiment, words
from ..operators.clean import lower_headers

STATISTICS: Mapping[str, Callable[[DataFrame, str], DataFrame]] = {
    "count": lambda df, column: profile.row_count(df),
    "avg_length": profile.column_length,
    "word_frequency": words.word_frequency,
    "rating_distribution": lambda df, column: profile.rating_distribution(df),
}

SENTIMENT_AGGREGATIONS: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "summary": sentiment.sentiment_summary,
    "distribution": sentiment.confidence_buckets,
    "trends": sentiment.polarity_trend,
}

INSIGHT_TYPES = ("recommendations", "trends", "priorities")


def _named(table, name: str, kind: str):
    if name not in table:
        raise ValueError(f"unknown {kind}: {name}; known: {', '.join(table)}")
    return name


def statistic(df: DataFrame, metric: str, column: str = "comment") -> DataFrame:
    """A statistic of a review table; headers may be in any case."""
    _named(STATISTICS, metric, "metric")
    return STATISTICS[metric](lower_headers(df), column)


def aggregate_sentiment(answers: DataFrame, aggregation: str) -> DataFrame:
    """An aggregation over parsed sentiment answers."""
    _named(SENTIMENT_AGGREGATIONS, aggregation, "aggregation type")
    return SENTIMENT_AGGREGATIONS[aggregation](answers)


def insight_type(name: str) -> str:
    """The name itself when it is a known kind of report."""
    return _named(INSIGHT_TYPES, name, "insight type")
