"""Aggregation of sentiment answers.

Every function takes rows with the fields of a sentiment answer (``sentiment``,
``confidence``, ``key_emotions``). ``weight`` names a column that tells for how many
reviews a row stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.numbers import percentage, tally
from ..functions.text import preview
from .prompts import SENTIMENT_PROMPT, render
from .ranking import explode_items, item_counts, top_k_per_group

# Labels, confidence limits and bucket names.
POSITIVE, NEGATIVE, NEUTRAL = "positive", "negative", "neutral"
HIGH_CONFIDENCE = 0.8
MEDIUM_CONFIDENCE = 0.6
BUCKETS = [
    "high_confidence_positive",
    "medium_confidence_positive",
    "low_confidence_positive",
    "high_confidence_negative",
    "medium_confidence_negative",
    "low_confidence_negative",
    "neutral",
]
IMPROVING, DECLINING, STABLE = "improving", "declining", "stable"
SUMMARY_SENTENCE = "Analyzed %d comments: %d positive, %d negative, %d neutral"
# ---- end of fixed values


def parse_sentiments(df: DataFrame, content: str = "content") -> DataFrame:
    """M5: replace the answer text by the fields of its sentiment struct."""
    parsed = answers.with_sentiment_answer(df, content, "_answer")
    return parsed.select(*[c for c in df.columns if c != content], "_answer.*")


def _confidence() -> Column:
    return F.coalesce(F.col("confidence"), F.lit(0.0))


def _compare(positive: Column, negative: Column, if_more, if_less, if_equal) -> Column:
    return (
        F.when(positive > negative, F.lit(if_more))
        .when(negative > positive, F.lit(if_less))
        .otherwise(F.lit(if_equal))
    )


def _summary(df: DataFrame, weight: str | None, neutral: Column | None) -> DataFrame:
    confidence = _confidence() if weight is None else _confidence() * F.col(weight)
    counts = df.agg(
        tally(weight).alias("total_comments"),
        tally(weight, F.col("sentiment") == POSITIVE).alias("positive_count"),
        tally(weight, F.col("sentiment") == NEGATIVE).alias("negative_count"),
        tally(weight, F.col("sentiment") == NEUTRAL).alias("neutral_count"),
        F.coalesce(F.sum(confidence), F.lit(0.0)).alias("confidence"),
    )
    if neutral is not None:
        counts = counts.withColumn("neutral_count", neutral)
    total = F.col("total_comments")
    mean = F.coalesce(F.try_divide("confidence", total), F.lit(0.0))
    shown = ["total_comments"]
    for label in (POSITIVE, NEGATIVE, NEUTRAL):
        count = F.col(f"{label}_count")
        shown += [count, percentage(count, total).alias(f"{label}_percentage")]
    return counts.select(
        *shown,
        F.round(mean, 3).alias("average_confidence"),
        _compare(
            F.col("positive_count"), F.col("negative_count"), POSITIVE, NEGATIVE, NEUTRAL
        ).alias("overall_sentiment"),
    )


def sentiment_summary(df: DataFrame, weight: str | None = None) -> DataFrame:
    """A1, A3: counts of the three exact labels, percentages of all rows."""
    return _summary(df, weight, None)


def sentiment_summary_residual(df: DataFrame, weight: str | None = None) -> DataFrame:
    """A2, A3: whatever is neither positive nor negative is neutral."""
    rest = F.col("total_comments") - F.col("positive_count") - F.col("negative_count")
    return _summary(df, weight, rest)


def confidence_buckets(df: DataFrame, weight: str | None = None) -> DataFrame:
    """A4: (bucket, count) with all seven buckets, empty ones too."""
    high = _confidence() >= HIGH_CONFIDENCE
    medium = ~high & (_confidence() >= MEDIUM_CONFIDENCE)
    low = ~high & ~medium
    label = F.coalesce(F.col("sentiment"), F.lit(NEUTRAL))
    conditions = [
        *[(label == POSITIVE) & level for level in (high, medium, low)],
        *[(label == NEGATIVE) & level for level in (high, medium, low)],
        ~label.isin(POSITIVE, NEGATIVE),
    ]
    row = df.agg(
        *[tally(weight, when).alias(name) for name, when in zip(BUCKETS, conditions, strict=True)]
    )
    return row.unpivot([], BUCKETS, "bucket", "count")


def polarity_trend(df: DataFrame, weight: str | None = None) -> DataFrame:
    """A5: which of the two percentages is larger."""
    share = [F.col(f"{label}_percentage") for label in (POSITIVE, NEGATIVE)]
    return sentiment_summary(df, weight).select(
        _compare(*share, IMPROVING, DECLINING, STABLE).alias("trend"), *share
    )


def _felt(*labels: str) -> Column:
    """Emotions of the answers with these labels, none for the others.

    Not a filter on the label, which would be moved below the parsing of the answers
    and parse them twice.
    """
    return F.when(F.col("sentiment").isin(*labels), answers.items(F.col("key_emotions")))


def top_emotions(df: DataFrame, k: int = 5, weight: str | None = None) -> DataFrame:
    """The k most frequent emotions of positive and of negative answers."""
    carried = [weight] if weight else []
    emotions = explode_items(df, _felt(POSITIVE, NEGATIVE), "emotion", "sentiment", *carried)
    counts = emotions.groupBy("sentiment", "emotion").agg(tally(weight).alias("count"))
    return top_k_per_group(counts, "sentiment", "emotion", k)


def emotion_counts(df: DataFrame, first_seen: list[str], label: str = POSITIVE) -> DataFrame:
    """Emotions of one polarity with their first appearance, for ties by order."""
    return item_counts(df, _felt(label), "emotion", first_seen=first_seen)


def summary_prompt(summary: DataFrame) -> DataFrame:
    """The summary as a sentence, inside a sentiment prompt, and its preview."""
    sentence = F.format_string(
        SUMMARY_SENTENCE, "total_comments", "positive_count", "negative_count", "neutral_count"
    )
    prompts = render(
        summary.withColumn("feedback_summary", sentence),
        SENTIMENT_PROMPT,
        feedback="feedback_summary",
    )
    return prompts.select(
        "feedback_summary", "prompt", preview(F.col("prompt")).alias("prompt_preview")
    )
