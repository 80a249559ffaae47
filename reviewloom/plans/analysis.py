"""The full analysis of a review table."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, fields
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile, sentiment, topics
from ..operators.clean import clean_reviews, first_rows, require_rows
from ..operators.inference import (
    ClientFactory,
    answers_per_prompt,
    choose_client,
    store_answers,
    store_packed,
    with_prompt_key,
)
from ..operators.prompts import SENTIMENT_PROMPT, TOPIC_PROMPT, render
from ..sources.sinks import write_json, write_report
from .report import generate_report, report_prompt


# Names of the results and of the run's metadata.
METADATA = ("analysis_time_seconds", "primary_llm", "available_providers", "timestamp")


@dataclass
class Analysis:
    """Results, each a DataFrame over written tables: reading one calls no model."""

    data_summary: DataFrame  # one row
    statistics: DataFrame  # (metric, key, value)
    sentiment_analysis: DataFrame  # one row
    topic_extraction: DataFrame  # one row
    final_summary: DataFrame  # one row
    metadata: DataFrame  # one row


# ---- end of fixed values


def _written(df: DataFrame, path: str) -> DataFrame:
    """The frame, computed once into a table and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sentiment_prompts(clean: DataFrame, model: str, system_prompt: str | None = None) -> DataFrame:
    """Reviews with their sentiment prompt and its key."""
    return with_prompt_key(render(clean, SENTIMENT_PROMPT, feedback="comment"), model, system_prompt)


def topic_prompts(clean: DataFrame, model: str, system_prompt: str | None = None) -> DataFrame:
    """Reviews with their topic prompt and its key."""
    return with_prompt_key(render(clean, TOPIC_PROMPT, comment="comment"), model, system_prompt)


def analyze(
    reviews: DataFrame,
    work_dir: str,
    clients: Mapping[str, ClientFactory],
    model: str,
    provider: str | None = None,
    first_n: int | None = None,
    order: tuple[str, ...] = ("date", "comment"),
    insight_type: str = "recommendations",
    system_prompt: str | None = None,
    tasks: int | None = None,
    rounds: int = 1,
    batch_size: int | None = None,
    rows_per_bucket: int = 10_000,
) -> Analysis:
    """Clean, profile, sentiment, topics, report.

    ``work_dir`` is a folder shared by the executors: it takes the tables of this run
    and the answers of all runs. ``first_n`` bounds how many reviews, in
    ``order``, go to the model; all of them by default. ``tasks`` and ``rounds`` are
    those of ``store_answers``. ``batch_size`` packs that many prompts of a kind into a
    request with the system prompt ahead of it once, and what an answer lacks is asked
    again; keys stay those of single prompts, so answers stored either way serve both.
    """
    started, run = time.time(), uuid4().hex
    provider, factory = choose_client(clients, provider)
    cache_path = f"{work_dir}/responses"
    # The deduplication is the one wide shuffle of the analysis. Read from the written
    # table, every later step takes its own columns only and survives lost executors.
    clean = _written(clean_reviews(reviews), f"{work_dir}/clean-{run}")
    require_rows(clean)

    asked = first_rows(clean, first_n, *order)
    by_sentiment = sentiment_prompts(asked, model, system_prompt)
    by_topic = topic_prompts(asked, model, system_prompt)
    if batch_size is None:
        # Both kinds of prompt go out in one job: a slow call of one does not idle the other.
        both = by_sentiment.select("prompt_hash", "prompt").unionByName(
            by_topic.select("prompt_hash", "prompt")
        )
        stored = store_answers(both, cache_path, factory, model, provider, tasks, rounds=rounds)
    else:
        for kind, keyed in (("feedback", by_sentiment), ("comment", by_topic)):
            template = {"feedback": SENTIMENT_PROMPT, "comment": TOPIC_PROMPT}[kind]
            bare = render(keyed.select("comment", "prompt_hash"), template, **{kind: "comment"})
            stored = store_packed(
                bare.select("prompt_hash", "prompt"), cache_path, factory, model, provider, batch_size,
                system_prompt, tasks, rows_per_bucket=rows_per_bucket,
            )

    sentiments = sentiment.parse_sentiments(answers_per_prompt(by_sentiment, stored))
    topic_rows = topics.parse_topics(answers_per_prompt(by_topic, stored))
    # Written once: the report reads the summaries, and so does the caller.
    summaries = _one_row(
        data_summary=profile.data_summary_row(clean),
        sentiment_analysis=sentiment.sentiment_summary_residual(sentiments, "n_rows"),
        topic_extraction=topics.topic_summary(topic_rows, weight="n_rows"),
    )
    summaries = _written(summaries, f"{work_dir}/summaries-{run}")
    data_summary, sentiment_row, topic_row = (
        summaries.select(f"{name}.*") for name in summaries.columns
    )
    report = generate_report(
        report_prompt(data_summary, sentiment_row, topic_row),
        f"{work_dir}/report-responses",
        factory,
        model,
        provider,
        insight_type,
    )

    # Counts, lengths and ratings are in the summary: only the words need the reviews.
    statistics = profile.summary_statistics(data_summary).unionByName(
        profile.word_statistics(clean)
    )
    statistics = _written(statistics, f"{work_dir}/statistics-{run}")
    values = (
        F.lit(round(time.time() - started, 2)),
        F.lit(provider),
        F.array(*[F.lit(name) for name in clients]),
        F.lit(time.strftime("%Y-%m-%d %H:%M:%S")),
    )
    metadata = clean.sparkSession.range(1).select(*[v.alias(n) for v, n in zip(values, METADATA, strict=True)])
    return Analysis(
        data_summary=data_summary,
        statistics=statistics,
        sentiment_analysis=sentiment_row,
        topic_extraction=topic_row,
        final_summary=report,
        metadata=metadata,
    )


def _one_row(**parts: DataFrame) -> DataFrame:
    """One-row frames side by side, each as a struct under its name.

    All but the first come in as scalar subqueries, so there is no join.
    """
    (first, frame), *others = parts.items()
    return frame.select(
        F.struct("*").alias(first),
        *[part.select(F.struct("*")).scalar().alias(name) for name, part in others],
    )


def save_results(analysis: Analysis, folder: str) -> tuple[str, str]:
    """All results as one JSON row, and the report as text; gives the paths."""
    lines = F.sort_array(F.collect_list(F.struct("metric", "key", "value")))
    parts = {f.name: getattr(analysis, f.name) for f in fields(analysis)}
    parts["statistics"] = analysis.statistics.agg(lines.alias("lines"))
    return write_json(_one_row(**parts), folder), write_report(analysis.final_summary, folder)
