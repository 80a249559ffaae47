"""Prompts as a text column: templates, system prompts, packed requests."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import require_columns

# Prompt texts. They are part of the cache key, so every character
# counts, indentation included.
SENTIMENT_PROMPT = """Analyze the sentiment of this customer feedback:

                    Customer Review: {feedback}

                    Provide a JSON response with:
                        - sentiment: "positive", "negative", or "neutral"
                        - confidence: 0.0 to 1.0
                        - reasoning: brief explanation
                        - key_emotions: list of detected emotions

                    Response:"""

TOPIC_PROMPT = """Extract key topics and themes from this customer comment:

                    Comment: {comment}

                    Identify:
                        - main_topics: primary subjects discussed
                        - product_aspects: specific features/aspects mentioned
                        - issues: problems or complaints raised
                        - praise: positive aspects highlighted

                    Format as JSON:"""

SUMMARY_PROMPT = """Create a business summary from these customer insights:

            Data Summary: {data_summary}
            Sentiment Analysis: {sentiment_results}
            Topic Analysis: {topic_results}

            Generate:
                    1. Executive Summary (2-3 sentences)
                    2. Key Findings (3-5 bullet points)
                    3. Actionable Recommendations (3-4 specific actions)
                    4. Priority Issues (ranked by impact)

            Format as structured business report:"""

PACKED_HEADING = "Process the following items and return results as a JSON array:\n\n"
# ---- end of fixed values


def render(df: DataFrame, template: str, into: str = "prompt", **columns: str) -> DataFrame:
    """M1: fill a template from columns, given as variable=column name.

    A variable without a column, or a column that is not there, is an error while
    the plan is built.
    """
    parts = []
    for literal, variable, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if variable is not None:
            if variable not in columns:
                raise ValueError(f"missing required variable: {variable}")
            require_columns(df, columns[variable])
            parts.append(F.col(columns[variable]).cast("string"))
    return df.withColumn(into, F.concat(*parts))


def with_system_prompt(df: DataFrame, system_prompt: str | None, prompt: str = "prompt") -> DataFrame:
    """M8: put a system prompt in front, before the key is taken."""
    if not system_prompt:
        return df
    return df.withColumn(prompt, F.concat(F.lit(system_prompt + "\n\n"), F.col(prompt)))


def pack_prompts(
    prompts: DataFrame,
    batch_size: int = 5,
    key: str = "prompt_hash",
    prompt: str = "prompt",
    rows_per_bucket: int = 10_000,
    system_prompt: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """M3: up to ``batch_size`` prompts per numbered request.

    Gives (batch_id, keys, prompt), where ``keys`` are the packed prompts' keys in
    the order of their numbers. ``key`` is a hexadecimal digest, one per row. Rows
    are numbered inside buckets of about ``rows_per_bucket``, so no task numbers the
    whole table; the number of buckets follows the row count, which is counted by a
    subquery if ``rows`` does not give it. A system prompt is put once ahead of a request.
    """
    require_columns(prompts, key, prompt)
    counted = prompts.agg(F.count(F.lit(1))).scalar() if rows is None else F.lit(rows)
    buckets = F.ceil(counted / rows_per_bucket)
    heading = (system_prompt + "\n\n" if system_prompt else "") + PACKED_HEADING
    bucket = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), buckets)
    in_bucket = Window.partitionBy("bucket").orderBy(key)
    numbered = (
        prompts.select(key, prompt, bucket.alias("bucket"))
        .withColumn("place", F.row_number().over(in_bucket) - 1)
        .withColumn("batch", F.floor(F.col("place") / batch_size).cast("bigint"))
    )
    item = F.struct("place", F.col(key).alias("key"), F.col(prompt).alias("text"))
    lines = F.transform(
        F.col("items"),
        lambda row, i: F.concat((i + 1).cast("string"), F.lit(". "), row["text"], F.lit("\n")),
    )
    return (
        numbered.groupBy("bucket", "batch")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            F.concat_ws("-", "bucket", "batch").alias("batch_id"),
            F.transform("items", lambda row: row["key"]).alias("keys"),
            F.concat(F.lit(heading), F.array_join(lines, "")).alias(prompt),
        )
    )
