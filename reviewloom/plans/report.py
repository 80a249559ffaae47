"""The report: three one-row results become one prompt, and its answer the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.inference import ClientFactory, cache_lookup, store_answers, with_prompt_key
from ..operators.prompts import SUMMARY_PROMPT, render
from ..session import shared_folder
from .metrics import insight_type as known_insight_type

# Notes that go with a report.
GENERATION_METHOD = "LLM-based generation"
REPORT_MESSAGE = "Final business report generated successfully."
# ---- end of fixed values


def as_json(one_row: DataFrame) -> DataFrame:
    """The single row of a result as JSON text."""
    return one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def report_prompt(data: DataFrame, sentiment: DataFrame, topics: DataFrame) -> DataFrame:
    """Prompt from the one-row data, sentiment and topic summaries.

    The second and third come in as scalar subqueries of the first: no join.
    """
    parts = as_json(data).select(
        F.col("json").alias("data_summary"),
        as_json(sentiment).scalar().alias("sentiment_results"),
        as_json(topics).scalar().alias("topic_results"),
    )
    variables = ("data_summary", "sentiment_results", "topic_results")
    return render(parts, SUMMARY_PROMPT, **{v: v for v in variables}).select("prompt")


def report_chunks(lines: DataFrame, order: list[Column], text: Column, size: int = 1000) -> DataFrame:
    """R1 for any number of lines: rows (chunk, lines, text), ``size`` lines each.

    The lines are dealt by ranges of ``order``, which has to tell them apart, and numbered
    within each range; the counts of the ranges before it give the number in the whole. No
    task sorts more than a range, and no row holds more than a chunk. Null texts are empty;
    no lines give no chunks.
    """
    shared_folder(lines.sparkSession)
    named = lines.select(F.coalesce(text, F.lit("")).alias("text"), F.struct(*order).alias("order"))
    # written, as ranges come from a sample and must not change under the counts
    ranged = named.repartitionByRange("order").withColumn("part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = counts.select("part", before.alias("start"))  # a row per range
    place = F.row_number().over(Window.partitionBy("part").orderBy("order"))
    numbered = ranged.withColumn("place", place).join(F.broadcast(starts), "part")
    number = F.col("start") + F.col("place") - 1
    chunks = numbered.select(number.alias("number"), F.floor(number / size).alias("chunk"), "text").groupBy("chunk")
    kept = F.sort_array(F.collect_list(F.struct("number", "text")))
    return chunks.agg(F.count("*").alias("lines"), F.concat_ws("\n", F.transform(kept, lambda x: x["text"])).alias("text"))


def generate_report(
    prompt: DataFrame,
    cache_path: str,
    client_factory: ClientFactory,
    model: str,
    provider: str,
    insight_type: str = "recommendations",
) -> DataFrame:
    """R2: the prompt's answer, from the store or from one call of the model."""
    known_insight_type(insight_type)
    keyed = with_prompt_key(prompt, model)
    stored = store_answers(keyed, cache_path, client_factory, model, provider, tasks=1)
    answered = cache_lookup(keyed.withColumn("insight_type", F.lit(insight_type)), stored, ("insight_type",))
    return answered.select(
        "insight_type",
        F.col("content").alias("report"),
        F.col("model").alias("model_used"),
        F.col("response_time").alias("response_time_seconds"),
        F.lit(GENERATION_METHOD).alias("generation_method"),
        F.lit(REPORT_MESSAGE).alias("message"),
    )
