"""A text model over a prompt column, with stored answers.

A model call is slow, costs money and may answer differently the second time. So
each distinct prompt is sent once, its answer is written before anything reads it,
and all aggregation works on the written table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import answers
from ..functions.keys import prompt_key
from ..functions.numbers import tally
from ..schema import RESPONSE
from ..session import shared_folder
from ..sources.response_cache import append_responses, current_version, read_responses
from .calls import ListClientFactory, infer_batched
from .clean import require_columns
from .prompts import pack_prompts, with_system_prompt

#: Builds a client inside a task. A client is called with a prompt and returns the
#: answer text, or a mapping with ``content`` and, if known, ``tokens_used``, ``cost``.
ClientFactory = Callable[[], Callable[[str], "str | Mapping"]]


def choose_client(clients: Mapping[str, ClientFactory], provider: str | None):
    """M9: the named provider, or the first configured one: (name, factory)."""
    if not clients:
        raise ValueError("no model clients are configured")
    name = provider if provider in clients else next(iter(clients))
    return name, clients[name]


def infer(
    prompts: DataFrame,
    client_factory: ClientFactory,
    model: str,
    provider: str,
    prompt: str = "prompt",
    keep: tuple[str, ...] = ("prompt_hash",),
) -> DataFrame:
    """One response per row, beside the ``keep`` columns.

    Lazy: every action on the result calls the model again. The client is built once
    per task; rows arrive and leave in Arrow batches. A null prompt is not sent. A
    failing call fails its task, which Spark retries.
    """
    require_columns(prompts, prompt, *keep)
    sent = prompts.select(*keep, prompt)
    schema = StructType([*[sent.schema[name] for name in keep], *RESPONSE.fields])

    def call_model(batches):
        import pandas as pd

        client = client_factory()
        for batch in batches:
            rows = []
            for text in batch[prompt]:
                started = time.perf_counter()
                answer = client(text) if text is not None else None
                seconds = time.perf_counter() - started
                if answer is None or isinstance(answer, str):
                    answer = {"content": answer}
                rows.append(
                    (
                        answer["content"],
                        model,
                        provider,
                        answer.get("tokens_used"),
                        seconds,
                        answer.get("cost"),
                    )
                )
            columns = ["content", "model", "provider", "tokens_used", "response_time", "cost"]
            responses = pd.DataFrame(rows, columns=columns, index=batch.index)
            responses["tokens_used"] = responses["tokens_used"].astype("Int32")
            responses["cost"] = responses["cost"].astype("Float64")
            yield pd.concat([batch[list(keep)], responses], axis=1)

    return sent.mapInPandas(call_model, schema)


def with_prompt_key(
    df: DataFrame, model: str, system_prompt: str | None = None, prompt: str = "prompt"
) -> DataFrame:
    """Final prompt text and its cache key as ``prompt_hash``."""
    keyed = with_system_prompt(df, system_prompt, prompt)
    return keyed.withColumn("prompt_hash", prompt_key(F.lit(model), F.col(prompt)))


def cache_misses(keyed: DataFrame, cache: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Distinct prompts that have no stored answer, as (prompt_hash, prompt).

    Equal prompts collapse before the shuffle, and the grouping key is also the join
    key, so a text moves once at most. Null prompts are dropped after the grouping: a
    filter ahead of it would render every prompt twice.
    """
    distinct = (
        keyed.groupBy("prompt_hash")
        .agg(F.any_value(prompt).alias(prompt))
        .where(F.col(prompt).isNotNull())
    )
    return distinct.join(cache.select("prompt_hash"), "prompt_hash", "left_anti")


def cache_lookup(keyed: DataFrame, cache: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows with the stored answer of their prompt, null when there is none.

    Only the key columns are shuffled, not the prompts. One prompt may belong to a
    large share of the rows: adaptive execution splits such a partition, as nothing
    after the join asks for its partitioning.
    """
    return keyed.select(*keep, "prompt_hash").join(cache, "prompt_hash", "left")


def answers_per_prompt(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """J1 for aggregation: one row per distinct prompt, with ``n_rows`` it stands for.

    Rows are counted per key before the join, so a hot prompt is one row, and each
    answer is parsed once. Feed it to the aggregations with ``weight="n_rows"``.
    """
    counts = (
        keyed.groupBy("prompt_hash")
        .agg(F.count("prompt_hash").alias("n_rows"))
        .where(F.col("n_rows") > 0)
    )
    return counts.join(cache, "prompt_hash", "left")


def unpack_answers(responses: DataFrame, *keep: str) -> DataFrame:
    """M4: one row per packed prompt, as (*keep, prompt_hash, position, content).

    Needs ``keys`` beside the ``content`` of the packed response. Where the array is
    short or the answer is no array, content is null and parses to the fallback.
    """
    require_columns(responses, "keys", "content")
    listed = responses.withColumn("_items", answers.packed_items(F.col("content")))
    exploded = listed.select(
        *keep, "_items", F.posexplode("keys").alias("position", "prompt_hash")
    )
    content = F.get("_items", F.col("position")).alias("content")
    return exploded.select(*keep, "prompt_hash", "position", content)


def share_packed(responses: DataFrame) -> DataFrame:
    """M4: packed responses as one response per prompt, with the fields of M2.

    Seconds are shared out evenly; tokens and cost go with the first prompt, so that
    their sums stay those of the requests.
    """
    shared = responses.withColumn("response_time", F.col("response_time") / F.size("keys"))
    carried = [name for name in RESPONSE.names if name != "content"]
    items = unpack_answers(shared, *carried)
    first = F.col("position") == 0
    return items.withColumns(
        {name: F.when(first, F.col(name)) for name in ("tokens_used", "cost")}
    ).select("prompt_hash", *RESPONSE.names)


def _written(misses: DataFrame) -> DataFrame:
    """The misses in a table, sorted by key so that a reader of a range skips the other pages."""
    spark = misses.sparkSession
    path = f"{shared_folder(spark)}/misses-{uuid4().hex}"
    misses.sortWithinPartitions("prompt_hash").write.parquet(path)
    return spark.read.schema(misses.schema).parquet(path)


def _in_rounds(misses: DataFrame, rounds: int) -> Iterator[DataFrame]:
    """The misses, or equal shares of them by key range, read from a written table."""
    if rounds == 1:
        yield misses
        return
    written = _written(misses)
    # Keys are hexadecimal digests, so their first eight digits are spread evenly.
    bounds = [f"{i * 16**8 // rounds:08x}" for i in range(rounds)]
    key = F.col("prompt_hash")
    for low, high in zip(bounds, [*bounds[1:], None], strict=True):
        yield written.where(key >= low if high is None else (key >= low) & (key < high))


def store_answers(
    keyed: DataFrame,
    cache_path: str,
    client_factory: ClientFactory,
    model: str,
    provider: str,
    tasks: int | None = None,
    prompt: str = "prompt",
    batch_size: int | None = None,
    rounds: int = 1,
    list_client: ListClientFactory | None = None,
    in_flight: int = 8,
) -> DataFrame:
    """Call the model for the prompts not yet stored, and append the answers.

    Runs the job and returns the stored table. ``tasks`` is the number of tasks that call.
    It is fixed rather than left to adaptive execution, which would merge the
    misses by size and so make the calls queue up in a few tasks. ``batch_size`` packs
    that many prompts into one call. ``rounds`` stores the answers in that many steps:
    a job that fails keeps the rounds before, and the next run asks only for the rest.
    With a ``list_client`` each task has up to ``in_flight`` calls in flight, each with
    ``batch_size`` prompts as a list, and prompts that fail are left for the next run.
    """
    spark = keyed.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    version = current_version(spark, cache_path)
    misses = cache_misses(keyed, read_responses(spark, cache_path), prompt)
    for share in _in_rounds(misses, rounds):
        spread = share.repartition(tasks, "prompt_hash")
        if list_client is not None:
            responses = infer_batched(
                spread, list_client, model, provider, prompt, batch_size=batch_size or 1, in_flight=in_flight
            )
        elif batch_size is None:
            responses = infer(spread, client_factory, model, provider, prompt)
        else:
            packed = pack_prompts(share, batch_size, prompt=prompt).repartition(tasks, "batch_id")
            requests = infer(packed, client_factory, model, provider, prompt, keep=("keys",))
            responses = share_packed(requests)
        version = append_responses(responses, cache_path, version)
    return read_responses(spark, cache_path)


def store_packed(
    keyed: DataFrame,
    cache_path: str,
    client_factory: ClientFactory,
    model: str,
    provider: str,
    batch_size: int,
    system_prompt: str | None = None,
    tasks: int | None = None,
    prompt: str = "prompt",
    repeats: int = 1,
    rows_per_bucket: int = 10_000,
) -> DataFrame:
    """Store the answers of prompts sent in packs, and return the stored table.

    ``keyed`` has the prompts without the system prompt, which goes ahead of each request
    once, and keys that include it. The misses are written first and counted there. What
    is missing from an array is packed and asked again ``repeats`` times, then one by one.
    """
    spark = keyed.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    for attempt in range(repeats + 2):
        version = current_version(spark, cache_path)
        misses = _written(cache_misses(keyed, read_responses(spark, cache_path), prompt))
        rows = misses.count()
        if not rows:
            break
        if attempt <= repeats:
            packed = pack_prompts(
                misses, batch_size, prompt=prompt, rows_per_bucket=rows_per_bucket, system_prompt=system_prompt, rows=rows
            )
            spread = packed.repartition(tasks, "batch_id")
            responses = share_packed(infer(spread, client_factory, model, provider, prompt, keep=("keys",)))
        else:
            single = with_system_prompt(misses, system_prompt, prompt).repartition(tasks, "prompt_hash")
            responses = infer(single, client_factory, model, provider, prompt)
        append_responses(responses, cache_path, version)
    return read_responses(spark, cache_path)


def cache_stats(keyed: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits, misses, total, hit rate in percent, and number of stored answers."""
    known = stored.select("prompt_hash").distinct().withColumn("stored", F.lit(True))
    counts = answers_per_prompt(keyed, known).agg(
        tally("n_rows", F.col("stored").isNotNull()).alias("hits"),
        tally("n_rows", F.col("stored").isNull()).alias("misses"),
        tally("n_rows").alias("total"),
    )
    rate = F.coalesce(F.try_divide(F.col("hits") * F.lit(100.0), "total"), F.lit(0.0))
    entries = stored.agg(F.count_distinct("prompt_hash")).scalar()
    return counts.withColumn("hit_rate", F.round(rate, 1)).withColumn("cache_size", entries)


def model_timing(responses: DataFrame) -> DataFrame:
    """Calls, mean seconds, tokens and cost per provider and model."""
    return responses.groupBy("provider", "model").agg(
        tally().alias("calls"),
        F.avg("response_time").alias("avg_response_time"),
        F.sum("tokens_used").alias("tokens_used"),
        F.sum("cost").alias("cost"),
    )
