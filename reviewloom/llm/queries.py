"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import shared_folder

from . import bpe, chat, html_text, jaccard, lexical, neighbours, packing, periodic, quality, substrings, token_counts, warc
from .common import prepared, stored
from .sql import SQL  # noqa: F401

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    RUN[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def word_bpe() -> str:
    """Place of the tokenizer file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: End-of-document id of the flat token files.
END_OF_TEXT = 49407


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), word_bpe())


@query
def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), word_bpe())


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in the flat files that hold them."""
    blocks = token_counts.write_blocks(table(spark, folder, "documents"), word_bpe(), END_OF_TEXT)
    blocks = stored(blocks, "tokens")
    counts = token_counts.count_tokens(blocks, END_OF_TEXT)
    order = token_counts.document_order(blocks, "doc_id")
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


@query
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(rows.union(extra)))


@query
def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Links of 90 % or more between the sets of three-word shingles of all documents."""
    return jaccard.classes(table(spark, folder, "documents"), k=3, num=9, den=10)


@query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("key") % 100 == 0)


@query
def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, folder, "embeddings"))


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), keep=["doc_id"])
    return out.select("doc_id", "bad_odds", "kept")


def periodic_tail(key, words: list[bytes]) -> list[bytes]:
    """The words of a document; for a tenth of the keys, with a tail made to repeat.

    A null key changes nothing.
    """
    crc = zlib.crc32(str(int(key)).encode()) if key is not None and words else 1
    if crc % 10:
        return words
    g, n = crc // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * (-(-(n - start) // period)))[: n - start]


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in all documents."""
    return periodic.runs(table(spark, folder, "documents"), edit=periodic_tail)


@query
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as archives, deduplicated by revisit records, and read back."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.records(table(spark, folder, "pages")), f"{path}/plain")
    warc.deduplicate(spark, f"{path}/plain", f"{path}/deduplicated")
    return warc.digests(spark, f"{path}/deduplicated")


@query
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
