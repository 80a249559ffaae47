"""Token counts of documents in flat token files that have no index.

A flat file is token identifiers of a fixed width, one document after the other, each
closed by an end-of-document identifier. Files are read as blocks, in which the
identifier is searched for by vector comparison. Documents run over block borders, so
each block only reports its length and where it has identifiers; prefix sums over the
blocks of a file turn that into positions, and the distance of two neighbouring
identifiers is a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import IdTable, ShortTable, task_table
from .common import prepared

#: Bytes of a block.
BLOCK = 1 << 18


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Rows (file, block, data) of the flat files under a path, each of 2 GB at most."""
    prepared(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for i, at in enumerate(range(0, len(content), block)):
                    yield pd.DataFrame({"file": [name], "block": [i], "data": [content[at : at + block]]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cut, "file string, block long, data binary")


def write_blocks(
    df: DataFrame, path: str, eod: int, width: int = 2, block: int = BLOCK, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Token blocks of documents, one flat file per task: (file, block, data, keys).

    ``keys`` are those of the documents whose end was written since the last block, in
    order; they are no index, positions are not known. Null text is no tokens. Ids must
    fit in ``width`` bytes; strings of special tokens are ordinary text, so that only
    document ends give the ``eod``.
    """
    if width not in (2, 4):
        raise ValueError("ids have 2 or 4 bytes")
    prepared(df.sparkSession)
    named = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind, dtype = dict(named.dtypes)["k"], f"<u{width}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        table = task_table(ShortTable if width == 2 else IdTable, path, True)
        end, name = np.array([eod], dtype=dtype).tobytes(), str(TaskContext.get().partitionId())
        buffer, keys, number = bytearray(), [], 0
        for batch in batches:
            for k, ids in zip(batch["k"], table.ids(batch["t"].tolist())):
                buffer += ids + end
                keys.append(None if pd.isna(k) else k)
                while len(buffer) >= block:
                    yield pd.DataFrame({"file": [name], "block": [number], "data": [bytes(buffer[:block])], "keys": [keys]})
                    del buffer[:block]
                    keys, number = [], number + 1
        if buffer or keys:
            yield pd.DataFrame({"file": [name], "block": [number], "data": [bytes(buffer)], "keys": [keys]})

    return named.mapInPandas(work, f"file string, block long, data binary, keys array<{kind}>")


def count_tokens(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """Rows (file, ordinal, n_tokens, ended): the documents of each file, in order.

    ``ordinal`` counts from 0; the ``eod`` is not counted. Tokens after the last ``eod``
    are a document with ``ended`` false. An empty file or table has no documents; null
    data counts as an empty block. Blocks hold whole identifiers and are numbered in
    the order of the file, whatever the numbers. Only positions and lengths leave the
    task that reads a block.
    """
    dtype = f"<u{width}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = []
            for data in batch["data"]:
                tokens = np.frombuffer(data or b"", dtype)
                ends.append((len(tokens), np.flatnonzero(tokens == eod)))
            yield pd.DataFrame(
                {"file": batch["file"], "block": batch["block"], "size": [n for n, _ in ends], "at": [a for _, a in ends]}
            )

    found = blocks.select("file", "block", "data").mapInPandas(
        scan, "file string, block long, size long, at array<long>"
    )
    # one row per block from here; the positions go along as an array
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn(
        "first", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0))
    )
    placed = placed.withColumn("last", F.expr("case when size(at) > 0 then base + element_at(at, -1) end"))
    placed = placed.withColumn("prior", F.coalesce(F.max("last").over(before), F.lit(-1)))
    each = F.expr(
        "transform(at, (x, i) -> struct(first + i as ordinal,"
        " base + x - if(i = 0, prior, base + at[i - 1]) - 1 as n_tokens, true as ended))"
    )
    closed = placed.select("file", F.inline(each))
    totals = placed.groupBy("file").agg(
        F.sum(F.size("at")).alias("ordinal"), F.sum("size").alias("total"), F.coalesce(F.max("last"), F.lit(-1)).alias("last")
    )
    rest = totals.where("total - last - 1 > 0").select(
        "file", "ordinal", F.expr("total - last - 1").alias("n_tokens"), F.lit(False).alias("ended")
    )
    return closed.union(rest)


def document_order(blocks: DataFrame, key: str) -> DataFrame:
    """Rows (file, ordinal, key) from the keys that ``write_blocks`` noted."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("file", "block", "keys").withColumn(
        "first", F.coalesce(F.sum(F.size("keys")).over(before), F.lit(0))
    )
    return first.select("file", "first", F.posexplode("keys").alias("i", key)).select(
        "file", F.expr("first + i").alias("ordinal"), key
    )
