"""Packing of tokenized documents into sequences of a fixed size.

Each task keeps a fixed number of open sequences. A document's full lengths go out at
once; its rest goes into the open sequence that it fills best. When none has room, the
fullest is filled with the start of the rest and goes out. What is open at the end of a
task is merged in rounds, each of which joins the open sequences of a few tasks, so no
task ever holds more than a fixed number of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import FlatTable, binary, task_table
from .common import prepared, stored

#: Open sequences of a task, and tasks whose open sequences are merged by one task.
OPEN, FAN_IN = 32, 16
#: Pieces handed to Spark at once.
ROWS_OUT = 4096

PIECES = "length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "grp", "ids"]


class Packer:
    """Open sequences of one task; ``out`` has the rows of those that are full."""

    def __init__(self, size: int, group: int, round_: int):
        self.size, self.group, self.made = size, group, 0
        self.base = (round_ << 56) | (group << 24)
        self.open: list[list] = []  # [filled, [(key, start, doc_tokens, ids), ...]]
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple], keep: bool = False) -> None:
        number, offset = self.base + self.made, 0
        self.made += 1
        for key, start, total, ids in pieces:
            n = len(ids) // 4
            group, left = (self.group, ids) if keep else (-1, None)
            self.out.append((key, start, n, zlib.crc32(ids), total, number, offset, group, left))
            offset += n

    def add(self, key, start: int, total: int, ids: bytes) -> None:
        """Place ids, 4 bytes each, of a document of ``total`` ids from ``start``."""
        size = self.size
        at, n = 0, len(ids) // 4
        while n - at >= size:
            self._emit([(key, start + at, total, ids[4 * at : 4 * (at + size)])])
            at += size
        while at < n:
            need = n - at
            fits = [w for w in self.open if size - w[0] >= need]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < OPEN:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
            take = min(need, size - window[0])
            window[1].append((key, start + at, total, ids[4 * at : 4 * (at + take)]))
            window[0] += take
            at += take
            if window[0] == size:
                self._emit(window[1])
                self.open.remove(window)

    def leave(self) -> None:
        """Rows of the open sequences, with their ids, for the next round."""
        for _, pieces in self.open:
            self._emit(pieces, keep=True)
        self.open = []

    def close(self) -> None:
        """Fill up the open sequences from one another; what is then left of less than a
        sequence goes out in lengths that are powers of two, which need no padding."""
        pieces = [p for _, window in sorted(self.open, key=lambda w: -w[0]) for p in window]
        self.open, rest = [], sum(len(p[3]) // 4 for p in pieces)
        while rest:
            room = min(self.size, 1 << (rest.bit_length() - 1)) if rest < self.size else self.size
            rest -= room
            filled = []
            while room:
                key, start, total, ids = pieces.pop(0)
                take = min(room, len(ids) // 4)
                filled.append((key, start, total, ids[: 4 * take]))
                if 4 * take < len(ids):
                    pieces.insert(0, (key, start + take, total, ids[4 * take :]))
                room -= take
            self._emit(filled)

    def drain(self, least: int = 1) -> Iterator[pd.DataFrame]:
        if len(self.out) >= least:
            yield pd.DataFrame(self.out, columns=_FIELDS)
            self.out = []


def pack(
    df: DataFrame, path: str, eod: int = 2, size: int = 4096, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens, sequence_id, offset): one per piece.

    Each text is its ids and then ``eod``; a null or empty text is the ``eod`` alone. All
    sequences hold ``size`` ids, but for the last ones, whose lengths are powers of two.
    Repeated rows are packed as often as they are there, with null keys too; an empty
    table has no pieces. Other columns are left out. Nothing of the texts is shuffled:
    the pieces are cut where the text is read, only open sequences move.
    """
    spark = prepared(df.sparkSession)
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, start long, {PIECES}, grp long, ids binary"
    named = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        table, end = task_table(FlatTable, path), binary([eod])
        packer = Packer(size, TaskContext.get().partitionId(), 0)
        for batch in batches:
            for k, ids in zip(batch["k"], table.ids(batch["t"].tolist())):
                packer.add(k, 0, len(ids) // 4 + 1, ids + end)
            yield from packer.drain(ROWS_OUT)
        packer.leave()
        yield from packer.drain()

    def again(round_: int, last: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            packer = None
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if packer is None or packer.group != row.grp:
                        if packer is not None:
                            packer.close() if last else packer.leave()
                            yield from packer.drain()
                        packer = Packer(size, row.grp, round_)
                    packer.add(row.key, row.start, row.doc_tokens, row.ids)
                yield from packer.drain(ROWS_OUT)
            if packer is not None:
                packer.close() if last else packer.leave()
                yield from packer.drain()

        return work

    table = stored(named.mapInPandas(first, schema), "pack")
    groups = (table.where("grp >= 0").agg(F.max("grp")).first()[0] or 0) + 1
    whole, round_ = [table.where("grp < 0")], 0
    while True:
        round_ += 1
        groups = -(-groups // FAN_IN)
        left = table.where("grp >= 0").withColumn("grp", F.expr(f"grp div {FAN_IN}"))
        ordered = left.repartition(groups, "grp").sortWithinPartitions("grp", "sequence_id", "offset")
        table = ordered.mapInPandas(again(round_, groups == 1), schema)
        if groups == 1:
            whole.append(table)
            break
        table = stored(table, "pack")
        whole.append(table.where("grp < 0"))
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(F.col("key").alias(key), *names)
