"""Stored model answers: Parquet files laid out by key range, each key there once.

``path/run=<id>/key_range=<digits>/`` holds the answers of one append, sorted by key. A
small version file names the runs that count; it is the only thing that changes hands, so
a reader sees whole appends or none, and needs no aggregation: an append leaves out the
keys that others have stored in the meantime, and is done again if it loses the race.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import CACHE_ENTRY

_ANSWER = [name for name in CACHE_ENTRY.names if name != "prompt_hash"]
_STORED = StructType([*CACHE_ENTRY.fields, StructField("key_range", StringType(), True)])

#: Leading hexadecimal digits of a key that name its range, in a new store.
DIGITS = 1
#: Appends that may lose the race one after another.
TRIES = 20


@dataclass(frozen=True)
class Version:
    """What a store holds at a moment."""

    number: int = 0
    runs: tuple[str, ...] = ()
    digits: int = DIGITS


class _Versions:
    """The version files of a store, through the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = self._path(f"{path}/_versions")
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def _file(self, number: int):
        return self._path(f"{self.folder}/v{number:012d}.json")

    def _read(self, number: int) -> dict | None:
        """A version file; None while it is being written."""
        stream = self.fs.open(self._file(number))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def latest(self) -> Version:
        if not self.fs.exists(self.folder):
            return Version()
        names = [status.getPath().getName() for status in self.fs.listStatus(self.folder)]
        numbers = sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)
        for number in numbers:
            held = self._read(number)
            if held is not None:
                return Version(number, tuple(held["runs"]), held["digits"])
        return Version()

    def commit(self, version: Version) -> bool:
        """Write a version file; False if another writer has that number."""
        file, mine = self._file(version.number), uuid4().hex
        try:
            stream = self.fs.create(file, False)
        except Exception as error:  # noqa: BLE001
            if not self.fs.exists(file):
                raise error
            return False
        text = json.dumps({"runs": version.runs, "digits": version.digits, "writer": mine})
        stream.write(bytearray(text.encode()))
        stream.close()
        held = self._read(version.number)
        return held is not None and held["writer"] == mine


def current_version(spark: SparkSession, path: str) -> Version:
    """The version a reader would see now."""
    return _Versions(spark, path).latest()


def _range(digits: int) -> Column:
    return F.substring("prompt_hash", 1, digits)


def _write(answers: DataFrame, path: str, digits: int) -> str:
    run = uuid4().hex
    placed = answers.select(*CACHE_ENTRY.names).withColumn("key_range", _range(digits))
    ordered = placed.sortWithinPartitions("key_range", "prompt_hash")
    ordered.write.partitionBy("key_range").parquet(f"{path}/run={run}")
    return run


def _scan(spark: SparkSession, path: str, runs: tuple[str, ...]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], _STORED)
    folders = [f"{path}/run={run}" for run in runs]
    try:
        return spark.read.schema(_STORED).option("basePath", path).parquet(*folders).select(*_STORED.names)
    except PySparkException as error:
        raise RuntimeError(f"{path}: a run of its version is gone") from error


def append_responses(responses: DataFrame, path: str, since: Version | None = None) -> Version:
    """Add answers to the store. This is the action that calls the model.

    Empty answers are not kept, so their prompts will be asked again; null keys are not
    either. Where a key is stored already, or stored by another writer in the meantime,
    what is stored stays. ``since`` says that ``responses`` has each key once and none that
    this version has: if no one else has written since, they are written once and not read.
    """
    spark = responses.sparkSession
    versions = _Versions(spark, path)
    base = since or versions.latest()
    answered = responses.select(*CACHE_ENTRY.names).where((F.col("content") != "") & F.col("prompt_hash").isNotNull())
    run = _write(answered, path, base.digits)
    clean = since is not None
    for _ in range(TRIES):
        now = versions.latest()
        if now.digits != base.digits:
            raise ValueError(f"{path}: its ranges have changed; append again")
        known = now.runs if not clean else tuple(r for r in now.runs if r not in base.runs)
        if not clean or known:
            rows = _scan(spark, path, (run,))
            rows = rows if clean else one_answer_per_key(rows)
            if known:
                taken = _scan(spark, path, known).select("prompt_hash")
                rows = rows.join(taken, "prompt_hash", "left_anti")
            run, clean = _write(rows, path, base.digits), True
        base = now
        made = Version(now.number + 1, (*now.runs, run), now.digits)
        if versions.commit(made):
            return made
    raise RuntimeError(f"{path}: lost {TRIES} races with other writers")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers, one per key; empty when nothing was stored yet.

    The frame sees the version of the moment it was made.
    """
    return _scan(spark, path, current_version(spark, path).runs).select(*CACHE_ENTRY.names)


def find_response(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The stored answer of one key, from the files of its range only."""
    version = current_version(spark, path)
    rows = _scan(spark, path, version.runs).where(F.col("key_range") == key[: version.digits])
    return rows.where(F.col("prompt_hash") == key).select(*CACHE_ENTRY.names)


def compact_responses(spark: SparkSession, path: str, digits: int | None = None) -> Version:
    """Write the runs of a store as one, with ranges of ``digits`` digits if given.

    Old files stay for readers of older versions. If another writer comes first, nothing
    changes and the store is as it was.
    """
    versions = _Versions(spark, path)
    now = versions.latest()
    digits = digits or now.digits
    if len(now.runs) < 2 and digits == now.digits:
        return now
    rows = _scan(spark, path, now.runs).repartition(F.substring("prompt_hash", 1, digits), F.hash("prompt_hash") % 16)
    made = Version(now.number + 1, (_write(rows, path, digits),), digits)
    return made if versions.commit(made) else versions.latest()


def one_answer_per_key(stored: DataFrame) -> DataFrame:
    """Settle on one answer where a frame has a key more than once."""
    answer = F.min(F.struct(*_ANSWER)).alias("answer")
    fields = [F.col(f"answer.{name}").alias(name) for name in _ANSWER]
    return stored.groupBy("prompt_hash").agg(answer).select("prompt_hash", *fields)
