"""Session settings the jobs rely on, and the folder shared by all executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch, whichever comes first. A task of model calls holds a
#: few copies of one (Arrow, pandas, the batch before), so its memory follows these numbers.
BATCH_ROWS = 512
BATCH_BYTES = 4 * 1024**2

#: UTC keeps parsed dates at midnight; the adaptive settings merge small shuffle
#: partitions and split hot ones (a hot prompt key in a lookup join, for one).
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: Aims for large inputs. Adaptive execution merges shuffle partitions that turn out
#: small but never adds any, so the number to start with must fit; and both numbers are
#: kept in the range where the blocks between map and reduce tasks can be tracked.
PARTITION_BYTES = 1024**3
SPLIT_BYTES = 512 * 1024**2
FEW_PARTITIONS = 200


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the settings to a session that already exists.

    Give the size of the input for a large one: 100 TB are then read in some 190,000
    splits and start with some 93,000 shuffle partitions, not with the default 200.
    Spark makes splits smaller where the input has too few of them for all cores.
    """
    settings = dict(SETTINGS)
    if input_bytes is not None:
        partitions = max(FEW_PARTITIONS, -(-input_bytes // PARTITION_BYTES))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(partitions)
        settings["spark.sql.files.maxPartitionBytes"] = str(SPLIT_BYTES)
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables, reachable from every executor.

    The cluster names it in ``spark.checkpoint.dir``, or a job does so by setting the
    checkpoint folder of its context. Only where neither is the case, which is a test
    on one machine, a fresh temporary folder is taken and kept as the context's.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="reviewloom-"))
    return context.getCheckpointDir()
