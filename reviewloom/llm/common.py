"""Helpers of the operators: written intermediate tables, components, batch sizes."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import configure, shared_folder

#: Rows in an Arrow batch: texts may be long, and a batch is held in memory.
BATCH_ROWS = 512


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings for jobs that hand texts to Python."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024**2))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete the files of tables from ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    shared = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if f"/{shared}/" in folder and re.search("-[0-9a-f]{32}$", folder):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs: it does so when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that other columns cannot clash with those added."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): a row (node, component) per node.

    The component is the smallest node. Large and small stars alternate: in the first,
    the larger neighbours of a node are hung on its smallest one, in the second the
    smaller ones and itself. Self-loops keep single nodes; nulls are left out.
    Each round is one aggregation and one join on the node, written to the checkpoint
    folder; the join's large side is split when a node is hot.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    nodes = edges.where("a is not null and b is not null").select("a", "b").distinct()
    nodes = nodes.checkpoint()
    links = nodes.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    before = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        links = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = (
            links.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
            .checkpoint()
        )
        state = links.agg(
            F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    every = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )
