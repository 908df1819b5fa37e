"""Helpers shared by the operators: shared storage, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one in local mode where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Long texts need short Arrow batches; a smaller setting is left as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` bytes of text each."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def finite_vector(v: Column) -> Column:
    """Whether an array of doubles is there and holds neither null nor non-finite entries."""
    return F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))


def dealt_again(df: DataFrame, key: str) -> DataFrame:
    """df with ``key`` as a new expression: a join on it deals this side out too, so that Spark can split a hot key of the other."""
    return df.withColumn(key, F.col(key) + F.lit(0).cast("long"))


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of (u, v), longs: rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps until the edges are stars.
    Nothing but the count and a checksum of the edges gets to the driver.  Minima
    are summed up before they are dealt out, and the joins on a node can be split,
    so a hub's edges don't meet in one task.
    """

    def star(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(dealt_again(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt_again(low, "u"), "u")
        return small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()

    now = materialize(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = materialize(star(now), label)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
