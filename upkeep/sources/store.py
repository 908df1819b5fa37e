"""Physical marts: written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from upkeep.sources import lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="upkeep-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where


@contextmanager
def compiled_small(spark: SparkSession) -> Iterator[None]:
    """Writes of wide tables: generated methods longer than 8000 bytes, which the JVM would only interpret, are not used; the session's setting comes back."""
    key, default = "spark.sql.codegen.hugeMethodLimit", "65535"
    before = spark.conf.get(key, default)
    spark.conf.set(key, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plain_doubles(df: DataFrame) -> dict[str, str]:
    """Options of a Parquet write that leave the dictionaries of top-level doubles out: looking each value up took most of the time of a wide mart's write."""
    return {f"parquet.enable.dictionary#{c}": "false" for c, t in df.dtypes if t == "double"}


def materialize(df: DataFrame, name: str, by: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A table instead of a plan: what reads it several times doesn't compute it again, lost executors or not; by, order: in sorted buckets."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lineage.written(path, df)
    if by:
        return read_bucketed(df.sparkSession, path, df.schema, by, order, save_bucketed(df, path, by, order))
    with compiled_small(df.sparkSession):
        df.write.options(**plain_doubles(df)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return "upkeep_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def save_bucketed(df: DataFrame, path: str, by: str, order: Sequence[str]) -> int:
    """Overwrite a table in buckets of a column, sorted by it and ``order``; the number of buckets, which is that of the shuffle's partitions.

    A plan that ends in partitions by the same column writes each bucket from one task,
    with no exchange for it.  The catalogue gets a table named by a digest of the path.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with compiled_small(df.sparkSession):
        df.write.mode("overwrite").format("parquet").options(**plain_doubles(df)).bucketBy(n, by).sortBy(by, *order).option("path", path).saveAsTable(_table_name(path))
    return n


def read_bucketed(spark: SparkSession, path: str, schema: StructType, by: str, order: Sequence[str], buckets: int) -> DataFrame:
    """A bucketed table, also in a session whose catalogue doesn't know it: joins, groups and windows by its column need no exchange."""
    columns = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json()).toDDL()
    keys = ", ".join(f"`{c}`" for c in (by, *order))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table_name(path)} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_table_name(path))


def save_sorted(df: DataFrame, path: str, order: Sequence[str], partition: str | None = None) -> None:
    """Overwrite a table, rows sorted within its files, optionally in folders by a column."""
    writer = df.sortWithinPartitions(*order).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
