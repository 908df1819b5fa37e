"""Sharding by extendible hashing, in DataFrame operations.

The directory is indexed by the leading bits of a 64-bit hash of the key.  A
bucket that holds more than the limit splits on one more bit, the others stay as
they are.  Sizes of buckets come from sums by prefix, so a round settles several
depths; rounds go on for the oversized buckets only.  Rows of one key can't be
parted by its hash: a bucket of a single hash that is still too large overflows
into shards of its own by running sums of bytes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.llm.common import materialize

ROUND_BITS = 6
SPREAD = 32


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: of its strings and binaries, and eight for each other column."""
    parts = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("long")


def _prefix(depth: int, column: str = "_h") -> Column:
    """The leading ``depth`` bits of a hash."""
    return F.shiftrightunsigned(column, 64 - depth) if depth else F.lit(0).cast("long")


def key_hash(key: str) -> Column:
    """The first 64 bits of the MD5 of a key as text, as other engines can compute them; a null key is one key."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), 1, 16), 16, -10).cast("long")


def shard(rows: DataFrame, key: str = "doc_id", limit: int = 32 << 20) -> DataFrame:
    """The rows' key with n_bytes, shard, depth and shard_bytes.

    shard: the bits of its bucket, ``*`` for the only bucket, and for a bucket that
    overflowed ``-`` and a number.  A shard holds at most ``limit`` bytes unless it
    is a single row.  Null keys are one key.  Repeated rows stay; their order within
    an overflowed key follows the input's partitions.  An empty table has no shards.
    """
    sized = rows.select(F.col(f"`{key}`").alias("_key"), key_hash(key).alias("_h"), row_bytes(rows).alias("n_bytes"))
    placed = _place(sized, "_key", limit)
    return placed.select(F.col("_key").alias(key), "n_bytes", "shard", "depth", "shard_bytes")


def _place(sized: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes) of rows (key, _h, n_bytes)."""
    if limit < 1:
        raise ValueError("limit must be positive")
    base = materialize(sized, "hashed")
    total = base.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return base.select(key, "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.col("n_bytes").alias("shard_bytes"))
    done: list[DataFrame] = []
    open_, low, high = base, 0, min(60, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 2))
    while True:
        cell = open_.groupBy(_prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("_h").alias("h0"), F.max("_h").alias("h1"))
        node = cell.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        node = node.withColumn("bits", F.expr(f"shiftrightunsigned(cell, {high} - depth)"))
        node = node.groupBy("depth", "bits").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        fits = (F.col("b") <= limit) | (F.col("n") == 1) | (F.col("h0") == F.col("h1"))
        node = materialize(node.withColumn("fits", fits), "nodes")
        parent = node.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("bits").alias("above"))
        child = node.where("fits").withColumn("above", F.shiftright("bits", 1))
        deeper = child.where(F.col("depth") > low).join(parent, ["depth", "above"], "left_semi")
        leaves = child.where(F.col("depth") == low).unionByName(deeper)  # what stands above low is known not to fit
        entry = leaves.withColumn("_cell", F.explode(F.expr(f"sequence(bits << ({high} - depth), (bits << ({high} - depth)) + (1L << ({high} - depth)) - 1)")))
        entry = entry.select("_cell", "depth", "bits", F.col("b").alias("shard_bytes"), ((F.col("b") > limit) & (F.col("n") > 1)).alias("over"))
        placed = open_.withColumn("_cell", _prefix(high)).join(entry, "_cell", "left")
        more = node.where(~F.col("fits") & (F.col("depth") == high)).limit(1).count()
        if not more:
            done.append(placed)
            break
        placed = materialize(placed, "placed")
        done.append(placed.where("depth is not null"))
        open_ = placed.where("depth is null").select(key, "_h", "n_bytes")
        low, high = high + 1, min(64, high + ROUND_BITS)
    found = reduce(DataFrame.unionByName, done)
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.expr("substring(lpad(bin(bits), 64, '0'), 65 - depth)"))
    found = found.select(key, "n_bytes", name.alias("shard"), "depth", "shard_bytes", "over", "_h")
    normal = found.where(~F.col("over"))
    return normal.drop("over", "_h").unionByName(_overflow(found.where("over"), key, limit))


def _overflow(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of single hashes that exceed the limit, cut by running sums: within parts of the input, then over the parts.

    Of a row's running sum the limit's multiple gives its chunk; a chunk could hold
    one row over its limit, so chunks are of half the limit, and a row over that is
    one of its own.
    """
    half = max(1, limit // 2)
    rows = materialize(rows.withColumn("_big", F.col("n_bytes") > half), "overflow").withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    within = Window.partitionBy("shard", "_big", "_part").orderBy("_id")
    rows = materialize(rows.withColumn("_run", F.sum("n_bytes").over(within)).withColumn("_k", F.row_number().over(within)), "running")
    before = Window.partitionBy("shard", "_big").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "_big", "_part").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    parts = parts.select("shard", "_big", "_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    rows = rows.join(parts, ["shard", "_big", "_part"])
    chunk = F.when(F.col("_big"), F.concat(F.lit("b"), (F.col("_n") + F.col("_k")).cast("string"))).otherwise(F.floor((F.col("_b") + F.col("_run") - 1) / half).cast("string"))
    rows = rows.withColumn("shard", F.concat("shard", F.lit("-"), chunk))
    size = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.drop("shard_bytes").join(size, "shard").select(key, "n_bytes", "shard", "depth", "shard_bytes")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", limit: int = 32 << 20, shard_col: str = "shard") -> DataFrame:
    """Write the rows as Parquet, a folder for each shard; returns the table of shards (shard, rows, bytes).

    Rows are placed by row: null and repeated keys stay.  The folders are named by
    ``shard_col``, which may be no column of the rows.
    """
    if shard_col in rows.columns:
        raise ValueError(f"{shard_col} is a column of the rows: give shard_col another name")
    names = [f"c{k}" for k in range(len(rows.columns))]
    full = rows.select("*", key_hash(key).alias("_h"), row_bytes(rows).alias("n_bytes"), F.monotonically_increasing_id().alias("_row")).toDF(*names, "_h", "n_bytes", "_row")
    full = materialize(full, "rows")
    placed = materialize(_place(full.select("_row", "_h", "n_bytes"), "_row", limit), "places")
    out = full.join(placed.select("_row", F.col("shard").alias("_shard")), "_row").select(*(F.col(n).alias(c) for n, c in zip(names, rows.columns, strict=True)), F.col("_shard").alias(shard_col))
    out.repartition(shard_col).write.partitionBy(shard_col).parquet(path)
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.max("shard_bytes").alias("bytes"))
