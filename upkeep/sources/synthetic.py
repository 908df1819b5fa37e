"""A made fleet: events, parts and suppliers that depend on nothing but a seed and their keys.

Each value comes from hashes of (seed, column, key), so tables of any size are made in
parallel and come out the same whatever the partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of the kinds of event, running sums.
KINDS = (("view", 0.40), ("click", 0.70), ("signup", 0.80), ("error", 0.90), ("purchase", 1.0))


def uniform(seed: int, column: str, key: str | Column = "id") -> Column:
    """A value in [0, 1) for each key."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(column), key), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, column: str, key: str | Column = "id") -> Column:
    """A standard normal value for each key, from two uniform ones."""
    u, v = 1 - uniform(seed, column + "/u", key), uniform(seed, column + "/v", key)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def choice(u: Column, shares: tuple[tuple[str, float], ...]) -> Column:
    out = F.lit(shares[-1][0])
    for name, upto in reversed(shares[:-1]):
        out = F.when(u < upto, name).otherwise(out)
    return out


def synthetic_fleet(spark: SparkSession, components: int, events: int, days: int = 30, first_day: str = "2024-01-01", seed: int = 42) -> dict[str, DataFrame]:
    """Tables events, part and supplier; values have a yearly season, and older components fail more."""
    ids = spark.range(events)
    age = F.col("user_id") / components
    kind = choice(uniform(seed, "kind") * (1 - 0.1 * age) + 0.1 * age, KINDS)
    at = F.timestamp_seconds(F.unix_seconds(F.lit(first_day).cast("timestamp")) + F.floor(uniform(seed, "ts") * days * 86400))
    season = 8 * F.sin(2 * math.pi * F.dayofyear("ts") / 365.25)
    made = ids.withColumn("user_id", 1 + F.floor(F.pow(uniform(seed, "user"), 1.5) * components)).withColumn("ts", at)
    made = made.withColumn("value", F.round(F.least(F.lit(200.0), F.greatest(F.lit(0.0), 45 + 18 * normal(seed, "value") + season)), 2))
    made = made.select(F.col("id").alias("event_id"), "ts", "user_id", kind.alias("event_type"), "value", F.to_json(F.struct((F.col("id") % 100).alias("k"))).alias("props"))
    part = spark.range(1, components + 1).select(F.col("id").alias("p_partkey"), choice(uniform(seed, "type"), (("STANDARD", 0.5), ("ECONOMY", 0.8), ("PROMO", 1.0))).alias("p_type"), (1 + F.floor(uniform(seed, "size") * 50)).cast("int").alias("p_size"), F.round(900 + 100 * uniform(seed, "price"), 2).alias("p_retailprice"))
    supplier = spark.range(10).select(F.col("id").alias("s_suppkey"), F.format_string("Supplier#%09d", "id").alias("s_name"), F.round(-1000 + 10000 * uniform(seed, "balance"), 2).alias("s_acctbal"))
    return {"events": made, "part": part, "supplier": supplier}
