"""As-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(base: DataFrame, events: DataFrame, key: str, at: str, event_at: str, out: str, forward: bool = False) -> DataFrame:
    """base with the nearest event moment at or before (or at or after) each row's, by key: one sort, no join."""
    columns = base.columns
    rows = base.withColumn("_e", F.lit(None).cast(base.schema[at].dataType)).withColumn("_side", F.lit(0 if forward else 1))
    marks = events.select(F.col(key), F.col(event_at).cast(base.schema[at].dataType).alias(at)).where(F.col(at).isNotNull())
    marks = marks.withColumn("_e", F.col(at)).withColumn("_side", F.lit(1 if forward else 0))
    w = Window.partitionBy(key).orderBy(at, "_side")
    value = F.first("_e", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn(out, value)
    return both.where(F.col("_side") == (0 if forward else 1)).select(*columns, out)


def nearest_in_window(left: DataFrame, right: DataFrame, on: list[str], condition, left_id: str, order: list, span: tuple[Column, Column], at: Column, how: str = "inner", days: int = 30) -> DataFrame:
    """For each left row the first right row, by ``order``, of those that the range condition admits.

    span: first and last day, on the left, that the condition can admit; at: day on
    the right.  A bucket of ``days`` joins the keys, so a hot key spreads over its
    buckets; the left side visits each bucket of its span.
    """
    bucket = lambda day: F.floor(F.unix_date(day) / days)
    left = left.withColumn("_lb", F.explode_outer(F.sequence(bucket(span[0]), bucket(span[1]))))
    right = right.withColumn("_rb", bucket(at))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [F.col("l._lb") == F.col("r._rb")]
    joined = left.alias("l").join(right.alias("r"), [*same, condition], how)
    first = Window.partitionBy(f"l.{left_id}").orderBy(F.col("r._rb").isNull(), *order)
    return joined.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_lb", "_rb")


def bucketed_range_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, days: int) -> DataFrame:
    """Rows of equal key with right_at from ``at`` to ``days`` later; both are dates.

    A bucket of time joins the key, so a hot key spreads over its buckets: the left
    side visits its own bucket and the next.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    probe = left.withColumn("_b", F.explode(F.array(bucket(F.col(at)), bucket(F.col(at)) + 1)))
    build = right.withColumnRenamed(key, "_k").withColumn("_b2", bucket(F.col(right_at)))
    gap = F.datediff(F.col(right_at), F.col(at))
    return probe.join(build, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_b2")) & gap.between(0, days)).drop("_b", "_b2", "_k")
