"""Checks of the marts and of raw tables: ranges, keys, references, coherence, gates and contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.ordering import quantiles
from upkeep.operators.marts import total


def outside(name: str, low: float, high: float) -> Column:
    return total((F.col(name) < low) | (F.col(name) > high))


def row_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("object"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def null_rates(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).select(F.lit(name).alias("object"), *columns)


def sensor_ranges(readings: DataFrame) -> DataFrame:
    return readings.agg(outside("temperature", -20, 170).alias("temperature"), outside("vibration", 0, 20).alias("vibration"), outside("wear", 0, 150).alias("wear"))


def temporal_coherence(maintenance: DataFrame, backlog: DataFrame) -> DataFrame:
    a = maintenance.agg(total(F.col("hours") < 0).alias("negative_duration"))
    return a.crossJoin(backlog.agg(total(F.col("age_days") < 0).alias("negative_age")))


def score_action_consistency(units: DataFrame) -> DataFrame:
    return units.agg(total((F.col("risk") >= 0.8) & (F.col("backlog_items") == 0)).alias("high_risk_without_backlog"), total((F.col("risk") < 0.2) & (F.col("unavailable_h") > 12)).alias("low_risk_high_downtime"))


def backlog_consistency(units: DataFrame) -> DataFrame:
    c = F.col
    return units.agg(total(c("overdue_items") > c("backlog_items")).alias("overdue_over_all"), total(c("critical_items") > c("backlog_items")).alias("critical_over_all"), outside("overdue_ratio", 0, 1).alias("overdue_ratio"), outside("critical_ratio", 0, 1).alias("critical_ratio"), outside("exposure", 0, 100).alias("exposure"))


def health_balance(mart: DataFrame) -> DataFrame:
    return mart.agg(F.avg(F.abs(F.col("health") + F.col("deterioration") - 100.0)).alias("mae"), outside("health", 0, 100).alias("health"), outside("deterioration", 0, 100).alias("deterioration"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicates"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: distinct child keys without a parent."""
    keys = child.select(F.col(child_key).alias("k")).where("k is not null").distinct()
    return keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti").agg(F.count("*").alias("orphans"))


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of several small frames of the same columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def key_report(keys: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """(object, n_rows, null_keys, duplicates) for each table and its key."""
    parts = []
    for name, df, key in keys:
        per = df.groupBy(*key).count()
        missing = F.lit(False)
        for k in key:
            missing = missing | F.col(k).isNull()
        parts.append(per.agg(F.sum("count").alias("n_rows"), F.sum(F.when(missing, F.col("count")).otherwise(0)).alias("null_keys"), F.count_if(F.col("count") > 1).alias("duplicates")).select(F.lit(name).alias("object"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "null_keys", "duplicates"))))
    return stacked(parts)


def reference_report(references: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(reference, orphans): distinct child keys without a parent, for each reference."""
    return stacked([orphans(child, parent, k, pk).select(F.lit(name).alias("reference"), "orphans") for name, child, k, parent, pk in references])


def mismatched(child: DataFrame, parent: DataFrame, key: str, same: str) -> DataFrame:
    """Rows of child whose key has no parent, or a parent with another value of ``same``; parent keys are unique."""
    other = parent.select(key, F.col(same).alias("_same"), F.lit(1).alias("_there"))
    return child.join(other, key, "left").where(F.col("_there").isNull() | ~F.col(same).eqNullSafe(F.col("_same"))).drop("_same", "_there")


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that raises where a key stands more than once on either side."""
    for side, df in (("left", left), ("right", right)):
        if df.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"the {side} side holds a key of {list(on)} more than once")
    return left.join(right, list(on), how)


def gate_report(checks: Sequence[tuple[str, bool, DataFrame]]) -> DataFrame:
    """(gate, faults, blocking, status) from one-row frames of counts: a count that is null counts as a fault."""
    parts = []
    for name, blocking, df in checks:
        total_ = sum((F.coalesce(F.col(c), F.lit(1)) for c in df.columns), F.lit(0)).cast("long")
        parts.append(df.select(F.lit(name).alias("gate"), total_.alias("faults"), F.lit(blocking).alias("blocking")))
    return stacked(parts).withColumn("status", F.when(F.col("faults") == 0, "passed").when(F.col("blocking"), "blocked").otherwise("warned"))


def cardinalities(**tables: DataFrame) -> DataFrame:
    """(object, n_rows, n_columns, n_distinct) of each table; distinct whole rows."""
    return stacked([df.groupBy(*df.columns).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).select(F.lit(name).alias("object"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_distinct") for name, df in tables.items()])


def metric_ranges(units: DataFrame, depots: DataFrame, families: DataFrame) -> DataFrame:
    a = units.agg(outside("risk", 0, 1).alias("risk"), outside("availability", 0, 1).alias("availability"), outside("exposure", 0, 100).alias("exposure"))
    b = depots.agg(total(F.col("saturation") < 0).alias("saturation"))
    c = families.agg(*(outside(x, 0, 1).alias(x) for x in ("coverage", "detection_rate", "foreseen_rate", "false_alert_rate", "detection_value")))
    return a.crossJoin(b).crossJoin(c)


def business_coherence(units: DataFrame, weeks: DataFrame, value: DataFrame) -> DataFrame:
    c = F.col
    a = units.agg(total((c("planned_h") < 0) | (c("available_h") < 0) | (c("unavailable_h") < 0)).alias("negative_hours"), total(F.abs(c("available_h") + c("unavailable_h") - c("planned_h")) > 1e-6).alias("hours_unreconciled"))
    b = weeks.agg(total((c("mtbf") < 0) | (c("mttr") < 0)).alias("negative_reliability"), total((c("failures") == 0) & (c("mttr") != 0)).alias("mttr_without_failures"))
    return a.crossJoin(b).crossJoin(value.agg(total((c("cost") < 0) | (c("service_cost") < 0)).alias("negative_value")))


def assert_gates(zero: dict[str, DataFrame], non_empty: dict[str, DataFrame], balance: DataFrame | None = None) -> None:
    """Raise if a zero check has a count or a null, a mart is empty, or health and deterioration don't add up."""
    faults = []
    for name, df in zero.items():
        row = df.first()
        faults += [f"{name}.{c}" for c, v in (row.asDict() if row else {"*": None}).items() if v is None or v != 0]
    faults += [f"{name} is empty" for name, df in non_empty.items() if df.isEmpty()]
    if balance is not None and not (balance.first()["mae"] or 0.0) <= 1e-6:
        faults.append("health balance")
    if faults:
        raise ValueError("checks failed: " + ", ".join(faults))


def profile(df: DataFrame) -> DataFrame:
    """Null share, distinct values and cardinality share of every column, from one pass."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("n"), *(F.count(c).alias(f"a_{c}") for c in df.columns), *(F.count_distinct(c).alias(f"d_{c}") for c in df.columns))
    cells = ", ".join(f"struct('{c}' as name, a_{c} as present, d_{c} as distinct_values)" for c in df.columns)
    return row.selectExpr("n", f"explode(array({cells})) as c").select(F.col("c.name").alias("column"), (1 - F.try_divide("c.present", "n")).alias("null_share"), F.col("c.distinct_values").alias("distinct_values"), F.try_divide("c.distinct_values", "n").alias("cardinality"))


def numeric_profile(df: DataFrame, name: str) -> DataFrame:
    """Bounds, exact quantiles, mean and deviation of a column, in one row."""
    row = df.agg(F.min(name).alias("low"), F.max(name).alias("high"), F.avg(name).alias("mean"), F.stddev_pop(name).alias("std"))
    found = quantiles(df, {"p01": (name, 0.01), "p50": (name, 0.5), "p99": (name, 0.99)})
    return row.crossJoin(F.broadcast(found)).select("low", "p01", "p50", "p99", "high", "mean", "std")  # one row each
