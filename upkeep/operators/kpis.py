"""Business indicators over the marts, and the value of condition-based work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.ordering import running
from upkeep.functions.scalars import FAMILIES, clip, days_crossed, family, filled, hours_crossed, ratio
from upkeep.functions.temporal import nearest_in_window
from upkeep.operators.marts import total
from upkeep.sources.fleet import Fleet


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def down(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def top_units(units: DataFrame, n: int = 50) -> DataFrame:
    return top(units.select("day", "unit_id", "fleet_id", "risk", "critical_components", "backlog_items", "overdue_items", "critical_items", "exposure", "unavailable_h"), [down("risk"), down("unavailable_h"), F.col("day"), F.col("unit_id")], n)


def top_components(mart: DataFrame, n: int = 80) -> DataFrame:
    return top(mart.select("day", "component_id", "unit_id", "kind", "criticality", "health", "deterioration", "failures_30", "critical_alerts"), [down("criticality"), F.col("health").asc_nulls_last(), down("deterioration"), F.col("day"), F.col("component_id")], n)


def top_depots(depots: DataFrame, n: int = 40) -> DataFrame:
    return top(depots.select("day", "depot_id", "depot_name", "saturation", "backlog_items", "overdue_items", "critical_items", "exposure", "mean_risk", "corrective_share"), [down("saturation"), down("critical_items"), F.col("day"), F.col("depot_id")], n)


def repetitive_failures(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("kind", "mode").agg(F.count("*").alias("cases"), F.sum("repeated_events").alias("repeated_events"), F.sum("downtime_h").alias("downtime_h"))


def unavailable_units(units: DataFrame, n: int = 50) -> DataFrame:
    sums = units.groupBy("unit_id", "fleet_id").agg(F.sum("unavailable_h").alias("unavailable_h"), F.sum("cancellations").alias("cancellations"), F.avg("risk").alias("mean_risk"))
    return top(sums, [down("unavailable_h"), F.col("unit_id")], n)


def critical_backlog(depots: DataFrame, n: int = 20) -> DataFrame:
    sums = depots.groupBy("depot_id").agg(F.sum("backlog_items").alias("backlog_items"), F.sum("overdue_items").alias("overdue_items"), F.sum("critical_items").alias("critical_items"), F.avg("exposure").alias("exposure"), F.avg("saturation").alias("saturation"))
    return top(sums, [down("critical_items"), down("overdue_items"), F.col("depot_id")], n)


def health_trend(mart: DataFrame) -> DataFrame:
    return mart.groupBy("kind").agg(F.avg("rolling_change").alias("rolling_change"), F.avg("health").alias("health"), F.avg("deterioration").alias("deterioration"), F.avg("failures_30").alias("failures_30"))


def inspection_families(fleet: Fleet) -> DataFrame:
    """Coverage, detection, lead time, alert chain and follow-through of inspections by family.

    Links count calendar days: a failure 0 to 30 days after a detection, maintenance
    0 to 14 days after a severe one, an early alert between detection and failure.
    Of several candidates the nearest counts.
    """
    technical = fleet.components.select("component_id", family(F.col("kind")).alias("technical"))
    seen = fleet.inspections.join(technical, "component_id", "left").withColumn("named", family(F.col("reported")))
    seen = seen.withColumn("family", F.coalesce("technical", "named")).where(F.col("family").isin(*FAMILIES))
    seen = seen.withColumn("consistent", ((F.col("named") == F.col("family")) | (F.col("named") == "other")).cast("double")).withColumn("confidence", clip(F.col("confidence"), 0, 1))
    failed = fleet.failures.join(technical, "component_id", "left").withColumn("family", F.coalesce("technical", family(F.col("mode")))).where(F.col("family").isin(*FAMILIES)).select("failure_id", "component_id", "family", F.col("day").alias("failed"))
    hits = seen.where("defect = 1")
    on = ["component_id", "family"]
    gap = days_crossed(F.col("r.ts"), F.col("l.failed"))
    linked = nearest_in_window(failed, hits, on, gap.between(0, 30), "failure_id", [F.col("r.ts").desc(), F.col("r.inspection_id")], (F.date_sub(F.to_date("failed"), 30), F.to_date("failed")), F.to_date("ts"))
    linked = linked.select("failure_id", F.col("l.component_id").alias("component_id"), F.col("l.family").alias("family"), "failed", F.col("r.ts").alias("found"), gap.alias("lead"), F.col("r.confidence").alias("confidence"))
    ahead = days_crossed(F.col("l.ts"), F.col("r.failed"))
    outcome = nearest_in_window(hits, failed, on, ahead.between(0, 30), "inspection_id", [F.col("r.failed"), F.col("r.failure_id")], (F.to_date("ts"), F.date_add(F.to_date("ts"), 30)), F.to_date("failed"), "left").select(F.col("l.family").alias("family"), F.when(F.col("r.failure_id").isNull(), 0).otherwise(1).alias("hit"))
    early = fleet.alerts.where("early = 1").select("component_id", F.col("ts").alias("alerted"), "alert_id")
    chain = nearest_in_window(linked, early, ["component_id"], F.col("r.alerted").between(F.col("l.found"), F.col("l.failed").cast("timestamp_ntz")), "failure_id", [F.col("r.alerted"), F.col("r.alert_id")], (F.to_date("found"), F.to_date("failed")), F.to_date("alerted"), "left")
    chain = chain.select("l.family", F.col("r.alerted").isNotNull().cast("double").alias("chained"), hours_crossed(F.col("l.found"), F.col("r.alerted")).alias("to_alert"), hours_crossed(F.col("r.alerted"), F.col("l.failed").cast("timestamp_ntz")).alias("to_failure"))
    severe = hits.where(F.col("severity").isin("high", "critical"))
    work = fleet.maintenance.select("component_id", F.col("ts").alias("started"), "maintenance_id")
    follow = nearest_in_window(severe, work, ["component_id"], days_crossed(F.col("l.ts"), F.col("r.started")).between(0, 14), "inspection_id", [F.col("r.started"), F.col("r.maintenance_id")], (F.to_date("ts"), F.date_add(F.to_date("ts"), 14)), F.to_date("started"), "left").select("l.family", F.col("r.started").isNotNull().cast("double").alias("followed"))

    by = "family"
    grid = fleet.spark.createDataFrame([(f,) for f in FAMILIES], "family string")
    parts = [
        technical.where(F.col("technical").isin(*FAMILIES)).groupBy(F.col("technical").alias(by)).agg(F.count_distinct("component_id").alias("monitored")),
        seen.groupBy(by).agg(F.count_distinct("component_id").alias("inspected"), F.count_distinct("inspection_id").alias("inspections"), F.sum("defect").alias("detections"), F.avg("consistent").alias("consistency")),
        failed.groupBy(by).agg(F.count_distinct("failure_id").alias("failures")),
        linked.groupBy(by).agg(F.count_distinct("failure_id").alias("foreseen"), F.avg("lead").alias("lead_days"), F.avg("confidence").alias("confidence_before")),
        outcome.groupBy(by).agg(F.sum("hit").alias("confirmed"), F.count("*").alias("detected")),
        chain.groupBy(by).agg(F.avg("chained").alias("chain_rate"), F.avg("to_alert").alias("to_alert_h"), F.avg("to_failure").alias("to_failure_h")),
        follow.groupBy(by).agg(F.avg("followed").alias("follow_rate")),
    ]
    for p in parts:
        grid = grid.join(F.broadcast(p), by, "left")
    rate = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    coverage, detection, before, confirmed = rate("inspected", "monitored"), rate("detections", "inspections"), rate("foreseen", "failures"), rate("confirmed", "detected")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("monitored", "inspected", "inspections", "detections", "failures", "foreseen", "confirmed", "detected")]
    return grid.select(
        by, *counts, clip(coverage, 0, 1).alias("coverage"), clip(detection, 0, 1).alias("detection_rate"), clip(before, 0, 1).alias("foreseen_rate"), clip(1.0 - confirmed, 0, 1).alias("false_alert_rate"), clip(coverage * before * filled("confidence_before", 0) * confirmed, 0, 1).alias("detection_value"),
        *(clip(filled(c, 0), 0, 1).alias(c) for c in ("consistency", "chain_rate", "follow_rate")), *(filled(c, 0).alias(c) for c in ("lead_days", "to_alert_h", "to_failure_h")),
    )


def condition_value(fleet: Fleet) -> DataFrame:
    """One row: early alerts, condition-based work, and what they may have saved."""
    early = fleet.alerts.agg(total(F.col("early") == 1).alias("early_alerts"), total((F.col("early") == 1) & (F.col("attended") == 1)).alias("attended"), (total((F.col("early") == 1) & (F.col("origin") == "sensor")) * 0.18).alias("avoidable_corrective"))
    work = fleet.maintenance.where("condition_based = 1").agg(F.count("*").alias("interventions"), F.sum("hours").alias("hours"), F.sum("cost").alias("cost"))
    service = fleet.service.agg((F.sum("unavailable_h") * 0.12).alias("avoidable_hours"), (F.sum("cancellations").cast("double") * 95).alias("service_cost"))
    out = early.crossJoin(work).crossJoin(service)
    attention = F.when(F.col("early_alerts") > 0, F.col("attended") / F.col("early_alerts")).otherwise(F.lit(0.0))
    return out.withColumn("attention_rate", attention).withColumn("net_value", F.col("service_cost") - F.col("cost"))


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sums by key with the running share, largest first."""
    sums = df.groupBy(key).agg(F.sum(value).alias(value))
    upto = running(sums, {"_upto": F.col(value)}, [F.col(value).desc(), F.col(key)])
    return upto.withColumn("running_share", F.col("_upto") / F.col("_upto_total")).drop("_upto", "_upto_total")
