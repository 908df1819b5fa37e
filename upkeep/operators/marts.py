"""Day and week marts: component-day, unit-day, depot-day and fleet-week.

Every event table is aggregated to its day grain before any join, so no join fans
out.  The component mart deals its signals by component once; its aggregate, joins and
windows follow from that, and the windows share one sort by component and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.functions.scalars import guarded
from upkeep.sources.fleet import SEVERITIES, Fleet

DAY = ["day", "unit_id", "component_id"]


def share(name: str) -> Column:
    """Mean of a 0/1 column as a double."""
    return F.avg(F.col(name).cast("double"))


def total(condition: Column) -> Column:
    """Rows that meet a condition; 0 rather than null on groups without any."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def _day_rows(fleet: Fleet) -> DataFrame:
    """Readings, inspections, maintenance, failures, alerts and open orders as rows of one table; columns of other signals are null.

    Without a component no row has a place in the mart, and without a day only readings have.
    """
    columns = {
        "reading": (fleet.readings, {c: c for c in ("value", "temperature", "vibration", "wear", "load")}), "inspection": (fleet.inspections, {"score": "score", "confidence": "confidence", "defect": "defect"}),
        "visit": (fleet.maintenance, {"hours": "hours", "corrective": "corrective", "condition_based": "condition_based"}), "failure": (fleet.failures, {"downtime_h": "downtime_h", "severity": "severity", "repeated": "repeated"}),
        "alert": (fleet.alerts, {"early": "early", "severity": "alert_severity", "attended": "attended"}), "order": (fleet.backlog, {"age_days": "age_days", "risk": "risk", "severity": "order_severity"}),
    }
    rows = None
    for signal, (df, names) in columns.items():
        df = df.where("component_id IS NOT NULL" if signal == "reading" else "component_id IS NOT NULL AND day IS NOT NULL")
        one = df.select(*DAY, F.lit(signal).alias("signal"), *(F.col(c).alias(n) for c, n in names.items()))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows


def component_days(fleet: Fleet) -> DataFrame:
    """Component days with readings, with what else happened on them and the days of the last maintenance and failure: dealt by component once, then one aggregate.

    Aggregates skip nulls, so each sees the rows of its own signal.  Days without readings
    go only after the last events were taken.
    """
    is_ = lambda signal: F.col("signal") == signal
    zero = lambda x, t: F.coalesce(x, F.lit(0).cast(t))
    n = lambda condition: F.count_if(condition)
    days = _day_rows(fleet).repartition("component_id").groupBy(*DAY).agg(
        n(is_("reading")).alias("readings"), F.avg("value").alias("sensor_mean"), F.stddev_samp("value").alias("sensor_std"), F.max("value").alias("sensor_max"), F.avg("temperature").alias("temperature"), F.avg("vibration").alias("vibration"), F.avg("wear").alias("wear"), F.avg("load").alias("load"),
        zero(F.max("score"), "double").alias("defect_score"), zero(F.avg("confidence"), "double").alias("inspection_confidence"), zero(F.max("defect"), "int").alias("defect_flag"),
        n(is_("visit")).alias("maintenance_events"), zero(F.sum("hours"), "double").alias("maintenance_hours"), zero(share("corrective"), "double").alias("corrective_share"), zero(share("condition_based"), "double").alias("condition_share"),
        n(is_("failure")).alias("failures"), zero(F.sum("downtime_h"), "double").alias("failure_downtime_h"), zero(F.avg("severity"), "double").alias("failure_severity"), zero(F.max("repeated"), "int").alias("repeated"),
        n(is_("alert")).alias("alerts"), n(F.col("early") == 1).alias("early_alerts"), n(F.col("alert_severity") == "critical").alias("critical_alerts"), zero(share("attended"), "double").alias("attended_share"),
        F.max("age_days").alias("order_age"), F.max("risk").alias("order_risk"), F.max(F.expr(f"array_position({SEVERITIES}, order_severity)")).alias("order_severity"),
    )
    upto = Window.partitionBy("component_id").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda events: F.max(F.when(F.col(events) > 0, F.col("day"))).over(upto)
    return days.withColumns({"last_maintenance": last("maintenance_events"), "last_failure": last("failures")}).where("readings > 0").drop("readings")


def component_day_inputs(fleet: Fleet, days: DataFrame | None = None) -> DataFrame:
    """Component days with their component and the context of their line's day; days: component days with further columns.

    Everything joins by component, as the days lie; a component's units and their lines
    (one, as a rule) come as an array.
    """
    at = fleet.read_members.join(fleet.units.select("unit_id", "line_id"), "unit_id")
    at = at.groupBy("component_id").agg(F.collect_list(F.struct("unit_id", "line_id")).alias("_at"))
    days = days if days is not None else component_days(fleet)
    out = days.join(fleet.components.drop("unit_id"), "component_id").join(at, "component_id")
    line = F.explode(F.filter("_at", lambda x: x["unit_id"] == F.col("unit_id")))
    out = out.withColumn("_line", line).withColumn("line_id", F.col("_line.line_id")).drop("_at", "_line")
    return out.join(F.broadcast(fleet.context), ["day", "line_id"], "left")  # a row for each line and day


def failures_alerts(fleet: Fleet) -> DataFrame:
    """Full outer join of the alerts and the failures of a component's day."""
    alerts = fleet.alerts.groupBy(*DAY).agg(F.count("*").alias("alerts"), total(F.col("early") == 1).alias("early_alerts"), total(F.col("severity") == "critical").alias("critical_alerts"), share("attended").alias("attended_share"))
    failed = fleet.failures.groupBy(*DAY).agg(F.count("*").alias("failures"), F.sum("downtime_h").alias("downtime_h"), F.avg("severity").alias("mean_severity"), F.max("repeated").alias("repeated"))
    out = alerts.join(failed, DAY, "full")
    return out.select(*DAY, *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in out.dtypes if c not in DAY))


def failure_repetition(fleet: Fleet) -> DataFrame:
    grouped = fleet.failures.join(fleet.components.select("component_id", "kind"), "component_id").groupBy("kind", "mode", "unit_id", "component_id").agg(
        F.count("*").alias("events"), F.sum("repeated").alias("repeated_events"), F.sum("downtime_h").alias("downtime_h"), F.avg("severity").alias("mean_severity")
    )
    high = (F.col("events") >= 6) & (F.col("repeated_events") >= 3)
    return grouped.withColumn("segment", F.when(high, "structural_high").when(F.col("events") >= 3, "medium").otherwise("low"))


def unit_availability(fleet: Fleet) -> DataFrame:
    overdue = F.col("age_days") >= 14
    critical = ((F.col("age_days") >= 21) & F.coalesce("severity", F.lit("low")).isin("high", "critical")) | (F.coalesce("risk", F.lit(0.0)) >= 70)
    backlog = fleet.backlog.groupBy("day", "unit_id").agg(F.count("*").alias("backlog_items"), F.sum("risk").alias("backlog_risk"), total(overdue).alias("overdue_items"), total(critical).alias("critical_items"))
    shop = fleet.maintenance.groupBy("day", "unit_id").agg(F.sum("hours").alias("shop_hours"), share("corrective").alias("corrective_share"))
    out = fleet.service.join(backlog, ["day", "unit_id"], "left").join(shop, ["day", "unit_id"], "left")
    names = {"backlog_items": "long", "backlog_risk": "double", "overdue_items": "long", "critical_items": "long", "shop_hours": "double", "corrective_share": "double"}
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in names.items()})
    return out.withColumns({
        "overdue_ratio": guarded(F.col("overdue_items"), F.col("backlog_items")), "critical_ratio": guarded(F.col("critical_items"), F.col("backlog_items")), "availability": guarded(F.col("available_h"), F.col("planned_h")),
    })


def deterioration() -> Column:
    """0 to 100: age 30, cycles 25, wear 30, vibration 15 parts, each saturating."""
    part = lambda c, top, weight: F.least(F.coalesce(c, F.lit(0.0)), F.lit(top)) / top * weight
    total_ = part("age_ratio", 1.5, 30.0) + part("cycles_ratio", 1.5, 25.0) + part("wear", 140.0, 30.0) + part("vibration", 12.0, 15.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total_))


def mart_component_day(fleet: Fleet) -> DataFrame:
    w = Window.partitionBy("component_id").orderBy("day")
    rows = lambda n: w.rowsBetween(-n, 0)
    slope = F.col("sensor_mean") - F.lag("sensor_mean", 7).over(w)
    days = component_days(fleet).withColumns({
        "rolling_mean": F.avg("sensor_mean").over(rows(6)), "rolling_std": F.stddev_samp("sensor_mean").over(rows(6)), "rolling_change": slope, "rolling_abs_change": F.abs(slope),
        "alert_days_30": F.sum(F.when(F.col("alerts") > 0, 1).otherwise(0)).over(rows(29)).cast("long"), "failures_30": F.sum("failures").over(rows(29)), "maintenance_180": F.sum("maintenance_events").over(rows(179)),
    })
    return component_day_inputs(fleet, days).withColumns({
        "stress": F.col("load") * 0.45 + F.col("congestion") * 0.35 + F.abs(F.col("ambient") - 22) / 30 * 0.20, "deterioration": deterioration(),
    }).withColumn("health", 100.0 - F.col("deterioration"))


def component_health(mart: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return mart.select(
        *DAY, "kind", "sensor_mean", "rolling_mean", F.coalesce("rolling_std", zero).alias("rolling_std"), F.coalesce("rolling_change", zero).alias("rolling_change"), F.coalesce("rolling_abs_change", zero).alias("rolling_abs_change"), "stress", "deterioration", "health",
        F.when(F.col("critical_alerts") > 0, 1).otherwise(0).alias("critical_alert"), F.when(F.col("failures_30") > 0, 1).otherwise(0).alias("failed_before"),
    )


def mart_unit_day(fleet: Fleet, mart: DataFrame | None = None) -> DataFrame:
    mart = mart if mart is not None else mart_component_day(fleet)
    parts = mart.groupBy("day", "unit_id").agg(
        F.count("*").alias("component_count"), total(F.col("health") <= 35).alias("critical_components"), F.avg("health").alias("mean_health"), F.avg("deterioration").alias("mean_deterioration"), F.sum("failures").alias("failures"), F.sum("failure_downtime_h").alias("failure_downtime_h"),
        F.sum("alerts").alias("alerts"), F.sum("critical_alerts").alias("critical_alerts"), F.sum("maintenance_hours").alias("maintenance_hours"), F.avg("stress").alias("stress"), F.avg("repeated").alias("repeat_intensity"),
    )
    out = unit_availability(fleet).join(parts, ["day", "unit_id"], "left")
    raw = (F.col("overdue_items") * 0.75 + F.col("critical_items") * 1.20 + F.col("backlog_risk") / 90.0) / F.col("backlog_items") * 28.0
    exposure = F.when(F.col("backlog_items") > 0, F.least(F.lit(100.0), raw)).otherwise(F.lit(0.0))
    risk = (
        (100 - F.col("mean_health")) / 100 * 0.30 + F.least(F.col("critical_components"), F.lit(8)) / 8 * 0.20 + F.least(F.col("critical_ratio"), F.lit(1.0)) * 0.10 + F.col("exposure") / 100 * 0.05 + F.least(F.col("unavailable_h"), F.lit(24.0)) / 24 * 0.20 + F.least(F.col("substitution"), F.lit(1)) * 0.15
    )
    return out.withColumn("exposure", exposure).withColumn("risk", risk)


def unit_risk(mart: DataFrame) -> DataFrame:
    tier = F.when(F.col("risk") >= 0.75, "high").when(F.col("risk") >= 0.50, "medium").otherwise("low")
    return mart.select("day", "unit_id", "fleet_id", "critical_components", "risk", "unavailable_h", "backlog_items", "overdue_items", "critical_items", "exposure", "cancellations", "substitution", tier.alias("tier"))


def depot_pressure(fleet: Fleet, units: DataFrame) -> DataFrame:
    days = units.join(fleet.units.select("unit_id", "depot_id"), "unit_id").groupBy("day", "depot_id").agg(
        F.sum("backlog_items").alias("backlog_items"), F.sum("backlog_risk").alias("backlog_risk"), F.sum("overdue_items").alias("overdue_items"), F.sum("critical_items").alias("critical_items"), F.avg("exposure").alias("exposure"), F.sum("maintenance_hours").alias("maintenance_hours"), F.avg("risk").alias("mean_risk"), F.sum("unavailable_h").alias("unavailable_h"), F.sum("cancellations").alias("cancellations"), F.sum("substitution").alias("substitutions")
    )
    mix = fleet.maintenance.groupBy("day", "depot_id").agg(share("corrective").alias("corrective_share"), share("planned").alias("planned_share"))
    out = days.join(F.broadcast(fleet.depots), "depot_id").join(mix, ["day", "depot_id"], "left")
    load = F.col("maintenance_hours") + F.col("backlog_items") * 0.20 + F.col("overdue_items") * 0.35 + F.col("critical_items") * 0.75 + F.col("exposure") * 0.12 + F.col("unavailable_h") * 0.05
    return out.withColumns({"saturation": guarded(load, F.col("capacity")), "corrective_share": F.coalesce("corrective_share", F.lit(0.0)), "planned_share": F.coalesce("planned_share", F.lit(0.0))}).drop("speciality")


def mart_fleet_week(fleet: Fleet, units: DataFrame) -> DataFrame:
    week = F.trunc("day", "week").alias("week")
    weekly = units.groupBy(week, "fleet_id").agg(
        F.avg("availability").alias("availability"), F.sum("available_h").alias("available_h"), F.sum("failures").alias("failures"), F.sum("failure_downtime_h").alias("downtime_h"), F.sum("maintenance_hours").alias("maintenance_hours"), F.avg("repeat_intensity").alias("repeat_intensity"), F.avg("risk").alias("mean_risk"),
        F.sum("backlog_items").alias("backlog_items"), F.sum("backlog_risk").alias("backlog_risk"), F.sum("overdue_items").alias("overdue_items"), F.sum("critical_items").alias("critical_items"), F.avg("exposure").alias("exposure"),
    )
    mix = fleet.maintenance.join(fleet.units.select("unit_id", "fleet_id"), "unit_id").groupBy(week, "fleet_id").agg(share("corrective").alias("corrective_share"), share("condition_based").alias("condition_share"), share("planned").alias("planned_share"))
    some = F.col("failures") > 0
    out = weekly.join(mix, ["week", "fleet_id"], "left").withColumns({
        "mtbf": F.when(some, F.col("available_h") / F.col("failures")).otherwise(F.col("available_h")), "mttr": F.when(some, F.col("downtime_h") / F.col("failures")).otherwise(F.lit(0.0)),
    })
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("corrective_share", "condition_share", "planned_share")})
