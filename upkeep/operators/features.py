"""Feature tables: component-day, unit-day, fleet-week and workshop inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.functions.ordering import quantiles, with_quantiles
from upkeep.functions.scalars import clip, filled
from upkeep.sources.fleet import Fleet

SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def backlog_component_day(backlog: DataFrame) -> DataFrame:
    """Open orders of a component's day as one: the oldest, the riskiest, the most severe."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(r)) for s, r in SEVERITY_RANK.items()), F.lit(0))
    out = backlog.groupBy("day", "unit_id", "component_id").agg(F.max("age_days").alias("age_days"), F.max("risk").alias("order_risk"), F.max(rank).alias("r"))
    name = F.coalesce(*(F.when(F.col("r") == r, F.lit(s)) for s, r in SEVERITY_RANK.items()), F.lit("low"))
    return out.select("day", "unit_id", "component_id", "age_days", "order_risk", name.alias("severity"))


def days_since(base: DataFrame, events: DataFrame, out: str) -> DataFrame:
    """Days from the component's last event up to each day; null before the first.

    A component's event days come as one array (at most a day each of the
    history), so that the join goes by component alone and leaves its buckets in place;
    the latest of those up to a day is its last event.
    """
    days = events.where(F.col("day").isNotNull()).groupBy("component_id").agg(F.collect_set("day").alias("_days"))
    joined = base.join(days, "component_id", "left")
    return joined.withColumn(out, F.datediff("day", F.array_max(F.filter("_days", lambda d: d <= F.col("day"))))).drop("_days").select(*base.columns, out)


def with_backlog(base: DataFrame, backlog: DataFrame) -> DataFrame:
    """base with age_days, order_risk and severity of its component's open orders, null without any; joined by component, with its snapshots (one a week) in a map by unit and day."""
    at = F.struct("unit_id", "day")
    orders = backlog_component_day(backlog.repartition("component_id")).groupBy("component_id").agg(F.map_from_entries(F.collect_list(F.struct(at, F.struct("age_days", "order_risk", "severity")))).alias("_orders"))
    joined = base.join(orders, "component_id", "left").withColumn("_o", F.try_element_at("_orders", at))
    return joined.select(*base.columns, *(F.col(f"_o.{c}").alias(c) for c in ("age_days", "order_risk", "severity")))


def component_day_features(fleet: Fleet, mart: DataFrame) -> DataFrame:
    """Shocks, anomalies, recency, exposure, degradation velocity, restoration and the health index.

    Recency is the as-of distance for every component.  Health: high is good;
    deterioration and velocity: high is bad.
    """
    df = with_quantiles(mart, {"std35": ("sensor_std", 0.35), "std75": ("sensor_std", 0.75), "std95": ("sensor_std", 0.95), "change95": ("rolling_abs_change", 0.95), "stress95": ("stress", 0.95), "ambient50": ("ambient", 0.5)})
    least = F.greatest(filled("std35", 0), F.lit(0.05))
    scale = F.greatest(F.coalesce(F.nullif(F.coalesce("rolling_std", "sensor_std"), F.lit(0.0)), least), F.lit(0.05))
    residual = filled(F.col("sensor_max") - F.col("rolling_mean"), 0)
    df = df.withColumn("shock", F.coalesce(((residual / scale) >= 2.9) & (residual >= F.col("std75") * 0.6), F.lit(False)).cast("int"))
    odd = F.coalesce(F.col("sensor_std") >= F.col("std95"), F.lit(False)) | F.coalesce(F.col("stress") > 1.25, F.lit(False)) | (F.col("critical_alerts") >= 2) | (F.col("shock") == 1)
    df = df.withColumn("anomaly", odd.cast("int"))
    w = Window.partitionBy("component_id").orderBy("day")
    df = df.withColumns({
        "anomalies_30": F.sum("anomaly").over(w.rowsBetween(-29, 0)), "shocks_30": F.sum("shock").over(w.rowsBetween(-29, 0)), "defect_recent": F.max("defect_score").over(w.rowsBetween(-13, 0)), "confidence_recent": F.avg("inspection_confidence").over(w.rowsBetween(-13, 0)),
    })
    df = df.withColumns({f"days_since_{e}": F.datediff("day", f"last_{e}") for e in ("maintenance", "failure")})
    df = df.withColumn("environment", clip(F.abs(F.col("ambient") - F.col("ambient50")) / 18.0 + F.abs(F.col("humidity") - 50) / 55.0 + filled("intensity", 1.0) * 0.65 + filled("congestion", 0.4) * 0.9, 0, 4.5))
    top = quantiles(fleet.backlog, {"risk80": ("risk", 0.8)}).select(F.coalesce("risk80", F.lit(40.0)).alias("risk80"))
    df = df.crossJoin(F.broadcast(top))
    exposed = (F.coalesce("order_age", F.lit(0)) >= 25) | F.coalesce(F.col("order_risk") >= F.col("risk80"), F.lit(False)) | (F.coalesce("order_severity", F.lit(0)) >= SEVERITY_RANK["high"])
    at_least_1 = lambda c: F.greatest(filled(c, 0), F.lit(1.0))
    velocity = 2.10 * clip(filled("sensor_std", 0) / at_least_1("std95"), 0, 2.5) + 1.35 * clip(filled("rolling_abs_change", 0) / at_least_1("change95"), 0, 2.5) + 1.05 * clip(F.col("shocks_30") / 30.0, 0, 1) + 0.95 * clip(filled("stress", 0) / at_least_1("stress95"), 0, 2) + 1.25 * (filled("deterioration", 0) / 100.0)
    since = F.greatest(filled("days_since_maintenance", 3650), F.lit(0.0))
    restored = 100 * (0.65 * F.exp(-since / 180.0) + 0.35 * clip(F.col("maintenance_180") / 6.0, 0, 1))
    df = df.withColumns({"exposed": exposed.cast("int"), "velocity": clip(velocity, 0, 10), "restoration": clip(restored, 0, 100)})
    index = clip(filled("health", 55), 0, 100) * 0.52 + clip(100 - F.col("velocity") * 10, 0, 100) * 0.18 + clip(100 - filled("defect_recent", 0), 0, 100) * 0.12 + F.col("restoration") * 0.10 - F.col("critical_alerts") * 0.65 - F.col("exposed") * 2.0 + 14.0
    df = df.withColumn("health_index", clip(index, 1, 100))
    return df.withColumn("deterioration_index", clip(100 - F.col("health_index"), 0, 100)).drop("std35", "std75", "std95", "change95", "stress95", "ambient50", "risk80", "last_maintenance", "last_failure", "order_age", "order_risk", "order_severity")


def _service_load(df: DataFrame) -> DataFrame:
    """df, unit days with the unit's service_criticality, with service_exposure, hours_lost_30 and cancelled."""
    exposure = filled("planned_h", 0) * (1 + F.col("cancellations") * 0.15) * (1 + filled("service_criticality", 3.5) / 10)
    w = Window.partitionBy("unit_id").orderBy("day").rowsBetween(-29, 0)
    return df.withColumns({"service_exposure": clip(exposure, 0, 80), "hours_lost_30": F.sum("unavailable_h").over(w), "cancelled": F.col("cancellations").cast("double")})


def unit_service(fleet: Fleet) -> DataFrame:
    """What unit features need of all unit days: (day, unit_id, punctuality_hit, service_exposure, hours_lost_30, cancelled)."""
    days = fleet.service.join(fleet.units.select("unit_id", "service_criticality"), "unit_id")
    return _service_load(days).select("day", "unit_id", "punctuality_hit", "service_exposure", "hours_lost_30", "cancelled")


def unit_day_features(fleet: Fleet, units: DataFrame, features: DataFrame, service: DataFrame | None = None) -> DataFrame:
    """Maintenance load, service exposure, substitution difficulty, service impact and dependency of a unit's day.

    service: ``unit_service``, where ``units`` holds some days only; hours lost so far and
    the quantiles are of all.
    """
    parts = features.groupBy("day", "unit_id").agg(F.avg("health_index").alias("mean_health_index"), F.sum((F.col("health_index") < 55).cast("int")).alias("risk_components"), F.avg("alert_days_30").alias("alert_density"), F.avg("criticality").alias("mean_criticality"))
    homes = fleet.units.select("unit_id", "configuration", "service_criticality")
    df = units.join(parts, ["day", "unit_id"], "left").join(homes, "unit_id")
    load = filled("maintenance_hours", 0) * 0.65 + F.col("backlog_items") * 0.30 + F.col("overdue_items") * 0.60 + F.col("critical_items") * 1.00 + F.col("exposure") * 0.12
    wanted = {"lost95": ("hours_lost_30", 0.95), "cancel95": ("cancelled", 0.95), "late95": ("punctuality_hit", 0.95), "exposure85": ("service_exposure", 0.85)}
    if service is None:
        df = with_quantiles(_service_load(df), wanted)
    else:
        df = df.join(service.drop("punctuality_hit"), ["day", "unit_id"]).crossJoin(F.broadcast(quantiles(service, wanted)))  # one row
    longer = F.when(F.coalesce("configuration", F.lit("")).rlike("6_cars|5_cars"), 16).otherwise(8)
    df = df.withColumns({"maintenance_load": clip(load, 0, 100), "substitution_difficulty": clip(F.col("substitution") * 45 + F.col("service_exposure") / 2.2 + longer, 0, 100)})
    norm = lambda c, q: clip(filled(c, 0) / F.greatest(F.col(q), F.lit(1.0)), 0, 1.4)
    impact = clip((norm("hours_lost_30", "lost95") * 0.52 + norm("cancelled", "cancel95") * 0.28 + norm("punctuality_hit", "late95") * 0.20) * 100, 0, 100)
    fleets = units.groupBy("fleet_id").agg(F.count_distinct("unit_id").alias("fleet_size"))
    lines = units.groupBy("day", "line_id").agg(F.count_distinct("unit_id").alias("line_units"))
    df = df.withColumn("service_impact", impact).join(F.broadcast(fleets), "fleet_id", "left").join(lines, ["day", "line_id"], "left")
    bound = (F.col("fleet_size") <= 22) | (F.col("line_units") <= 5) | (F.col("service_exposure") >= F.col("exposure85"))
    return df.withColumn("fleet_dependency", bound.cast("int")).drop("lost95", "cancel95", "late95", "exposure85", "cancelled")


def fleet_week_features(fleet: Fleet, weeks: DataFrame, depots: DataFrame) -> DataFrame:
    """Pressure of the depots that serve a fleet, averaged over depot days, and of its backlog."""
    bridge = fleet.units.select("fleet_id", "depot_id").distinct()
    pressure = depots.join(F.broadcast(bridge), "depot_id").groupBy(F.trunc("day", "week").alias("week"), "fleet_id").agg(F.avg("saturation").alias("depot_pressure"))
    out = weeks.join(pressure, ["week", "fleet_id"], "left")
    return out.withColumns({"depot_pressure": F.coalesce("depot_pressure", F.col("exposure") / 100), "backlog_pressure": clip(filled("exposure", 0) * 0.75 + clip(filled(F.col("critical_items").cast("double"), 0), 0, 300) * 0.25, 0, 100)})


def latest(df: DataFrame, day: str = "day") -> DataFrame:
    """Rows of the last day."""
    return df.join(F.broadcast(df.agg(F.max(day).alias(day))), day, "left_semi")


def latest_nonzero(df: DataFrame, value: str, day: str = "day") -> DataFrame:
    """Rows of the last day on which the value's sum isn't zero; of the last day if there is none."""
    sums = df.groupBy(day).agg(F.sum(value).alias("v"))
    pick = sums.agg(F.coalesce(F.max(F.when(F.col("v") > 0, F.col(day))), F.max(day)).alias(day))
    return df.join(F.broadcast(pick), day, "left_semi")


def spec_match(kind: Column, speciality: Column) -> Column:
    """1 where the depot's speciality names the kind, 0.75 for kin of a bogie shop, else 0.35."""
    shop = F.lower(speciality)
    kin = shop.contains("bogie") & F.lower(kind).isin("wheel_profile", "bogie_frame", "brake_disc")
    return F.when(shop.contains(F.lower(kind)), 1.0).when(kin, 0.75).otherwise(0.35)


def workshop_features(fleet: Fleet, features: DataFrame, unit_features: DataFrame, depots: DataFrame) -> DataFrame:
    """Urgency, technical, service, efficiency and deferral inputs of each component on the last day."""
    now = latest(features).drop("line_id", "load")
    units = latest(unit_features).select("unit_id", "service_exposure", "service_impact", "risk", "fleet_dependency", "substitution_difficulty", F.col("exposure").alias("unit_exposure"))
    homes = fleet.units.select("unit_id", "depot_id", "service_criticality")
    load = latest(depots).select("depot_id", "saturation", F.col("exposure").alias("depot_exposure"))
    shops = fleet.depots.select("depot_id", "speciality")
    df = now.join(units, "unit_id", "left").join(homes, "unit_id").join(F.broadcast(load), "depot_id", "left").join(F.broadcast(shops), "depot_id", "left")
    urgency = filled("deterioration_index", 40) * 0.45 + filled("velocity", 0) * 7.5 + F.col("critical_alerts") * 3.8 + F.col("shocks_30") * 1.2 - filled("restoration", 0) * 0.10
    df = df.withColumn("urgency_inputs", clip(urgency, 0, 100))
    efficiency = spec_match(F.col("kind"), F.coalesce("speciality", F.lit(""))) * 55 + (1 - clip(filled("saturation", 0.75), 0, 1.4) / 1.4) * 30 + (1 - clip(filled("depot_exposure", 35), 0, 100) / 100) * 15
    df = df.withColumns({
        "technical_inputs": clip(F.col("urgency_inputs") * 0.55 + filled("criticality", 3.5) * 8.0 + filled("repeated", 0) * 12, 0, 100),
        "service_inputs": clip(filled("service_impact", 0) * 0.45 + filled("service_exposure", 0) * 0.38 + filled("substitution_difficulty", 0) * 0.17, 0, 100),
        "efficiency_inputs": clip(efficiency, 0, 100),
    })
    deferral = F.col("technical_inputs") * 0.4 + F.col("service_inputs") * 0.3 + filled("risk", 0) * 100 * 0.2 + clip(filled("unit_exposure", 0), 0, 100) * 0.1
    return df.withColumn("deferral_inputs", clip(deferral, 0, 100))


def operating_windows(fleet: Fleet, days: int = 7, least_h: float = 4.0) -> DataFrame:
    """(unit_id, windows): of the last days those on which a unit stood still for at least ``least_h`` hours, long enough for a visit."""
    last = fleet.service.join(F.broadcast(fleet.span.select("last_day")), F.datediff("last_day", "day") < days)  # one row
    return last.groupBy("unit_id").agg(F.count_if(F.col("unavailable_h") >= least_h).cast("double").alias("windows"))
