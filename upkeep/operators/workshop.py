"""Workshop planning: scores, depot ranking, calendar, queue, the capacity gate and stress scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.ordering import placed, scaled
from upkeep.functions.scalars import clip, filled

WINDOW_DAYS = {"D01_now": 2, "D02_window": 7, "D02B_blocked": 7, "D03_inspect": 3, "D04_monitor": 10, "D05_observe": 14, "D06_none": 21, "D07_conflict": 1}
EXTRA_HOURS = {"D01_now": 2.8, "D02_window": 1.8, "D02B_blocked": 1.8, "D03_inspect": 1.0, "D07_conflict": 0.6}
CARRY_DAYS = {"P1": 14, "P2": 21, "P3": 14, "P4": 10}
CAPTURE = {"booked": 1.0, "next_window": 0.65, "waits_parts": 0.28, "waits_capacity": 0.16, "waits_operation": 0.22, "escalate": 0.12}
HORIZON, CANDIDATES = 35, 3


def lookup(column: str, values: dict, default) -> Column:
    """The value of a fixed table by a column's text."""
    return F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in values.items()), F.lit(default))


def priority_scores(df: DataFrame) -> DataFrame:
    """priority, deferral and service scores of workshop inputs with failure_risk and rul_days."""
    priority = filled("technical_inputs", 0) * 0.45 + filled("service_inputs", 0) * 0.30 + filled("urgency_inputs", 0) * 0.15 + (100 - filled("efficiency_inputs", 50)) * 0.10
    df = scaled(df, {"_short": 365 - filled("rul_days", 365)})
    deferral = filled("deferral_inputs", 0) * 0.50 + filled("failure_risk", 0) * 100 * 0.30 + F.col("_short") * 100 * 0.20
    service = filled("service_inputs", 0) * 0.70 + filled("risk", 0) * 100 * 0.30
    return df.withColumns({"priority": clip(priority, 0, 100), "deferral": clip(deferral, 0, 100), "service": clip(service, 0, 100)}).drop("_short")


def rank_depots(cases: DataFrame, depots: DataFrame) -> DataFrame:
    """cases with depot (the best), fit (its score) and candidates (four best, by |); depots: depot_id, speciality, capacity, saturation.

    Depots are few, so each kind of case meets each of them; ties go to the smaller id.
    """
    match = F.when(F.lower("speciality").contains(F.lower("kind")), 1.0).otherwise(0.42)
    fit = match * 0.62 + (1 - clip(filled("saturation", 0.90), 0, 1.7) / 1.9) * 0.24 + F.least(F.col("capacity") / 95, F.lit(1.0)) * 0.14
    shops = depots.select(F.col("depot_id").alias("d"), "speciality", "capacity", "saturation")
    each = cases.select("kind").distinct().crossJoin(F.broadcast(shops))
    best = each.groupBy("kind").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round(clip(fit * 100, 0, 100), 6)).alias("f"), "d"))), 1, 4).alias("r"))
    both = cases.join(F.broadcast(best.withColumnRenamed("kind", "_kind")), F.col("kind").eqNullSafe(F.col("_kind"))).drop("_kind")  # a row for each kind
    return both.withColumns({"depot": F.col("r")[0]["d"], "fit": -F.col("r")[0]["f"], "candidates": F.array_join(F.transform("r", lambda x: x["d"].cast("string")), "|")}).drop("r")


def entry_order(cases: DataFrame) -> DataFrame:
    """entry: place by the weighted scores, ties by component."""
    score = F.round(F.col("priority") * 0.50 + F.col("deferral") * 0.30 + F.col("service") * 0.20, 9)
    return placed(cases, "entry", [score.desc(), F.col("component_id")])


def queue(cases: DataFrame) -> DataFrame:
    """Window, bucket, ageing, queue score, hours and delay cost of decided cases."""
    c = F.col
    df = cases.withColumn("window_days", lookup("decision", WINDOW_DAYS, 21))
    first = (c("decision") == "D01_now") | (c("priority") >= 88) | (c("deferral") >= 75) | ((filled("rul_days", 365) <= 12) & (c("failure_risk") >= 0.75))
    second = c("decision").isin("D02_window", "D02B_blocked", "D07_conflict") | (c("priority") >= 74) | (c("deferral") >= 60)
    third = c("decision").isin("D03_inspect", "D04_monitor") | (c("priority") >= 55)
    df = df.withColumn("bucket", F.when(first, "P1").when(second, "P2").when(third, "P3").otherwise("P4"))
    df = df.withColumn("ageing", clip(clip(22 - c("window_days"), 1, 21) / 21 * 100 + c("deferral") * 0.25, 0, 100))
    return df.withColumns({
        "queue_score": c("priority") * 0.58 + c("deferral") * 0.22 + c("service") * 0.12 + c("ageing") * 0.08, "hours": clip(2.0 + c("priority") / 25 + lookup("decision", EXTRA_HOURS, 0.0), 2, 14), "delay_cost": c("deferral") * 180 + c("service") * 95 + (100 - c("fit")) * 40,
    })


def capacity_calendar(depots: DataFrame, start: Column, horizon: int = HORIZON) -> DataFrame:
    """Regular and flexible hours by depot and day after ``start``; depots: depot_id, capacity, saturation."""
    sat = filled("saturation", 0.95)
    eased = F.when(sat > 1.15, 0.88).when(sat > 1.0, 0.94).when(sat < 0.75, 1.05).otherwise(1.0)
    df = depots.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("slot", F.date_add(start, F.col("offset")))
    weekend = F.when(F.weekday("slot") < 5, 1.0).when(F.weekday("slot") == 5, 0.75).otherwise(0.60)
    df = df.withColumn("regular_h", F.greatest(F.lit(4.0), F.greatest(F.lit(3.0), F.col("capacity") * 0.38 * eased) * weekend))
    flex = F.col("regular_h") * F.when(F.col("offset") <= 14, 0.10).otherwise(0.05)
    return df.select("depot_id", "offset", "slot", F.bround("regular_h", 4).alias("regular_h"), F.bround(flex, 4).alias("flex_h"))


#: Use of a day that counts as full, and the share of full days that makes it lasting.
FULL_DAY, FULL_SHARE = 0.85, 0.10


def capacity_gate(plan: DataFrame, ledger: DataFrame, trigger: float = FULL_DAY, day_share: float = FULL_SHARE) -> DataFrame:
    """One row: whether saturation is persistent and cases wait for capacity."""
    use = F.try_divide("used_h", "capacity_h")
    a = ledger.agg(F.coalesce(F.max(use), F.lit(0.0)).alias("max_utilisation"), F.coalesce(F.avg((use >= trigger).cast("double")), F.lit(0.0)).alias("saturated_share"))
    b = plan.agg(F.count_if(F.col("status") == "waits_capacity").alias("waiting"))
    return a.crossJoin(b).withColumn("required", (F.col("max_utilisation") >= trigger) & (F.col("saturated_share") >= day_share) & (F.col("waiting") > 0))


def stress_scenarios(plan: DataFrame, ledger: DataFrame, trigger: float = FULL_DAY) -> DataFrame:
    """Load under more demand and less capacity."""
    spark = plan.sparkSession
    cases = spark.createDataFrame([("baseline", 1.0, 1.0), ("demand_plus_15", 1.15, 1.0), ("capacity_minus_10", 1.0, 0.9), ("both", 1.15, 0.9)], "scenario string, demand double, capacity double")
    sums = ledger.agg(F.sum("capacity_h").alias("c"), F.sum("used_h").alias("u")).crossJoin(plan.agg(F.coalesce(F.sum(F.when(F.col("status") == "waits_capacity", F.col("hours"))), F.lit(0.0)).alias("w")))
    out = cases.crossJoin(F.broadcast(sums)).withColumns({"demand_h": (F.col("u") + F.col("w")) * F.col("demand"), "available_h": F.col("c") * F.col("capacity")})
    return out.select("scenario", "demand_h", "available_h", F.try_divide("demand_h", "available_h").alias("load"), (F.col("demand_h") > F.col("available_h") * trigger).alias("breach"))
