"""What-if grids: maintenance strategies under scenarios and sensitivities, and deferral of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.functions.scalars import clip

# Assumptions of strategies and scenarios, and levels of the sensitivities.
STRATEGIES = (("reactive", 0.16, 0.08, 0.22, 0.95, 0.0), ("preventive", 0.56, 0.28, 0.95, 0.62, 2400000.0), ("condition_based", 0.78, 0.74, 0.66, 0.48, 13000000.0))
SCENARIOS = (("conservative", 1.12, 0.90, 0.86, 1.20, 1.12, 1.08, 1.35), ("base", 1.00, 1.00, 1.00, 1.00, 1.00, 1.00, 1.00), ("aggressive", 0.93, 1.08, 1.12, 0.92, 0.94, 0.96, 0.92))
LEVELS = {"downtime_mult": (0.85, 1.00, 1.15), "failure_mult": (0.90, 1.00, 1.12), "capacity_mult": (0.90, 1.00, 1.10), "detection_mult": (0.85, 1.00, 1.15), "corrective_mult": (0.85, 1.00, 1.20), "preventive_mult": (0.90, 1.00, 1.15)}
COSTS = {"downtime_hour": 1300.0, "corrective_event": 16000.0, "preventive_event": 8000.0, "critical_case": 2500.0, "deferral_case": 5200.0, "impact_unit": 42000.0}
DEFERRALS = (0, 7, 14, 21, 30, 45)
OBSERVED = ("quality", "corrective", "preventive", "critical", "deferral", "downtime", "planned", "mtbf", "mttr", "impact", "repeated", "utilisation")


def observed(inspections: DataFrame, maintenance: DataFrame, failures: DataFrame, service: DataFrame, backlog: DataFrame, depots: DataFrame) -> DataFrame:
    """One row of base values from what the fleet has seen, rounded to three digits, so that sums in another order give the same grid."""
    last = backlog.join(F.broadcast(backlog.agg(F.max("day").alias("day"))), "day", "left_semi")
    parts = [
        inspections.agg(F.avg(F.when(F.col("defect") == 1, F.col("confidence"))).alias("quality")),
        maintenance.agg(F.sum("corrective").alias("corrective"), F.sum(F.col("planned") + F.col("condition_based")).alias("preventive"), F.sum("hours").alias("shop_hours")),
        last.agg(F.count_if((F.col("risk") >= 70) | (F.col("age_days") >= 21) & F.col("severity").isin("high", "critical")).alias("critical"), F.count_if(F.col("age_days") >= 14).alias("deferral")),
        failures.agg(F.sum("downtime_h").alias("downtime"), F.count("*").alias("failures"), F.sum("repeated").alias("repeated")),
        service.agg(F.sum("planned_h").alias("planned"), F.sum("available_h").alias("available"), F.avg(100 * F.col("punctuality_hit")).alias("impact"), F.count_distinct("day").alias("days")),
        depots.agg(F.sum("capacity").alias("capacity")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)
    per = {"mtbf": F.try_divide("available", "failures"), "mttr": F.try_divide("downtime", "failures"), "utilisation": F.try_divide(100 * F.col("shop_hours"), F.col("capacity") * F.col("days"))}
    return row.withColumns(per).select(*(F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 3).alias(c) for c in OBSERVED))


def strategy_grid(spark: SparkSession) -> DataFrame:
    """Scenario by sensitivity by strategy: 3 x 729 x 3 rows."""
    names = "scenario string, stress double, capacity double, detection double, downtime_cost double, corrective_cost double, preventive_cost double, enablement_mult double"
    grid = spark.createDataFrame(list(SCENARIOS), names)
    for name, levels in LEVELS.items():
        grid = grid.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in levels], f"{name} double")))
    return grid.crossJoin(F.broadcast(spark.createDataFrame(list(STRATEGIES), "strategy string, proactive double, predictive double, intensity double, dependence double, enablement double")))


def simulate(grid: DataFrame, observed: DataFrame) -> DataFrame:
    """Outcome and cost of each row of the grid; observed: one row of base values."""
    df = grid.crossJoin(F.broadcast(observed))
    c = F.col
    based = c("strategy") == "condition_based"
    df = df.withColumns({"_fail": c("stress") * c("failure_mult"), "_cap": clip(c("capacity") * c("capacity_mult"), 0.70, 1.20), "_q": clip(c("quality") * c("detection") * c("detection_mult"), 0.25, 1.40)})
    effective = F.when(based, c("predictive") * (0.55 + 0.45 * c("_q"))).otherwise(c("predictive"))
    factor = c("_fail") * (1 - 0.18 * c("proactive") - 0.10 * c("intensity")) * (1 - 0.14 * effective * (c("_q") - 1))
    df = df.withColumns({"_f": clip(factor, 0.60, 1.70), "_m": clip((1.05 - 0.18 * c("proactive")) / c("_cap"), 0.72, 1.35)})
    zero = lambda x: F.greatest(F.lit(0.0), x)
    df = df.withColumns({
        "corrective_events": c("corrective") * c("_f") * (0.82 + 0.36 * c("dependence")), "preventive_events": c("preventive") * (0.35 + c("intensity")) * (1.03 - 0.10 * c("_cap")),
        "critical_backlog": zero(c("critical") * (0.58 * c("_f") + 0.34 * (1 / c("_cap")) + 0.20 * c("dependence") - 0.12 * c("proactive") - 0.08 * c("intensity"))), "high_deferral": zero(c("deferral") * (0.48 * c("_f") + 0.30 * (1 / c("_cap")) + 0.22 * (1 - c("_q")))), "downtime_h": c("downtime") * c("_f") * c("_m"),
    })
    over = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    df = df.withColumns({
        "availability_pct": clip(100 * (1 - over("downtime_h", "planned")), 78.0, 99.5), "mtbf_h": c("mtbf") * (1 / F.greatest(c("_f"), F.lit(0.55))), "mttr_h": c("mttr") * c("_m"), "avoided_corrective": zero(c("corrective") - c("corrective_events")), "hours_preserved": zero(c("downtime") - c("downtime_h")), "service_impact": c("impact") * (0.60 + 0.40 * over("downtime_h", "downtime")),
        "utilisation_pct": clip(c("utilisation") * (0.55 * over("corrective_events", "corrective") + 0.45 * over("preventive_events", "preventive")), 35.0, 145.0), "repeated_failures": c("repeated") * c("_f") * (0.92 + 0.18 * c("dependence") - 0.14 * c("predictive")),
        "early_ratio": clip(c("preventive_events") / F.greatest(F.lit(1.0), c("corrective_events") + c("preventive_events")), 0.02, 0.98), "late_ratio": clip(c("corrective_events") / F.greatest(F.lit(1.0), c("corrective_events") + c("preventive_events")), 0.02, 0.98),
    })
    enabling = c("enablement") * c("enablement_mult") * F.when(based, (1 + 5.5 * zero(1.0 - c("_q"))) * (1 + 1.2 * zero(1.0 - c("_cap")))).otherwise(1.0)
    technical = c("corrective_events") * COSTS["corrective_event"] * c("corrective_cost") * c("corrective_mult") + c("preventive_events") * COSTS["preventive_event"] * c("preventive_cost") * c("preventive_mult") + c("critical_backlog") * COSTS["critical_case"] * (1 + 0.15 * (1 / c("_cap") - 1)) + c("high_deferral") * COSTS["deferral_case"] + enabling
    economic = c("downtime_h") * COSTS["downtime_hour"] * c("downtime_cost") * c("downtime_mult") + c("service_impact") * COSTS["impact_unit"]
    df = df.withColumns({"technical_cost": technical, "economic_cost": economic}).withColumn("total_cost", c("technical_cost") + c("economic_cost"))
    case = Window.partitionBy("scenario", *LEVELS)
    reactive = lambda x: F.max(F.when(c("strategy") == "reactive", c(x))).over(case)
    df = df.withColumns({"saving": reactive("total_cost") - c("total_cost"), "hours_gained": reactive("downtime_h") - c("downtime_h")})
    base = c("scenario") == "base"
    for name in LEVELS:
        base = base & (c(name) == 1.0)
    out = ["availability_pct", "mtbf_h", "mttr_h", "downtime_h", "critical_backlog", "high_deferral", "avoided_corrective", "hours_preserved", "service_impact", "utilisation_pct", "early_ratio", "late_ratio", "repeated_failures", "technical_cost", "economic_cost", "total_cost", "saving", "hours_gained"]
    return df.select("scenario", *LEVELS, "strategy", *out, base.cast("int").alias("base_point"))


def strategy_summary(simulated: DataFrame) -> DataFrame:
    """Range of the saving by strategy, and how often it saves."""
    return simulated.groupBy("strategy").agg(F.percentile("saving", 0.1).alias("p10"), F.percentile("saving", 0.5).alias("p50"), F.percentile("saving", 0.9).alias("p90"), F.avg("total_cost").alias("total_cost"), F.avg((F.col("saving") > 0).cast("double")).alias("saves_share"))


def strategy_ofat(simulated: DataFrame) -> DataFrame:
    """Mean cost by level of one sensitivity at a time: grouping sets over one expansion of the rows."""
    simulated.createOrReplaceTempView("_simulated")
    sets = ", ".join(f"(strategy, {n})" for n in LEVELS)
    level = ", ".join(LEVELS)
    name = "case " + " ".join(f"when {n} is not null then '{n}'" for n in LEVELS) + " end"
    return simulated.sparkSession.sql(f"select strategy, {name} as parameter, coalesce({level}) as level, avg(total_cost) as total_cost, avg(saving) as saving from _simulated group by grouping sets ({sets})")


def deferral_grid(cases: DataFrame, days: tuple[int, ...] = DEFERRALS) -> DataFrame:
    """Risk, downtime and cost of putting a case off; cases: component_id, failure_risk, priority, deferral, service."""
    c = F.col
    df = cases.withColumn("defer_days", F.explode(F.array(*(F.lit(d) for d in days))))
    more = F.least(F.lit(0.25), c("deferral") / 100 * 0.35 * (c("defer_days") / 45))
    df = df.withColumn("adjusted_risk", F.least(F.lit(0.98), c("failure_risk") + more))
    df = df.withColumn("downtime_h", c("adjusted_risk") * (2.2 + c("service") / 25) * (1 + c("defer_days") / 45))
    df = df.withColumn("impact_cost", c("downtime_h") * (250 + c("service") * 9))
    df = df.withColumn("total_cost", c("impact_cost") + c("adjusted_risk") * (1200 + c("priority") * 18))
    return df.select("defer_days", "component_id", "adjusted_risk", "downtime_h", "impact_cost", "total_cost")


def deferral_summary(grid: DataFrame) -> DataFrame:
    """Sums by delay and their difference from no delay."""
    sums = grid.groupBy("defer_days").agg(F.count("*").alias("cases"), F.sum("downtime_h").alias("downtime_h"), F.sum("total_cost").alias("total_cost"))
    first: Column = F.first("total_cost").over(Window.orderBy("defer_days").rowsBetween(Window.unboundedPreceding, 0))
    hours: Column = F.first("downtime_h").over(Window.orderBy("defer_days").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumns({"extra_cost": F.col("total_cost") - first, "extra_hours": F.col("downtime_h") - hours})
