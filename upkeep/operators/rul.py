"""Remaining useful life: a trend projection, a damage model by family, and their backtest.

All cut-offs run in one pass: a range join gives each cut its window of component
days, grouped regressions give the slopes, and column arithmetic does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.functions.scalars import clip, family, filled
from upkeep.sources.fleet import Fleet

# Failure threshold of health, daily damage, least and most days.
PROFILES = {"wheel": (38.0, 0.20, 4.0, 260.0), "brake": (36.0, 0.24, 3.0, 220.0), "bogie": (34.0, 0.16, 6.0, 320.0), "pantograph": (37.0, 0.27, 3.0, 200.0)}
BUCKETS = ((14, "00_<=14"), (30, "01_15_30"), (60, "02_31_60"), (90, "03_61_90"), (180, "04_91_180"))


def bucket(days: Column) -> Column:
    out = F.lit("05_>180")
    for top, name in reversed(BUCKETS):
        out = F.when(days <= top, name).otherwise(out)
    return out


def _profile(i: int) -> Column:
    out = F.lit(PROFILES["bogie"][i])
    for name, values in PROFILES.items():
        out = F.when(F.col("family") == name, values[i]).otherwise(out)
    return out


def window_days(features: DataFrame, cuts: DataFrame, window: int = 60) -> DataFrame:
    """Component days of each cut's window, numbered from 0; cuts: (cut date)."""
    d = features.join(F.broadcast(cuts), F.datediff("cut", "day").between(0, window - 1))
    w = Window.partitionBy("cut", "component_id")
    d = d.withColumn("x", (F.row_number().over(w.orderBy("day")) - 1).cast("double"))
    return d.withColumn("back", F.row_number().over(w.orderBy(F.col("day").desc())))


def trend_projection(days: DataFrame, least: int = 12) -> DataFrame:
    """Days until the trend of health meets 30, by cut and component."""
    out = days.groupBy("cut", "component_id").agg(F.count("*").alias("n"), F.regr_slope("health_index", "x").alias("s"), F.regr_r2("health_index", "x").alias("r2"), F.max_by("health_index", "day").alias("now"))
    enough = F.col("n") >= least
    out = out.withColumns({"trend_slope": F.when(enough, filled("s", 0)).otherwise(F.lit(-0.08)), "r2": F.when(enough, filled("r2", 0)).otherwise(F.lit(0.2))})
    falling = (F.col("now") - 30.0) / F.abs("trend_slope")
    days_left = F.when(F.round("trend_slope", 9) >= -0.02, F.lit(365)).otherwise(clip(falling, 1, 365).cast("int"))
    confidence = clip(0.35 + 0.5 * F.col("r2") + F.least("n", F.lit(60)) / 300, 0.30, 0.98)
    return out.select("cut", "component_id", days_left.alias("trend_days"), "trend_slope", confidence.alias("trend_confidence"))


def damage_projection(days: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Days until the health above the family's threshold is used up by daily damage, by cut and component.

    scores: (component_id, failure_risk), blended into the risk signal where given.
    """
    last = ["kind", "health_index", "deterioration_index", "velocity", "stress", "environment", "restoration", "maintenance_180", "repeated", "critical_alerts", "age_ratio", "cycles_ratio", "days_since_maintenance", "days_since_failure"]
    out = days.groupBy("cut", "component_id").agg(
        F.count("*").alias("n"), F.regr_slope("health_index", "x").alias("slope"), F.regr_slope(F.when(F.col("back") <= 30, F.col("health_index")), "x").alias("slope30"), F.max_by(F.struct(*last), "day").alias("l")
    ).select("cut", "component_id", "n", "slope", "slope30", "l.*")
    out = out.withColumn("family", family(F.col("kind"), order=("wheel", "brake", "pantograph", "bogie"), default="bogie"))
    out = out.withColumns({"slope": F.when(F.col("n") < 2, F.lit(-0.08)).otherwise(filled("slope", 0)), "slope30": F.when(F.col("n") < 2, F.lit(-0.08)).otherwise(filled("slope30", 0))})
    out = out.join(scores.select("component_id", "failure_risk"), "component_id", "left") if scores is not None else out.withColumn("failure_risk", F.lit(None).cast("double"))
    worn, fast = filled("deterioration_index", 40), filled("velocity", 3.5)
    alerts, repeated = filled("critical_alerts", 0), filled("repeated", 0) >= 1
    restored = filled("restoration", 22)
    proxy = 0.52 * clip(worn / 100.0, 0, 1) + 0.28 * clip(fast / 10.0, 0, 1) + 0.20 * clip(alerts / 3.0, 0, 1)
    out = out.withColumn("signal", clip(F.coalesce(0.52 * F.col("failure_risk") + 0.48 * proxy, proxy), 0.02, 0.98))
    signal = F.col("signal")
    easing = (1.0 - 0.28 * F.pow(clip(restored / 100.0, 0, 1), 1.1)) * F.when(F.col("days_since_maintenance") <= 21, 0.90).otherwise(1.0) * (1.0 - 0.05 * clip(filled("maintenance_180", 4) / 8.0, 0, 1))
    damage = (
        _profile(1) * (0.92 + 0.55 * F.pow(worn / 100.0, 1.40)) * (0.90 + 0.60 * F.pow(fast / 10.0, 1.20)) * (0.92 + 0.25 * clip((filled("stress", 0.85) - 0.75) / 0.25, 0, 1.2) + 0.10 * clip(filled("environment", 1.8) / 3.0, 0, 1.4))
        * (0.94 + 0.30 * clip(F.greatest(filled("age_ratio", 0.75), filled("cycles_ratio", 0.25)), 0, 2.2)) * (1.0 + 0.04 * clip(alerts, 0, 4)) * F.when(repeated, 1.16).otherwise(1.0) * (0.94 + 0.35 * signal) * (1.0 + 0.20 * clip(F.greatest(F.lit(0.0), -F.col("slope")) / 0.03, 0, 1.4)) * clip(easing, 0.58, 1.05)
    )
    out = out.withColumn("daily_damage", clip(damage, 0.05, 12))
    steeper = 1.0 + 0.22 * clip((worn - 60.0) / 40.0, 0, 1.2) + 0.18 * clip((signal - 0.60) / 0.40, 0, 1)
    left = F.greatest(F.lit(0.8), F.col("health_index") - _profile(0)) / (F.col("daily_damage") * steeper)
    left = left * F.when(repeated, 0.92).otherwise(1.0) * F.when(F.col("days_since_failure") <= 45, 0.88).otherwise(1.0) * F.when((restored >= 70) & (signal <= 0.35), 1.10).otherwise(1.0)
    out = out.withColumn("rul_exact", F.least(_profile(3), F.greatest(_profile(2), left)))
    fields = ["health_index", "deterioration_index", "velocity", "stress", "environment", "restoration", "maintenance_180", "critical_alerts", "age_ratio", "cycles_ratio"]
    complete = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)) / len(fields)
    steady = clip(1.0 - F.abs(F.col("slope30") - F.col("slope")) / (F.abs("slope") + 0.03), 0, 1)
    trust = 0.24 + 0.24 * complete + 0.20 * steady + 0.12 * clip(F.col("n") / 60.0, 0.2, 1) + 0.10 * clip(F.abs("slope") / 0.03, 0, 1) + 0.10 * (1.0 - signal)
    trust = trust * F.when(F.col("rul_exact") >= _profile(3) * 0.85, 0.88).otherwise(1.0) * F.when(repeated | (alerts >= 2), 0.94).otherwise(1.0)
    out = out.withColumn("rul_confidence", clip(trust, 0.25, 0.95))
    flag = F.when(F.col("rul_confidence") >= 0.78, "high").when(F.col("rul_confidence") >= 0.58, "medium").otherwise("low")
    return out.select("cut", "component_id", "family", "daily_damage", "signal", F.bround("rul_exact", 0).cast("int").alias("rul_days"), "rul_confidence", flag.alias("rul_flag"), bucket(F.col("rul_exact")).alias("bucket"))


def rul_snapshot(features: DataFrame, scores: DataFrame | None = None, window: int = 60, least: int = 12) -> DataFrame:
    """Both projections of every component at the last day."""
    cuts = features.agg(F.max("day").alias("cut"))
    days = window_days(features, cuts, window)
    return damage_projection(days, scores).join(trend_projection(days, least), ["cut", "component_id"])


def rul_backtest(features: DataFrame, fleet: Fleet, every: int = 30, horizon: int = 30, cuts: int = 12, window: int = 60, least: int = 12) -> DataFrame:
    """Projections at past cut-offs with whether a failure came in (cut, cut + horizon]."""
    span = features.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dates = span.select(F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("k"), "a", "b").select(F.date_sub("b", F.lit(horizon) + F.col("k") * every).alias("cut"), "a").where("cut >= a").select("cut")
    days = window_days(features, dates, window)
    both = damage_projection(days).join(trend_projection(days, least), ["cut", "component_id"])
    failed = fleet.failures.select("component_id", F.col("day").alias("failed"))
    hit = both.select("cut", "component_id").join(failed, "component_id").where(F.datediff("failed", "cut").between(1, horizon)).select("cut", "component_id").distinct().withColumn("failed", F.lit(1))
    out = both.join(hit, ["cut", "component_id"], "left")
    return out.select("cut", "component_id", "family", "trend_days", "rul_days", F.coalesce("failed", F.lit(0)).alias("failed"), bucket(F.col("trend_days")).alias("trend_bucket"), bucket(F.col("rul_days")).alias("rul_bucket"))


def rul_tables(backtest: DataFrame) -> DataFrame:
    """Share of cases, failure rate and quantiles of days by bucket of each method."""
    long_ = backtest.select("failed", F.explode(F.array(F.struct(F.lit("trend").alias("method"), F.col("trend_bucket").alias("bucket"), F.col("trend_days").alias("days")), F.struct(F.lit("damage").alias("method"), F.col("rul_bucket").alias("bucket"), F.col("rul_days").alias("days")))).alias("x")).select("failed", "x.*")
    out = long_.groupBy("method", "bucket").agg(F.count("*").alias("cases"), F.sum("failed").alias("failures"), F.percentile("days", 0.1).alias("p10"), F.percentile("days", 0.5).alias("p50"), F.percentile("days", 0.9).alias("p90"))
    w = Window.partitionBy("method")
    return out.withColumns({"failure_rate": F.col("failures") / F.col("cases"), "share": F.col("cases") / F.sum("cases").over(w)})


def bucket_entropy(tables: DataFrame) -> DataFrame:
    """Spread of the cases over the buckets, in bits."""
    return tables.groupBy("method").agg((-F.sum(F.col("share") * F.log2(F.col("share") + 1e-12))).alias("entropy"))
