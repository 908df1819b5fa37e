"""Health score, failure risk, drivers, confidence, unit score, ranking and evidence of the score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions.ordering import average_rank, placed, quantiles, scaled, value_ranks, with_quantiles
from upkeep.functions.scalars import clip, family, filled, right_closed
from upkeep.functions.temporal import asof
from upkeep.sources.store import materialize


def component_scores(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """df with family, health_score and failure_risk.

    Scaling and percent ranks are relative to the frame, or to its cuts by
    ``within``: a cut is scored as if it stood alone.
    """
    health = filled("health_index", 60) * 0.58 + clip(100 - filled("deterioration_index", 40), 0, 100) * 0.17 + clip(100 - filled("velocity", 0) * 10, 0, 100) * 0.12 + clip(100 - filled("defect_recent", 0), 0, 100) * 0.07 + filled("restoration", 0) * 0.10 - filled("exposed", 0) * 2.0
    weights = {"deterioration_index": (0.45, 40), "velocity": (0.22, 0), "stress": (0.12, 0.9), "anomalies_30": (0.08, 0), "shocks_30": (0.05, 0), "exposed": (0.05, 0), "repeated": (0.03, 0), "restoration": (-0.10, 0)}
    df = scaled(df, {f"_s_{c}": filled(c, d) for c, (_, d) in weights.items()}, within)
    raw = sum((F.lit(w) * F.col(f"_s_{c}") for c, (w, _) in weights.items()), F.lit(0.0))
    df = df.withColumn("family", family(F.col("kind"), order=("wheel", "brake", "pantograph", "bogie"), default="bogie"))
    df = df.withColumns({"health_score": clip(health, 5, 100), "_raw": F.round(clip(raw, 0, 1), 9)}).drop(*(f"_s_{c}" for c in weights))
    df = materialize(df, "raw")  # counted and joined for each rank
    df = average_rank(df, "_raw", "_in_family", [*within, "family"], share=True)
    df = average_rank(df, "_raw", "_in_all", within, share=True)
    pct = clip(0.60 * F.col("_in_family") + 0.40 * F.col("_in_all"), 0, 1)
    return df.withColumn("failure_risk", clip(0.03 + 0.88 * F.pow(pct, 1.55), 0.02, 0.95)).drop("_raw", "_in_family", "_in_all")


def main_driver(scored: DataFrame) -> DataFrame:
    """The largest contribution, the first of equals, under four overriding rules of which the last wins."""
    signal = filled("anomalies_30", 0) + 0.6 * filled("shocks_30", 0)
    df = scored.withColumns({"_signal": signal, "_stress": filled("stress", 0)})
    units = {
        "_worn": filled("deterioration_index", 40), "_velocity": filled("velocity", 0), "_defect": filled("defect_recent", 0), "_stressed": filled("stress", 0.9), "_anomalies": signal,
        "_backlog": filled("exposed", 0) + (filled("days_since_maintenance", 365) > 120).cast("int"), "_repetition": filled("repeated", 0) + (filled("days_since_failure", 365) < 60).cast("int"),
    }
    df = scaled(df, units)
    parts = {"degradation": F.col("_worn") * 0.45 + F.col("_velocity") * 0.35 + F.col("_defect") * 0.20, "stress": F.col("_stressed"), "anomalies": F.col("_anomalies"), "backlog": F.col("_backlog"), "repetition": F.col("_repetition")}
    best = F.array_max(F.array(*(F.struct(F.round(v, 9).alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(parts.items()))))
    df = with_quantiles(df.withColumn("_best", best).drop(*units), {"stress88": ("_stress", 0.88), "signal85": ("_signal", 0.85)})
    risk, worn = F.col("failure_risk"), filled("deterioration_index", 0)
    driver = (
        F.when((filled("repeated", 0) == 1) & (risk >= 0.50) & (worn < 75), "repetition")
        .when((F.col("_signal") >= F.col("signal85")) & (risk >= 0.50), "anomalies")
        .when((F.col("_stress") >= F.col("stress88")) & (worn < 80) & (risk >= 0.45), "stress")
        .when((filled("exposed", 0) == 1) & (risk >= 0.55), "backlog")
        .otherwise(F.col("_best.k"))
    )
    return df.withColumn("driver", driver).drop("_signal", "_stress", "_best", "stress88", "signal85")


def confidence(scored: DataFrame) -> DataFrame:
    """confidence_flag from completeness, freshness, inspections and calm, against bounded quantiles."""
    fields = ["sensor_mean", "sensor_std", "rolling_mean", "rolling_std", "deterioration_index", "stress", "velocity"]
    complete = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)) / len(fields)
    fresh = F.exp(-clip(filled("days_since_maintenance", 180), 0, 365) / 180.0)
    scored = scaled(scored, {"_restless": filled("anomalies_30", 0) + 0.5 * filled("shocks_30", 0)})
    calm = 1 - F.col("_restless")
    signal = complete * 0.45 + fresh * 0.20 + clip(filled("confidence_recent", 0.55), 0, 1) * 0.25 + calm * 0.10
    df = with_quantiles(scored.withColumn("quality", F.round(clip(signal, 0, 1), 9)).drop("_restless"), {"q20": ("quality", 0.20), "q70": ("quality", 0.70)})
    low = F.greatest(F.lit(0.35), F.least("q20", F.lit(0.60)))
    high = F.least(F.greatest("q70", low + 0.08), F.lit(0.90))
    return df.withColumn("confidence_flag", F.when(F.col("quality") >= high, "high").when(F.col("quality") >= low, "medium").otherwise("low")).drop("q20", "q70")


def unit_scores(scored: DataFrame) -> DataFrame:
    """Unavailability risk of a unit from its components' scores and its own features."""
    out = scored.groupBy("unit_id").agg(
        F.avg("failure_risk").alias("mean_risk"), F.percentile("failure_risk", 0.9).alias("p90_risk"), F.sum((F.col("failure_risk") >= 0.65).cast("int")).alias("high_risk"), F.count("*").alias("component_count"), F.avg("deterioration_index").alias("mean_deterioration"), F.avg("risk").alias("risk"), F.avg("service_impact").alias("service_impact"), F.max("fleet_dependency").alias("fleet_dependency")
    )
    score = F.col("mean_risk") * 100 * 0.30 + F.col("p90_risk") * 100 * 0.22 + filled("risk", 0) * 100 * 0.18 + filled("service_impact", 0) * 0.12 + filled("mean_deterioration", 0) * 0.08 + F.col("high_risk") / F.col("component_count") * 100 * 0.10 + filled("fleet_dependency", 0) * 3.0
    return out.withColumn("unit_score", clip(score, 0, 100))


def business_ranking(scored: DataFrame, units: DataFrame) -> DataFrame:
    """business_risk and its rank from 1; ties by component."""
    df = scored.join(units.select("unit_id", "unit_score"), "unit_id", "left")
    risk = clip(F.col("failure_risk") * 100 * 0.7 + (100 - F.col("health_score")) * 0.2 + filled("unit_score", 0) * 0.1, 0, 100)
    df = df.withColumn("business_risk", F.round(risk, 9))
    return placed(df, "rank", [F.col("business_risk").desc(), F.col("component_id")])


def history(features: DataFrame, failures: DataFrame, days: int = 30) -> DataFrame:
    """Component days with whether a failure follows within ``days``, the day itself included."""
    df = asof(features.select("component_id", "day", "deterioration_index"), failures, "component_id", "day", "day", "_next", forward=True)
    return df.withColumn("fails", F.coalesce(F.datediff("_next", "day").between(0, days), F.lit(False)).cast("int")).drop("_next")


def evidence_bins(past: DataFrame) -> DataFrame:
    """Failure rate by bin of deterioration, empty bins included."""
    edges = [-1, 20, 40, 60, 80, 100]
    found = past.groupBy(right_closed(F.col("deterioration_index"), edges).alias("bin")).agg(F.count("*").alias("days"), F.sum("fails").alias("failures"))
    bins = past.sparkSession.createDataFrame([(i,) for i in range(len(edges) - 1)], "bin int")
    out = bins.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("days", F.lit(0)).cast("long").alias("days"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))
    return out.withColumn("rate", F.round(F.try_divide("failures", "days"), 4))


def confusion(past: DataFrame, threshold: float = 55) -> DataFrame:
    """tp, fp, fn, precision and recall of a threshold on deterioration."""
    warned, failed = F.col("deterioration_index") >= threshold, F.col("fails") == 1
    out = past.agg(F.count_if(warned & failed).alias("tp"), F.count_if(warned & ~failed).alias("fp"), F.count_if(~warned & failed).alias("fn"))
    part = lambda b: F.round(F.col("tp") / F.greatest(F.col("tp") + F.col(b), F.lit(1)), 4)
    return out.withColumns({"precision": part("fp"), "recall": part("fn")})


def spearman(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rank correlation of each feature with the target; 0 where either is constant.  Nulls count as the median.

    The target's centred ranks are summed by value of a feature, so ranks of the
    feature needn't be joined back to the rows.
    """
    medians = quantiles(df, {f"_m_{c}": (c, 0.5) for c in features})
    df = df.crossJoin(F.broadcast(medians)).select(F.col(target).alias("_y"), *(F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in features))
    ranked = average_rank(df, "_y", "_ry").unpivot(["_ry"], list(features), "feature", "value")
    middle = ranked.groupBy("feature").agg(F.avg("_ry").alias("_m"))
    ranked = ranked.join(F.broadcast(middle), "feature").withColumn("_ry", F.col("_ry") - F.col("_m"))  # a row for each feature
    values = value_ranks(ranked, "value", [F.sum("_ry").alias("_s"), F.sum(F.col("_ry") * F.col("_ry")).alias("_s2")], ["feature"])
    rank = F.col("_rank") - (F.col("_rows") + 1) / 2
    sums = values.groupBy("feature").agg(F.sum(rank * F.col("_s")).alias("xy"), F.sum(rank * rank * F.col("_n")).alias("xx"), F.sum("_s2").alias("yy"))
    return sums.select("feature", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy")).otherwise(F.lit(0.0)).alias("correlation"))


def segments(scored: DataFrame) -> DataFrame:
    return scored.groupBy("family").agg(F.count_distinct("component_id").alias("components"), F.avg("health_score").alias("health_score"), F.avg("failure_risk").alias("failure_risk"))
