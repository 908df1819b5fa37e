"""Model monitoring: discrimination, calibration, rolling calibration and drift, by cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.functions.ordering import quantiles, running, value_ranks
from upkeep.functions.scalars import right_closed
from upkeep.sources.store import materialize


def roc_auc(df: DataFrame, outcome: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks; null without both outcomes."""
    ranked = value_ranks(df, score, [F.sum(F.col(outcome).cast("long")).alias("_p")], by)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("_rank") * F.col("_p")).alias("s"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*by, F.when((p > 0) & (n > 0), F.try_divide(F.col("s") - p * (p + 1) / 2, p * n)).alias("roc_auc"))


def average_precision(df: DataFrame, outcome: str = "y", score: str = "score", tie: str = "component_id", by: Sequence[str] = ()) -> DataFrame:
    """Mean of the precision at each hit, scores from high to low, ties by id."""
    sums = running(df, {"_hits": F.col(outcome), "_k": F.lit(1)}, [F.col(score).desc(), F.col(tie)], by)
    hits = sums.withColumn("_h", F.col("_hits") / F.col("_k"))
    return hits.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col(outcome) == 1, F.col("_h"))), F.sum(outcome).cast("double")).alias("average_precision"))


def top_lift(df: DataFrame, outcome: str = "y", score: str = "score", tie: str = "component_id", share: float = 0.10, by: Sequence[str] = ()) -> DataFrame:
    """Rate of outcomes in the top share against the rate of all."""
    ranked = running(df, {"_k": F.lit(1)}, [F.col(score).desc(), F.col(tie)], by)
    first = F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_k_total") * share))
    return ranked.groupBy(*by).agg(F.try_divide(F.avg(F.when(first, F.col(outcome))), F.avg(outcome)).alias("top_lift"))


def calibration_table(df: DataFrame, outcome: str = "y", probability: str = "p", bins: int = 10) -> DataFrame:
    """Rows, predicted and observed rate by bin of the probability, empty bins included."""
    edges = [i / bins for i in range(bins + 1)]
    found = df.where(F.col(probability).isNotNull()).groupBy(right_closed(F.col(probability), edges, first=True).alias("bin")).agg(F.count("*").alias("n_rows"), F.avg(probability).alias("predicted"), F.avg(outcome).alias("observed"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "predicted", "observed")


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg(F.try_divide(F.sum(F.col("n_rows") * F.abs(F.col("observed") - F.col("predicted"))), F.sum("n_rows")).alias("calibration_error"))


def brier(df: DataFrame, outcome: str = "y", probability: str = "p") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(probability) - F.col(outcome), 2)).alias("brier"))


def stability_index(reference: DataFrame, current: DataFrame, column: str, parts: int = 10) -> DataFrame:
    """Population stability index over the deciles of the reference; 0 with under two different bins."""
    cuts = quantiles(reference, {f"e{i}": (column, i / parts) for i in range(parts + 1)})
    edges = cuts.select(F.array_distinct(F.array_compact(F.array(*cuts.columns))).alias("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda x: F.col(column) > x)))
        return b.groupBy("bin").count().withColumn(name, F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).drop("count")

    grid = edges.select(F.explode(F.sequence(F.lit(0), F.greatest(F.size("e") - 2, F.lit(0)))).alias("bin"), (F.size("e") >= 3).alias("wide"))
    both = grid.join(shares(reference, "r"), "bin", "left").join(shares(current, "c"), "bin", "left")
    r, c = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(1e-6)) for x in ("r", "c"))
    return both.agg(F.sum(F.when(F.col("wide"), (c - r) * F.log(c / r)).otherwise(0.0)).alias("psi")).select(F.lit(column).alias("feature"), "psi")


def drift(features: DataFrame, columns: Sequence[str], days: int = 90) -> DataFrame:
    """psi and level of each column, first days against last days."""
    span = features.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dated = features.crossJoin(F.broadcast(span))
    first, last = dated.where(F.datediff("day", "a") < days), dated.where(F.datediff("b", "day") < days)
    out = None
    for c in columns:
        one = stability_index(first, last, c)
        out = one if out is None else out.union(one)
    return out.withColumn("level", F.when(F.col("psi") >= 0.25, "high").when(F.col("psi") >= 0.10, "moderate").otherwise("low"))


def rolling_calibration(scored: DataFrame, horizon: int = 30, parts: int = 10, min_rows: int = 500, min_events: int = 20) -> DataFrame:
    """scored (cut, component_id, score, y) with p: a monotone calibrator of all cuts that had matured by then.

    Bins are the deciles of the training scores, rates are smoothed by one success
    and one failure, and made monotone by a running maximum; null without enough
    history.
    """
    cuts = scored.select("cut").distinct()
    past = cuts.withColumnRenamed("cut", "judged").join(scored.withColumnRenamed("cut", "then"), F.datediff("judged", "then") >= horizon)
    past = materialize(past.select("judged", "score", "y"), "past")
    marks = quantiles(past, {f"e{i}": ("score", i / parts) for i in range(parts + 1)}, ["judged"])
    marks = marks.select("judged", F.array_distinct(F.array(*(f"e{i}" for i in range(parts + 1)))).alias("e"))
    edges = marks.join(past.groupBy("judged").agg(F.count("*").alias("n"), F.sum("y").alias("events")), "judged")
    edges = edges.where((F.col("n") >= min_rows) & (F.col("events") >= min_events) & (F.size("e") >= 4)).select("judged", F.slice("e", 2, F.size("e") - 2).alias("inner"))
    place = F.size(F.filter("inner", lambda x: F.col("score") >= x))
    rates = past.join(F.broadcast(edges), "judged").withColumn("bin", place).groupBy("judged", "bin").agg(((F.sum("y") + 1.0) / (F.count("*") + 2.0)).alias("rate"))
    grid = edges.select("judged", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin")).join(rates, ["judged", "bin"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.5)))
    rising = grid.withColumn("p", F.max("rate").over(Window.partitionBy("judged").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).drop("rate")
    out = scored.join(F.broadcast(edges), F.col("cut") == F.col("judged"), "left").withColumn("bin", F.when(F.col("inner").isNotNull(), place)).drop("judged", "inner")
    out = out.join(F.broadcast(rising.withColumnRenamed("judged", "cut")), ["cut", "bin"], "left").drop("bin")
    return out.withColumn("status", F.when(F.col("p").isNull(), "insufficient_history").otherwise("rolling"))


def fold_metrics(validation: DataFrame, share: float = 0.10, bins: int = 10) -> DataFrame:
    """A row for each cut and one, ``overall``, for all: rows, failures, prevalence, roc_auc, average_precision, top_decile_lift, raw_brier, calibrated_rows, calibrated_brier, calibration_error.

    validation: cut, component_id, score, y and p, which may be null.  One order by
    score within each fold gives places and running hits; they are summed by value of
    the score, so that equal scores share a rank, then by fold.  Equal scores stand by
    cut and component where an order needs one.  A figure without its outcomes is null.
    """
    c = F.col
    rows = validation.select("cut", "component_id", "score", "y", "p", F.explode(F.array(c("cut").cast("string"), F.lit("overall"))).alias("fold"))
    placed = running(rows, {"_k": F.lit(1), "_hits": c("y")}, [c("score").desc(), c("cut"), c("component_id")], ["fold"])
    top = c("_k") <= F.greatest(F.lit(1), F.ceil(c("_k_total") * share))
    values = placed.groupBy("fold", "score").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"), F.max("_k").alias("last"), F.max("_k_total").alias("total"), F.sum(F.when(c("y") == 1, c("_hits") / c("_k"))).alias("precision"), F.sum(F.when(top, c("y"))).alias("top_hits"), F.count_if(top).alias("top"),
        F.sum(F.pow(c("score") - c("y"), 2)).alias("raw"), F.count("p").alias("with_p"), F.sum(F.pow(c("p") - c("y"), 2)).alias("calibrated"),
    )
    rank = c("total") + 1 - (c("last") - (c("n") - 1) / 2)
    sums = values.groupBy("fold").agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("failures"), F.sum(rank * c("pos")).alias("ranks"), F.sum("precision").alias("precision"), F.sum("top_hits").alias("top_hits"), F.sum("top").alias("top"), F.sum("raw").alias("raw"), F.sum("with_p").alias("calibrated_rows"), F.sum("calibrated").alias("calibrated"),
    )
    edges = [i / bins for i in range(bins + 1)]
    by_bin = rows.where(c("p").isNotNull()).groupBy("fold", right_closed(c("p"), edges, first=True).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("o"), F.avg("p").alias("e"))
    errors = by_bin.groupBy("fold").agg((F.sum(c("n") * F.abs(c("o") - c("e"))) / F.sum("n")).alias("calibration_error"))
    pos, neg = c("failures"), c("rows") - c("failures")
    return sums.join(errors, "fold", "left").select(
        "fold", "rows", "failures", (pos / c("rows")).alias("prevalence"), F.when((pos > 0) & (neg > 0), (c("ranks") - pos * (pos + 1) / 2) / (pos * neg)).alias("roc_auc"), F.try_divide("precision", pos.cast("double")).alias("average_precision"),
        F.try_divide(c("top_hits") / c("top"), pos / c("rows")).alias("top_decile_lift"), (c("raw") / c("rows")).alias("raw_brier"), "calibrated_rows", F.try_divide("calibrated", c("calibrated_rows").cast("double")).alias("calibrated_brier"), "calibration_error",
    )


#: Fixed values of the checks between the model and autonomous use.
LEAST_FOLDS, LEAST_FAILURES, LEAST_AUC, MOST_ERROR, MOST_PSI = 6, 30, 0.65, 0.10, 0.25


def readiness(metrics: DataFrame, drifts: DataFrame, external: bool = False) -> DataFrame:
    """(check, status, observed, threshold, blocks) from fold metrics and a drift report; what could not be measured fails."""
    c = F.col
    overall = metrics.agg(F.count_if(c("fold") != "overall").alias("folds"), *(F.max(F.when(c("fold") == "overall", c(m))).alias(m) for m in ("failures", "roc_auc", "calibration_error")))
    one = overall.crossJoin(F.broadcast(drifts.agg(F.max("psi").alias("psi"))))  # one row each
    checks = [
        ("external_historical_source", F.lit(external), F.lit(float(external)), "external"), ("mature_temporal_folds", c("folds") >= LEAST_FOLDS, c("folds"), f">={LEAST_FOLDS}"), ("observed_failures", c("failures") >= LEAST_FAILURES, c("failures"), f">={LEAST_FAILURES}"),
        ("discrimination_roc_auc", c("roc_auc") >= LEAST_AUC, c("roc_auc"), f">={LEAST_AUC:.2f}"), ("out_of_sample_calibration_error", c("calibration_error") <= MOST_ERROR, c("calibration_error"), f"<={MOST_ERROR:.2f}"), ("feature_drift_psi", c("psi") < MOST_PSI, c("psi"), f"<{MOST_PSI:.2f}"),
    ]
    rows = [F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), seen.cast("double").alias("observed"), F.lit(limit).alias("threshold")) for n, ok, seen, limit in checks]
    return one.select(F.inline(F.array(*rows))).select("check", F.when(c("ok"), "passed").otherwise("failed").alias("status"), "observed", "threshold", (~c("ok")).alias("blocks"))


def deployment_gate(checks: DataFrame, external: bool = False) -> DataFrame:
    """One row: whether the model may act by itself, its operating mode, and the failed checks."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("blocks"), F.col("check")))), "|")  # six checks
    one = checks.agg((~F.bool_or("blocks")).alias("allowed"), failed.alias("failed_checks"))
    return one.select(F.lit("risk_model_autonomous_use").alias("gate"), F.lit("external" if external else "synthetic").alias("source_mode"), "allowed", F.when(F.col("allowed"), "controlled").otherwise("shadow").alias("mode"), "failed_checks")
