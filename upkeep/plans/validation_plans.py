"""Queries of model validation over time: calibrated cuts, metrics by fold, readiness and the deployment gate, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from upkeep.operators import monitoring
from upkeep.plans import audit, catalogue
from upkeep.plans.catalogue import HORIZON, Query
from upkeep.sources.fleet import Fleet

#: Rows and failures that a calibrator needs: the driver's events span a month.
LEAST_ROWS, LEAST_EVENTS = 50, 5


def validated(f: Fleet) -> DataFrame:
    """Scores of each cut with outcomes and calibrated probabilities."""
    return f.stored("validated", lambda: monitoring.rolling_calibration(f.stored("cuts", lambda: catalogue._validation_cuts(f)), HORIZON, min_rows=LEAST_ROWS, min_events=LEAST_EVENTS))


def _folds(f: Fleet) -> DataFrame:
    return f.stored("folds", lambda: monitoring.fold_metrics(validated(f)))


def _readiness(f: Fleet) -> DataFrame:
    return monitoring.readiness(_folds(f), monitoring.drift(catalogue._features(f), audit.DRIFTING, HORIZON))


_DRIFT = audit.drift_sql()
_CHECKS = f"""(SELECT "check", CASE WHEN ok THEN 'passed' ELSE 'failed' END AS status, observed, threshold, NOT ok AS blocks FROM (
    SELECT 'external_historical_source' AS "check", false AS ok, 0.0::DOUBLE AS observed, 'external' AS threshold
    UNION ALL SELECT 'mature_temporal_folds', count(*) >= {monitoring.LEAST_FOLDS}, count(*), '>={monitoring.LEAST_FOLDS}' FROM foldmetrics WHERE fold <> 'overall'
    UNION ALL SELECT 'observed_failures', failures >= {monitoring.LEAST_FAILURES}, failures, '>={monitoring.LEAST_FAILURES}' FROM foldmetrics WHERE fold = 'overall'
    UNION ALL SELECT 'discrimination_roc_auc', coalesce(roc_auc >= {monitoring.LEAST_AUC}, false), roc_auc, '>={monitoring.LEAST_AUC:.2f}' FROM foldmetrics WHERE fold = 'overall'
    UNION ALL SELECT 'out_of_sample_calibration_error', coalesce(calibration_error <= {monitoring.MOST_ERROR}, false), calibration_error, '<={monitoring.MOST_ERROR:.2f}' FROM foldmetrics WHERE fold = 'overall'
    UNION ALL SELECT 'feature_drift_psi', max(psi) < {monitoring.MOST_PSI}, max(psi), '<{monitoring.MOST_PSI:.2f}' FROM {_DRIFT}))"""
_GATE = f"""(SELECT 'risk_model_autonomous_use' AS gate, 'synthetic' AS source_mode, NOT bool_or(blocks) AS allowed, CASE WHEN bool_or(blocks) THEN 'shadow' ELSE 'controlled' END AS mode, coalesce(string_agg("check", '|' ORDER BY "check") FILTER (blocks), '') AS failed_checks FROM {_CHECKS})"""
_FOLDS = "prevalence roc_auc average_precision top_decile_lift raw_brier calibrated_brier calibration_error"
Q: dict[str, Query] = {
    "temporal_validation": Query(validated, "cut component_id family y status", "score p", "calibrated"),
    "fold_metrics": Query(_folds, "fold rows failures calibrated_rows", _FOLDS, "foldmetrics"),
    "readiness_gate": Query(_readiness, "check status threshold blocks", "observed", _CHECKS),
    "deployment_gate": Query(lambda f: monitoring.deployment_gate(_readiness(f)), "gate source_mode allowed mode failed_checks", "", _GATE),
    "psi_drift": Query(lambda f: monitoring.drift(catalogue._features(f), ("health_index", "stress"), HORIZON), "feature level", "psi", audit.drift_sql(("health_index", "stress"))),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q.run for name, q in Q.items()}
SQL: dict[str, str] = {name: q.sql() for name, q in Q.items()}
