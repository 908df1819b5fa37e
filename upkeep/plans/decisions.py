"""Queries from remaining life to decided cases, with SQL that follows the operators step by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.operators import governance, rul, rules, workshop
from upkeep.plans import catalogue
from upkeep.plans.catalogue import HORIZON, LEAST, WINDOW, Query, cases
from upkeep.plans.ctes import CTES, clip, family
from upkeep.sources.fleet import Fleet


def _lookup(column: str, values: dict, default) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {quoted(default)} END"


def _steps(source: str, *steps: dict[str, str]) -> str:
    """Columns added to a source one step after the other."""
    for step in steps:
        source = "(SELECT *, " + ", ".join(f"{x} AS {name}" for name, x in step.items()) + f" FROM {source})"
    return source


def _window_days(cuts: str) -> str:
    order = "OVER (PARTITION BY cut, component_id ORDER BY day"
    return f"(SELECT f.*, cut, row_number() {order}) - 1 AS x, row_number() {order} DESC) AS back FROM feat f JOIN {cuts} c ON date_diff('day', f.day, cut) BETWEEN 0 AND {WINDOW - 1})"


def _trend(days: str) -> str:
    sums = f"(SELECT cut, component_id, count(*) AS n, regr_slope(health_index, x) AS s, regr_r2(health_index, x) AS q, arg_max(health_index, day) AS now FROM {days} GROUP BY 1, 2)"
    lines = {"trend_slope": f"CASE WHEN n >= {LEAST} THEN coalesce(s, 0) ELSE -0.08 END", "r2": f"CASE WHEN n >= {LEAST} THEN coalesce(q, 0) ELSE 0.2 END"}
    return _steps(sums, lines, {"trend_days": f"CASE WHEN round(trend_slope, 9) >= -0.02 THEN 365 ELSE trunc({clip('(now - 30) / abs(trend_slope)', 1, 365)})::INT END"})


def _damage(days: str, scores: bool) -> str:
    """The damage model; scores: whether the risk of the last day's scores enters the signal."""
    profile = lambda i: _lookup("family", {k: v[i] for k, v in rul.PROFILES.items()}, rul.PROFILES["bogie"][i])
    slopes = f"(SELECT cut, component_id, count(*) AS n, regr_slope(health_index, x) AS s, regr_slope(CASE WHEN back <= 30 THEN health_index END, x) AS s30 FROM {days} GROUP BY 1, 2)"
    risk = "(SELECT component_id, failure_risk FROM scored)" if scores else "(SELECT NULL::BIGINT AS component_id, NULL::DOUBLE AS failure_risk)"
    rows = f"(SELECT l.*, n, s, s30, k.failure_risk, {family('kind', 'wheel brake pantograph bogie', 'bogie')} AS family FROM {slopes} g JOIN {days} l ON l.cut = g.cut AND l.component_id = g.component_id AND l.back = 1 LEFT JOIN {risk} k ON k.component_id = g.component_id)"
    worn, fast, alerts, restored = "coalesce(deterioration_index, 40)", "coalesce(velocity, 3.5)", "coalesce(critical_alerts, 0)::DOUBLE", "coalesce(restoration, 22)"
    repeated = "(coalesce(repeated, 0) >= 1)"
    easing = f"(1.0 - 0.28 * pow({clip(restored + ' / 100', 0, 1)}, 1.1)) * CASE WHEN days_since_maintenance <= 21 THEN 0.90 ELSE 1.0 END * (1.0 - 0.05 * {clip('coalesce(maintenance_180, 4) / 8', 0, 1)})"
    damage = " * ".join((
        profile(1), f"(0.92 + 0.55 * pow({worn} / 100, 1.40))", f"(0.90 + 0.60 * pow({fast} / 10, 1.20))", f"(0.92 + 0.25 * {clip('(coalesce(stress, 0.85) - 0.75) / 0.25', 0, 1.2)} + 0.10 * {clip('coalesce(environment, 1.8) / 3', 0, 1.4)})",
        f"(0.94 + 0.30 * {clip('greatest(coalesce(age_ratio, 0.75), coalesce(cycles_ratio, 0.25))', 0, 2.2)})", f"(1.0 + 0.04 * {clip(alerts, 0, 4)})", f"CASE WHEN {repeated} THEN 1.16 ELSE 1.0 END", "(0.94 + 0.35 * signal)", f"(1.0 + 0.20 * {clip('greatest(0, -slope) / 0.03', 0, 1.4)})", clip(easing, 0.58, 1.05),
    ))
    fields = ("health_index", "deterioration_index", "velocity", "stress", "environment", "restoration", "maintenance_180", "critical_alerts", "age_ratio", "cycles_ratio")
    left = f"greatest(0.8, health_index - {profile(0)}) / (daily_damage * (1.0 + 0.22 * {clip(f'({worn} - 60) / 40', 0, 1.2)} + 0.18 * {clip('(signal - 0.60) / 0.40', 0, 1)})) * CASE WHEN {repeated} THEN 0.92 ELSE 1.0 END * CASE WHEN days_since_failure <= 45 THEN 0.88 ELSE 1.0 END * CASE WHEN {restored} >= 70 AND signal <= 0.35 THEN 1.10 ELSE 1.0 END"
    trust = f"(0.24 + 0.24 * ({' + '.join(f'({c} IS NOT NULL)::INT' for c in fields)}) / {len(fields)} + 0.20 * {clip('1.0 - abs(slope30 - slope) / (abs(slope) + 0.03)', 0, 1)} + 0.12 * {clip('n / 60', 0.2, 1)} + 0.10 * {clip('abs(slope) / 0.03', 0, 1)} + 0.10 * (1.0 - signal)) * CASE WHEN rul_exact >= {profile(3)} * 0.85 THEN 0.88 ELSE 1.0 END * CASE WHEN {repeated} OR {alerts} >= 2 THEN 0.94 ELSE 1.0 END"
    return _steps(
        rows,
        {"slope": "CASE WHEN n < 2 THEN -0.08 ELSE coalesce(s, 0) END", "slope30": "CASE WHEN n < 2 THEN -0.08 ELSE coalesce(s30, 0) END", "proxy": f"0.52 * {clip(worn + ' / 100', 0, 1)} + 0.28 * {clip(fast + ' / 10', 0, 1)} + 0.20 * {clip(alerts + ' / 3', 0, 1)}"},
        {"signal": clip("coalesce(0.52 * failure_risk + 0.48 * proxy, proxy)", 0.02, 0.98)},
        {"daily_damage": clip(damage, 0.05, 12)},
        {"rul_exact": f"least({profile(3)}, greatest({profile(2)}, {left}))"},
        {"rul_days": "round_even(rul_exact, 0)::INT", "rul_confidence": clip(trust, 0.25, 0.95), "bucket": catalogue._fine("rul_exact")},
        {"rul_flag": "CASE WHEN rul_confidence >= 0.78 THEN 'high' WHEN rul_confidence >= 0.58 THEN 'medium' ELSE 'low' END"},
    )


def _both(days: str, scores: bool) -> str:
    return f"SELECT d.*, trend_days FROM {_damage(days, scores)} d JOIN {_trend(days)} t ON t.cut = d.cut AND t.component_id = d.component_id"


EVERY, CUTS = 3, 5
_CUTS = f"(SELECT b - {HORIZON} - k::INT * {EVERY} AS cut FROM (SELECT min(day) AS a, max(day) AS b FROM feat), range({CUTS}) r(k) WHERE b - {HORIZON} - k::INT * {EVERY} >= a)"
CTES["lifedays"] = "SELECT * FROM " + _window_days("(SELECT max(day) AS cut FROM feat)")
CTES["testdays"] = "SELECT * FROM " + _window_days(_CUTS)
CTES["lives"] = _both("lifedays", True)
CTES["backtest"] = f"SELECT *, {catalogue._fine('trend_days')} AS trend_bucket, {catalogue._fine('rul_days')} AS rul_bucket, EXISTS (SELECT 1 FROM failures x WHERE x.component_id = t.component_id AND date_diff('day', t.cut, x.day) BETWEEN 1 AND {HORIZON})::INT AS failed FROM ({_both('testdays', False)}) t"
CTES["lifetables"] = """SELECT *, failures / cases AS failure_rate, cases / sum(cases) OVER (PARTITION BY method) AS share FROM (SELECT method, bucket, count(*) AS cases, sum(failed)::BIGINT AS failures, quantile_cont(days, 0.1) AS p10, quantile_cont(days, 0.5) AS p50, quantile_cont(days, 0.9) AS p90
    FROM (SELECT 'trend' AS method, trend_bucket AS bucket, trend_days AS days, failed FROM backtest UNION ALL SELECT 'damage', rul_bucket, rul_days, failed FROM backtest) GROUP BY 1, 2)"""

CTES["driven"] = f"SELECT * FROM {catalogue._S['driver']}"
CTES["decided"] = f"SELECT component_id, confidence_flag, rule, conflict FROM {catalogue._actions_sql()}"
_BOUNDS = {"risk1": ("failure_risk", 0.75, 0.45, 0.72), "risk2": ("failure_risk", 0.90, 0.62, 0.86), "health1": ("health_score", 0.30, 32, 52), "health2": ("health_score", 0.15, 20, 40), "rul1": ("rul_days", 0.25, 20, 70), "rul2": ("rul_days", 0.10, 8, 45)}
CTES["warned"] = "SELECT * FROM " + _steps(
    "(SELECT d.*, rul_days, coalesce(rul_days, 365) AS life FROM driven d LEFT JOIN lives USING (component_id))",
    {n: clip(f"quantile_cont({c}, {q}) OVER (PARTITION BY family)", low, high) for n, (c, q, low, high) in _BOUNDS.items()},
    {"active_rules": "(failure_risk >= risk1)::INT + (health_score <= health1)::INT + coalesce((life <= rul1)::INT, 0) + (driver IN ('backlog', 'repetition', 'anomalies') AND failure_risk >= risk1)::INT"},
    {"level": "CASE WHEN active_rules >= 3 OR coalesce(failure_risk >= risk2 AND life <= rul2, false) OR health_score <= health2 THEN 'critical' WHEN active_rules >= 2 OR failure_risk >= risk2 THEN 'high' WHEN active_rules >= 1 THEN 'preventive' ELSE 'none' END"},
    {"action": _lookup("level", {"none": "monitor", "preventive": "inspect_72h", "high": "next_window", "critical": "act_now"}, "monitor")},
)
CTES["openings"] = "SELECT unit_id, (count(*) FILTER (unavailable_h >= 4))::DOUBLE AS windows FROM service WHERE date_diff('day', day, (SELECT max(day) FROM ev)) < 7 GROUP BY 1"
_INPUTS = str(catalogue.Q["workshop_features"].source)
_SHORT = "365 - coalesce(rul_days, 365)"
CTES["prioritised"] = "SELECT * FROM " + _steps(
    f"(SELECT w.*, n.service_criticality, s.family, s.health_score, s.failure_risk, confidence_flag, rule, conflict, rul_days, rul_confidence, windows FROM {_INPUTS} w JOIN scored s USING (component_id) JOIN decided USING (component_id) JOIN units n ON n.unit_id = w.unit_id LEFT JOIN lives USING (component_id) LEFT JOIN openings o ON o.unit_id = w.unit_id)",
    {"short": f"CASE WHEN max({_SHORT}) OVER () - min({_SHORT}) OVER () < 1e-9 THEN 0.0::DOUBLE ELSE ({_SHORT} - min({_SHORT}) OVER ()) / (max({_SHORT}) OVER () - min({_SHORT}) OVER ()) END"},
    {
        "priority": clip("coalesce(technical_inputs, 0) * 0.45 + coalesce(service_inputs, 0) * 0.30 + coalesce(urgency_inputs, 0) * 0.15 + (100 - coalesce(efficiency_inputs, 50)) * 0.10", 0, 100),
        "deferral": clip("coalesce(deferral_inputs, 0) * 0.50 + coalesce(failure_risk, 0) * 30 + short * 20", 0, 100), "service": clip("coalesce(service_inputs, 0) * 0.70 + coalesce(risk, 0) * 30", 0, 100),
    },
)
CTES["depotfit"] = f"""SELECT component_id, first(d ORDER BY s DESC, d) AS depot, max(s) AS fit, array_to_string(list(d ORDER BY s DESC, d)[1:4], '|') AS candidates FROM (SELECT component_id, p.depot_id AS d,
    round({clip(f"(CASE WHEN contains(lower(speciality), lower(kind)) THEN 1 ELSE 0.42 END * 0.62 + (1 - {clip('coalesce(saturation, 0.90)', 0, 1.7)} / 1.9) * 0.24 + least(capacity / 95, 1) * 0.14) * 100", 0, 100)}, 6) AS s
    FROM (SELECT component_id, kind FROM prioritised) CROSS JOIN (SELECT depots.*, saturation FROM depots LEFT JOIN (SELECT depot_id, saturation FROM depotday WHERE day = (SELECT max(day) FROM depotday)) USING (depot_id)) p(depot_id, depot_name, capacity, speciality, saturation)) GROUP BY 1"""
_QUANTILES = {"p": (15, 30, 65, 80, 92), "n": (30, 45, 70, 92), "s": (25, 45, 80), "l": (5, 10, 20, 50, 70, 90), "h": (15, 35, 62, 80), "f": (70, 92)}
_DECISION = {
    "quiet": "p_ <= p15 AND h_ >= h80 AND (NOT telling OR l_ > l70) AND s_ <= s25 AND n_ <= n30", "observes": "p_ <= p30 AND h_ >= h62 AND (NOT telling OR l_ > l50) AND s_ <= s45 AND n_ <= n45",
    "inspects": "(p_ >= greatest(0.42, p30) AND p_ < p80 AND c_ < 0.63) OR (h_ <= h35 AND impact < 0.52 AND p_ < p80) OR coalesce(rule = 'R03_inspect', false)", "visits": "p_ >= p65 OR (telling AND l_ <= least(late20, 28)) OR n_ >= n70 OR f_ >= f70",
    "acts": "(p_ >= p92 OR near OR n_ >= n92 OR f_ >= f92) AND s_ >= s80 AND c_ >= 0.56 AND NOT full_", "clash": "(p_ >= p80 AND c_ < 0.56) OR (near AND full_ AND p_ >= p65) OR (h_ <= h15 AND p_ <= p30)",
}
_CASES = _steps(
    "(SELECT p.*, depot, fit, candidates, row_number() OVER (ORDER BY round(priority * 0.50 + deferral * 0.30 + service * 0.20, 9) DESC, component_id) AS entry FROM prioritised p JOIN depotfit USING (component_id))",
    {
        "p_": clip("coalesce(failure_risk, 0)", 0, 1), "h_": clip("coalesce(health_score, 50)", 0, 100), "l_": clip("coalesce(rul_days, 365)", 1, 365), "n_": clip("coalesce(priority, 0)", 0, 100), "f_": clip("coalesce(deferral, 0)", 0, 100), "s_": clip("coalesce(service, 0)", 0, 100), "fit_": clip("coalesce(fit, 50)", 0, 100),
        "w_": "greatest(coalesce(windows, 0), 0)", "sat_": "greatest(coalesce(saturation, 1), 0)", "k_": clip("coalesce(service_criticality, 0.55)", 0, 1), "u_": clip("coalesce(risk, 0)", 0, 1),
        "c_": clip(f"0.55 * {_lookup('confidence_flag', rules.CONFIDENCE, rules.UNKNOWN_CONFIDENCE)} + 0.45 * {clip('coalesce(rul_confidence, 0.6)', 0, 1)}", 0, 1),
    },
    {f"{k}{q:02d}": f"quantile_cont({k}_, {q / 100}) OVER ()" for k, qs in _QUANTILES.items() for q in qs},
    {"telling": "l90 - l10 >= 30 AND l10 < 220", "impact": clip("0.50 * s_ / 100 + 0.30 * u_ + 0.20 * k_", 0, 1), "full_": "fit_ < 45 OR sat_ > 1.05", "shut": "w_ <= 0"},
    {"late20": "CASE WHEN telling THEN l20 ELSE 21.0 END", "near": "telling AND l_ <= least(CASE WHEN telling THEN l05 ELSE 7.0 END, 14)"},
    _DECISION,
    {"decision": "CASE WHEN acts AND (shut OR full_) AND p_ < 0.88 THEN 'D02B_blocked' WHEN clash THEN 'D07_conflict' WHEN acts THEN 'D01_now' WHEN visits THEN 'D02_window' WHEN inspects THEN 'D03_inspect' WHEN observes AND NOT quiet THEN 'D05_observe' WHEN quiet THEN 'D06_none' ELSE 'D04_monitor' END", "decision_conflict": "coalesce(clash, false)::INT"},
    {"window_days": _lookup("decision", workshop.WINDOW_DAYS, 21)},
    {
        "bucket": "CASE WHEN decision = 'D01_now' OR priority >= 88 OR deferral >= 75 OR (coalesce(rul_days, 365) <= 12 AND failure_risk >= 0.75) THEN 'P1' WHEN decision IN ('D02_window', 'D02B_blocked', 'D07_conflict') OR priority >= 74 OR deferral >= 60 THEN 'P2' WHEN decision IN ('D03_inspect', 'D04_monitor') OR priority >= 55 THEN 'P3' ELSE 'P4' END",
        "ageing": clip(f"{clip('22 - window_days', 1, 21)} / 21 * 100 + deferral * 0.25", 0, 100), "hours": clip(f"2.0 + priority / 25 + {_lookup('decision', workshop.EXTRA_HOURS, 0.0)}", 2, 14), "delay_cost": "deferral * 180 + service * 95 + (100 - fit) * 40",
    },
    {"queue_score": "priority * 0.58 + deferral * 0.22 + service * 0.12 + ageing * 0.08"},
)
CTES["cases"] = f"SELECT * FROM {_CASES}"
#: The register is read as of so many days after its decisions.
AS_OF_DAYS = 14
CTES["registered"] = "SELECT *, 'DEC-' || upper(substr(sha256(day || '|' || unit_id || '|' || component_id || '|' || decision), 1, 16)) AS decision_id FROM cases"
CTES["decisionreviews"] = "SELECT v.*, decision_id, day FROM reviews v JOIN registered d ON d.component_id = v.component_id"
CTES["reviewed"] = f"""SELECT r.*, decision <> 'D06_none' AS approval_required, coalesce(l.status, 'pending') AS approval_status, l.reviewer AS reviewer_id, l.at_ AS reviewed_at, coalesce(l.n, 0) AS reviews, coalesce(l.kinds > 1, false) AS contradicting,
    coalesce(date_diff('day', day, l.at_::DATE) > window_days, false) AS late, CASE WHEN l.n IS NULL THEN 'system_pending_review' ELSE 'human_review' END AS record_origin, 'shadow' AS operating_mode, false AS auto_execution_allowed FROM registered r
    LEFT JOIN (SELECT decision_id AS id, arg_max(approval_status, (reviewed_at, review_id)) AS status, arg_max(reviewer_id, (reviewed_at, review_id)) AS reviewer, max(reviewed_at) AS at_, count(*) AS n, count(DISTINCT approval_status) AS kinds FROM decisionreviews WHERE reviewed_at <= day::TIMESTAMP + INTERVAL {AS_OF_DAYS} DAY GROUP BY 1) l ON l.id = r.decision_id"""
_CHECKS = """(SELECT 'decision_id_unique' AS "check", n = 0 AS passed, n AS observed, '0 duplicate ids' AS expected FROM (SELECT count(*) - count(DISTINCT decision_id) AS n FROM reviewed)
    UNION ALL SELECT 'shadow_mode_enforced', count(*) FILTER (operating_mode <> 'shadow') = 0, count(*) FILTER (operating_mode <> 'shadow'), '0 decisions outside shadow mode' FROM reviewed
    UNION ALL SELECT 'automatic_execution_disabled', count(*) FILTER (auto_execution_allowed) = 0, count(*) FILTER (auto_execution_allowed), '0 automatically executable decisions' FROM reviewed
    UNION ALL SELECT 'critical_decisions_require_approval', count(*) FILTER (decision <> 'D06_none' AND NOT approval_required) = 0, count(*) FILTER (approval_required), 'all material actions' FROM reviewed
    UNION ALL SELECT 'approved_decisions_have_reviewer', n = 0, n, '0 approved decisions without reviewer' FROM (SELECT count(*) FILTER (approval_status = 'approved' AND trim(coalesce(reviewer_id, '')) = '') AS n FROM reviewed)
    UNION ALL SELECT 'review_event_identity_unique', n = 0, n, '0 duplicate review events' FROM (SELECT count(*) - count(DISTINCT (decision_id, reviewed_at)) AS n FROM decisionreviews))"""


def warned(f: Fleet) -> DataFrame:
    return rules.early_warnings(catalogue._driven(f).join(catalogue._lives(f).select("component_id", "rul_days", "rul_confidence"), "component_id", "left"))


def backtest(f: Fleet) -> DataFrame:
    return f.stored("backtest", lambda: rul.rul_backtest(catalogue._features(f), f, EVERY, HORIZON, CUTS, WINDOW, LEAST))


def _hours(f: Fleet) -> DataFrame:
    return cases(f).groupBy("bucket").agg(F.count("*").alias("cases"), F.sum("hours").alias("hours"), F.avg("queue_score").alias("queue_score"))


def _reviewed(f: Fleet) -> tuple[DataFrame, DataFrame]:
    """(register, its reviews)."""
    register = cases(f).withColumn("decision_id", governance.decision_id("day", "unit_id", "component_id", "decision")).select("decision_id", "day", "unit_id", "component_id", "decision", "bucket", "window_days")
    register = f.stored("register", lambda: register)
    reviews = f.reviews.join(register.select("component_id", "decision_id"), "component_id")
    as_of = F.date_add("last_day", AS_OF_DAYS).cast("timestamp")
    dated = reviews.crossJoin(F.broadcast(f.span.select("last_day")))  # one row
    return f.stored("reviewed", lambda: governance.reviewed_register(register, dated, as_of)), reviews


Q: dict[str, Query] = {
    "rul_snapshot": Query(catalogue._lives, "component_id family rul_days trend_days bucket rul_flag", "daily_damage signal rul_confidence", "lives"),
    "rul_backtest": Query(backtest, "cut component_id family trend_days rul_days failed trend_bucket rul_bucket", "", "backtest"),
    "rul_tables": Query(lambda f: rul.rul_tables(backtest(f)), "method bucket cases failures", "p10 p50 p90 failure_rate share", "lifetables"),
    "early_warning_levels": Query(warned, "component_id family active_rules level action", "", "warned"),
    "priority_scores": Query(cases, "component_id entry depot candidates", "priority deferral service fit ageing", "cases"),
    "operational_decisions": Query(cases, "component_id decision decision_conflict bucket window_days", "priority deferral service queue_score hours delay_cost", "cases"),
    "queue_hours": Query(_hours, "bucket cases", "hours queue_score", "(SELECT bucket, count(*) AS cases, sum(hours) AS hours, avg(queue_score) AS queue_score FROM cases GROUP BY 1)"),
    "decision_register": Query(lambda f: governance.decision_register(cases(f)), "decision_id day unit_id component_id decision needs_approval auto", "", "(SELECT *, decision <> 'D06_none' AS needs_approval, false AS auto FROM registered)"),
    "decision_reviews": Query(lambda f: _reviewed(f)[0], "decision_id component_id decision bucket approval_required approval_status reviewer_id reviewed_at reviews contradicting late record_origin operating_mode", "", "reviewed"),
    "governance_checks": Query(lambda f: governance.governance_checks(*_reviewed(f)), "check passed observed expected", "", _CHECKS),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q.run for name, q in Q.items()}
SQL: dict[str, str] = {name: q.sql() for name, q in Q.items()}
