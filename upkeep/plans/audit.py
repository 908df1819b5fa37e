"""Staging views, audits, gates and small reports by name, with their SQL for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions import scalars as s
from upkeep.operators import governance, marts, monitoring, validation
from upkeep.plans import catalogue
from upkeep.plans.catalogue import HORIZON, Q, Query
from upkeep.sources import files
from upkeep.sources.fleet import Fleet
from upkeep.sources.store import shared_dir

#: Staging views: name to the columns that go out as they are, and the doubles.
STAGING = {
    "readings": ("reading_id day unit_id component_id", "value temperature vibration wear load"),
    "failures": ("failure_id day unit_id component_id severity repeated mode", "downtime_h"),
    "alerts": ("alert_id day unit_id component_id early attended severity origin", ""),
    "maintenance": ("maintenance_id day unit_id component_id depot_id corrective condition_based planned", "hours cost"),
    "backlog": ("day order_id depot_id unit_id component_id age_days severity", "risk"),
    "units": ("unit_id fleet_id depot_id line_id configuration", "service_criticality"),
    "components": ("component_id unit_id system kind", "criticality age_ratio cycles_ratio"),
    "depots": ("depot_id depot_name speciality", "capacity"),
    "service": ("day unit_id fleet_id line_id cancellations substitution", "planned_h available_h unavailable_h punctuality_hit"),
    "context": ("day line_id", "ambient humidity intensity congestion"),
    "calendar": ("day", ""),
}

#: Tables and their keys.
RAW_KEYS = {
    "events": ("event_id",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "part": ("p_partkey",), "supplier": ("s_suppkey",), "customer": ("c_custkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",),
}
FLEET_KEYS = {
    "readings": ("reading_id",), "inspections": ("inspection_id",), "failures": ("failure_id",), "alerts": ("alert_id",), "maintenance": ("maintenance_id",), "backlog": ("day", "order_id"), "units": ("unit_id",), "components": ("component_id",), "service": ("day", "unit_id"),
}

#: Child table and key, parent table and key.
RAW_REFERENCES = (
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
)
FLEET_REFERENCES = (("inspections", "component_id", "components", "component_id"), ("failures", "component_id", "components", "component_id"), ("alerts", "alert_id", "readings", "reading_id"), ("maintenance", "depot_id", "depots", "depot_id"), ("backlog", "unit_id", "units", "unit_id"), ("components", "unit_id", "units", "unit_id"))

#: Contracts of the raw tables.
CONTRACTS = {
    "events": governance.Contract({"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double"}, ["event_id"], ["ts"]),
    "part": governance.Contract({"p_partkey": "bigint", "p_type": "string", "p_size": "int", "p_retailprice": "double"}, ["p_partkey"]),
    "supplier": governance.Contract({"s_suppkey": "bigint", "s_name": "string", "s_acctbal": "double"}, ["s_suppkey"]),
    "orders": governance.Contract({"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "timestamp"}, ["o_orderkey"], ["o_orderdate"], {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": governance.Contract({"l_orderkey": "bigint", "l_linenumber": "int", "l_suppkey": "bigint"}, [], (), {"l_orderkey": ("orders", "o_orderkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    "customer": governance.Contract({"c_custkey": "bigint"}, ["c_custkey"]),
}

GATES = (("val_sensor_ranges", True), ("val_temporal", True), ("val_backlog_semantics", True), ("val_duplicate_keys", True), ("val_metric_ranges", True), ("val_business", True), ("val_health_balance", True), ("val_scores_actions", False))
DRIFTING = ("health_index", "velocity", "stress", "sensor_mean", "restoration")


def contract_faults(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The faults of each raw table that has any."""
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in CONTRACTS}
    found = {n: governance.check_contract(tables[n], c, tables) for n, c in CONTRACTS.items()}
    return {n: x for n, x in found.items() if x}


def require_contracts(spark: SparkSession, folder: str) -> None:
    if faults := contract_faults(spark, folder):
        raise ValueError("; ".join(f"{n}: {', '.join(x)}" for n, x in faults.items()))


def _keys(f: Fleet) -> DataFrame:
    return validation.key_report([*((n, f.table(n), k) for n, k in RAW_KEYS.items()), *((n, getattr(f, n), k) for n, k in FLEET_KEYS.items())])


def _guards(f: Fleet) -> DataFrame:
    units = catalogue._stored_units(f)
    return validation.key_report([("mart", catalogue._stored_mart(f), ("day", "component_id")), ("unitday", units, ("day", "unit_id")), ("depotday", catalogue._stored_depots(f), ("day", "depot_id")), ("fleetweek", marts.mart_fleet_week(f, units), ("week", "fleet_id")), ("feat", catalogue._features(f), ("day", "component_id"))])


_GUARDS = {"mart": ("day", "component_id"), "unitday": ("day", "unit_id"), "depotday": ("day", "depot_id"), "fleetweek": ("week", "fleet_id"), "feat": ("day", "component_id")}


def _keys_sql(keys: dict[str, tuple[str, ...]]) -> str:
    one = "SELECT '{0}' AS object, count(*) AS n_rows, count(*) FILTER ({2}) AS null_keys, (SELECT count(*) FROM (SELECT 1 FROM {0} GROUP BY {1} HAVING count(*) > 1)) AS duplicates FROM {0}"
    return "(" + " UNION ALL ".join(one.format(n, ", ".join(k), " OR ".join(f"{c} IS NULL" for c in k)) for n, k in keys.items()) + ")"


def _references(f: Fleet) -> DataFrame:
    raw = [(f"{a}.{k}", f.table(a), k, f.table(b), pk) for a, k, b, pk in RAW_REFERENCES]
    return validation.reference_report([*raw, *((f"{a}.{k}", getattr(f, a), k, getattr(f, b), pk) for a, k, b, pk in FLEET_REFERENCES)])


def _references_sql() -> str:
    one = "SELECT '{0}.{1}' AS reference, (SELECT count(DISTINCT {1}) FROM {0} WHERE {1} NOT IN (SELECT {3} FROM {2})) AS orphans"
    return "(" + " UNION ALL ".join(one.format(*r) for r in (*RAW_REFERENCES, *FLEET_REFERENCES)) + ")"


def _gates(f: Fleet) -> DataFrame:
    checks = [(n, blocking, Q[n].build(f).select(*Q[n].plain.split())) for n, blocking in GATES]
    empty = validation.row_counts(component_day=catalogue._stored_mart(f), unit_day=catalogue._stored_units(f)).agg(F.count_if(F.col("n_rows") == 0).alias("n"))
    balance = Q["val_health_balance"].build(f).select((F.coalesce("mae", F.lit(1.0)) > 1e-6).cast("long").alias("n"))
    return validation.gate_report([*checks, ("marts_not_empty", True, empty), ("health_and_deterioration", True, balance)])


def _gates_sql() -> str:
    parts = [f"SELECT '{n}' AS gate, ({' + '.join(Q[n].plain.split())})::BIGINT AS faults, {blocking} AS blocking FROM {Q[n].source}" for n, blocking in GATES]
    parts += ["SELECT 'marts_not_empty', ((SELECT count(*) FROM mart) = 0)::BIGINT + ((SELECT count(*) FROM unitday) = 0)::BIGINT, TRUE", "SELECT 'health_and_deterioration', (mae > 1e-6)::BIGINT, TRUE FROM " + str(Q["val_health_balance"].source)]
    return "(SELECT *, CASE WHEN faults = 0 THEN 'passed' WHEN blocking THEN 'blocked' ELSE 'warned' END AS status FROM (" + " UNION ALL ".join(parts) + "))"


def require_gates(f: Fleet) -> None:
    """Raises where a blocking gate has faults."""
    if blocked := [r.gate for r in _gates(f).where("status = 'blocked'").collect()]:
        raise ValueError("blocked by " + ", ".join(blocked))


#: What a made fleet should lie between, low and high.
PLAUSIBLE = {
    "view_share": (0.10, 0.70), "click_share": (0.05, 0.60), "signup_share": (0.01, 0.40), "error_share": (0.01, 0.40), "purchase_share": (0.01, 0.40), "values_in_range": (0.99, 1.0),
    "mean_downtime": (1.0, 24.0), "repeated_share": (0.05, 0.95), "availability": (0.60, 1.0), "mean_age_ratio": (0.05, 2.0),
}


def _plausible(f: Fleet) -> DataFrame:
    """(check, value, low, high, status): what a made fleet should look like; a value that is missing or outside is implausible."""
    share = lambda c: F.avg(c.cast("double"))
    e, k = f.table("events"), F.col("event_type")
    parts = [
        e.agg(*(share(k == n).alias(f"{n}_share") for n in ("view", "click", "signup", "error", "purchase")), share(F.col("value").between(0, 1000)).alias("values_in_range")),
        f.failures.agg(F.avg("downtime_h").alias("mean_downtime"), share(F.col("repeated") == 1).alias("repeated_share")),
        f.service.agg((F.sum("available_h") / F.sum("planned_h")).alias("availability")),
        f.components.agg(F.avg("age_ratio").alias("mean_age_ratio")),
    ]
    row = lambda c: F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"), F.lit(PLAUSIBLE[c][0]).alias("low"), F.lit(PLAUSIBLE[c][1]).alias("high"))
    out = validation.stacked([p.select(F.inline(F.array(*map(row, p.columns)))) for p in parts])
    return out.withColumn("status", F.when(F.col("value").between(F.col("low"), F.col("high")), "plausible").otherwise("implausible"))


def require_plausible(f: Fleet) -> None:
    """Raises with the values that are outside of their bounds."""
    if odd := _plausible(f).where("status = 'implausible'").collect():
        raise ValueError("implausible: " + ", ".join(f"{r['check']} = {r['value']}" for r in odd))


_VALUES = """SELECT 'view_share' AS "check", avg((event_type = 'view')::INT) AS value FROM events UNION ALL SELECT 'click_share', avg((event_type = 'click')::INT) FROM events UNION ALL SELECT 'signup_share', avg((event_type = 'signup')::INT) FROM events
    UNION ALL SELECT 'error_share', avg((event_type = 'error')::INT) FROM events UNION ALL SELECT 'purchase_share', avg((event_type = 'purchase')::INT) FROM events UNION ALL SELECT 'values_in_range', avg((value BETWEEN 0 AND 1000)::INT) FROM events
    UNION ALL SELECT 'mean_downtime', avg(downtime_h) FROM failures UNION ALL SELECT 'repeated_share', avg(repeated) FROM failures UNION ALL SELECT 'availability', sum(available_h) / sum(planned_h) FROM service UNION ALL SELECT 'mean_age_ratio', avg(age_ratio) FROM components"""
_BOUNDS = ", ".join(f"('{c}', {low}::DOUBLE, {high}::DOUBLE)" for c, (low, high) in PLAUSIBLE.items())
_PLAUSIBLE = f"""(SELECT v.*, low, high, CASE WHEN value BETWEEN low AND high THEN 'plausible' ELSE 'implausible' END AS status FROM ({_VALUES}) v JOIN (VALUES {_BOUNDS}) b("check", low, high) USING ("check"))"""


def _entropy(f: Fleet) -> DataFrame:
    """Spread of the failure modes over each unit's failures, in bits."""
    n = f.failures.groupBy("unit_id", "mode").agg(F.count("*").alias("n"))
    total = n.groupBy("unit_id").agg(F.sum("n").alias("failures"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select("unit_id", "failures", (F.log2("failures") - F.col("s") / F.col("failures")).alias("entropy"))


def _calibration_quality(f: Fleet) -> DataFrame:
    scored = f.stored("labelled", lambda: catalogue._labelled(f))
    table = monitoring.calibration_table(scored, probability="score")
    return monitoring.calibration_error(table).crossJoin(monitoring.brier(scored, probability="score"))


def drift_sql(columns: tuple[str, ...] = DRIFTING) -> str:
    def one(c: str) -> str:
        near = lambda rows: f"(SELECT len(list_filter(inner_, lambda v: {c} > v)) AS b, count(*) / sum(count(*)) OVER () AS share FROM feat CROSS JOIN edges_{c} WHERE {c} IS NOT NULL AND {rows} GROUP BY 1)"
        first, last = near(f"date_diff('day', (SELECT min(day) FROM feat), day) < {HORIZON}"), near(f"date_diff('day', day, (SELECT max(day) FROM feat)) < {HORIZON}")
        edges = f"edges_{c} AS (SELECT e, e[2:len(e) - 1] AS inner_ FROM (SELECT list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM feat WHERE date_diff('day', (SELECT min(day) FROM feat), day) < {HORIZON}))"
        part = f"SELECT '{c}' AS feature, coalesce(sum(CASE WHEN len(e) >= 3 THEN (c - r) * ln(c / r) ELSE 0 END), 0) AS psi FROM (SELECT e, greatest(coalesce(x.share, 0), 1e-6) AS r, greatest(coalesce(y.share, 0), 1e-6) AS c FROM (SELECT e, unnest(range(len(e) - 1)) AS bin FROM edges_{c}) g LEFT JOIN {first} x ON x.b = bin LEFT JOIN {last} y ON y.b = bin)"
        return f"SELECT * FROM (WITH {edges} {part})"

    return "(SELECT *, CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.10 THEN 'moderate' ELSE 'low' END AS level FROM (" + " UNION ALL ".join(one(c) for c in columns) + "))"


def _csv_scan(f: Fleet) -> DataFrame:
    """Suppliers written as CSV and read again with inferred types."""
    path = f"{shared_dir(f.spark)}/csv-{uuid.uuid4().hex}"
    f.table("supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(path)
    return files.read_csv(f.spark, path)


def _views(f: Fleet) -> DataFrame:
    """Marts by name: views that SQL reads."""
    f.components.createOrReplaceTempView("v_components")
    f.failures.createOrReplaceTempView("v_failures")
    f.spark.sql("CREATE OR REPLACE TEMPORARY VIEW v_failures_by_kind AS SELECT kind, count(*) AS failures, sum(downtime_h) AS downtime_h FROM v_failures JOIN v_components USING (component_id) GROUP BY kind")
    return f.spark.table("v_failures_by_kind")


def _top_combined(f: Fleet) -> DataFrame:
    both = F.col("failure_risk") + F.col("deterioration_index") / 100
    return catalogue._scored(f).withColumn("combined", F.round(both, 9)).orderBy(F.col("combined").desc(), "component_id").limit(220)


def _unit_hours(f: Fleet) -> DataFrame:
    hours = f.service.groupBy("unit_id").agg(F.sum("unavailable_h").alias("unavailable_h"), F.count("*").alias("days"))
    return validation.one_to_one(f.units, hours, ["unit_id"])


def _cardinalities(f: Fleet) -> DataFrame:
    return validation.cardinalities(**{t: f.table(t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})


AUDIT: dict[str, Query] = {
    **{f"stage_{n}": Query(lambda f, n=n: getattr(f, n), plain, doubles, n) for n, (plain, doubles) in STAGING.items()},
    "key_report": Query(_keys, "object n_rows null_keys duplicates", "", _keys_sql({**RAW_KEYS, **FLEET_KEYS})),
    "join_guards": Query(_guards, "object n_rows null_keys duplicates", "", _keys_sql(_GUARDS)),
    "reference_report": Query(_references, "reference orphans", "", _references_sql()),
    "unit_mismatches": Query(lambda f: validation.mismatched(f.failures, f.components, "component_id", "unit_id"), "failure_id component_id unit_id", "", "(SELECT f.* FROM failures f LEFT JOIN components c ON c.component_id = f.component_id WHERE c.component_id IS NULL OR c.unit_id <> f.unit_id)"),
    "validation_gate": Query(_gates, "gate faults blocking status", "", _gates_sql()),
    "plausibility": Query(_plausible, "check status", "value low high", _PLAUSIBLE),
    "cardinalities": Query(_cardinalities, "object n_rows n_columns n_distinct", "", "(" + " UNION ALL ".join(f"SELECT '{t}' AS object, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS n_distinct FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")) + ")"),
    "mode_entropy": Query(_entropy, "unit_id failures", "entropy", "(SELECT unit_id, sum(n)::BIGINT AS failures, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY unit_id) AS t FROM (SELECT unit_id, mode, count(*) AS n FROM failures GROUP BY ALL)) GROUP BY 1)"),
    "calibration_quality": Query(_calibration_quality, "", "calibration_error brier", "(SELECT sum(n * abs(o - p)) / sum(n) AS calibration_error, (SELECT avg((score - y) ** 2) FROM labelled) AS brier FROM (SELECT least(9, greatest(0, ceil(score * 10) - 1)) AS b, count(*) AS n, avg(score) AS p, avg(y) AS o FROM labelled GROUP BY 1))"),
    "drift_report": Query(lambda f: monitoring.drift(catalogue._features(f), DRIFTING, HORIZON), "feature level", "psi", drift_sql()),
    "csv_scan": Query(_csv_scan, "s_suppkey s_name", "s_acctbal", "supplier"),
    "named_views": Query(_views, "kind failures", "downtime_h", "(SELECT kind, count(*) AS failures, sum(downtime_h) AS downtime_h FROM failures JOIN components USING (component_id) GROUP BY 1)"),
    "top_combined_risk": Query(_top_combined, "component_id family", "combined", "(SELECT *, round(failure_risk + deterioration_index / 100, 9) AS combined FROM scored ORDER BY combined DESC, component_id LIMIT 220)"),
    "unit_hours": Query(_unit_hours, "unit_id fleet_id days", "unavailable_h", "(SELECT u.unit_id, u.fleet_id, count(*) AS days, sum(unavailable_h) AS unavailable_h FROM units u JOIN service v ON v.unit_id = u.unit_id GROUP BY 1, 2)"),
    "sigmoid_scores": Query(lambda f: f.readings.select("reading_id", s.sigmoid((F.col("value") - 50) / 20).alias("squashed")), "reading_id", "squashed", "(SELECT reading_id, 1 / (1 + exp(-(value - 50) / 20)) AS squashed FROM readings)"),
    "first_present": Query(lambda f: f.table("orders").withColumn("late", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).select("o_orderkey", s.first_present(f.table("orders").withColumn("late", F.lit("")), "label", ["gone", "late", "o_orderstatus"])), "o_orderkey label", "", "(SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN coalesce(o_orderpriority, o_orderstatus) ELSE o_orderstatus END AS label FROM orders)"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q.run for name, q in AUDIT.items()}
SQL: dict[str, str] = {name: q.sql() for name, q in AUDIT.items() if q.source}
