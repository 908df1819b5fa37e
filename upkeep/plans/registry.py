"""The registries of the fleet's contracts, metrics and lineage, and the exported objects, with their queries and SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from upkeep.operators import contracts, marts
from upkeep.operators.contracts import DataContract, MetricContract
from upkeep.plans import audit, catalogue
from upkeep.plans.catalogue import Query
from upkeep.sources import lineage
from upkeep.sources.files import require_inputs
from upkeep.sources.fleet import Fleet
from upkeep.sources.snapshots import Snapshots
from upkeep.sources.store import shared_dir
from upkeep.sources.warehouse import Warehouse, input_manifest

_DAILY, _ENG, _OPS, _SHOP = "daily", "reliability analytics", "operations analytics", "workshop planning"
DATA: tuple[DataContract, ...] = (
    DataContract("components", "raw", "component", ("component_id",), ("component_id", "unit_id", "kind", "criticality"), "on change", _ENG, "marts, scores", "key unique; every component has a unit"),
    DataContract("units", "raw", "unit", ("unit_id",), ("unit_id", "fleet_id", "depot_id", "line_id"), "on change", _OPS, "marts, planning", "key unique"),
    DataContract("readings", "raw", "reading", ("reading_id",), ("reading_id", "ts", "component_id", "value", "temperature", "vibration", "wear"), _DAILY, _ENG, "component day", "key unique; physical ranges"),
    DataContract("inspections", "raw", "inspection", ("inspection_id",), ("inspection_id", "ts", "component_id", "score", "defect", "confidence"), _DAILY, _ENG, "component day, inspection value", "key unique"),
    DataContract("failures", "raw", "failure", ("failure_id",), ("failure_id", "ts", "component_id", "severity", "downtime_h"), _DAILY, _ENG, "marts, validation", "key unique; no negative downtime"),
    DataContract("maintenance", "raw", "maintenance event", ("maintenance_id",), ("maintenance_id", "ts", "component_id", "depot_id", "hours"), _DAILY, _SHOP, "marts, restoration", "key unique; depot known"),
    DataContract("backlog", "raw", "snapshot and order", ("day", "order_id"), ("day", "order_id", "depot_id", "age_days", "risk"), "weekly", _SHOP, "pressure, narrative", "key unique", "physical backlog, not risk of deferral"),
    DataContract("service", "raw", "unit day", ("day", "unit_id"), ("day", "unit_id", "planned_h", "available_h", "unavailable_h"), _DAILY, _OPS, "availability", "planned hours are available or not"),
    DataContract("mart", "mart", "component day", ("day", "component_id"), ("day", "unit_id", "component_id", "health", "deterioration", "stress"), _DAILY, _ENG, "features, KPIs", "key unique; health and deterioration make 100"),
    DataContract("unitday", "mart", "unit day", ("day", "unit_id"), ("day", "unit_id", "risk", "availability", "failures"), _DAILY, _OPS, "KPIs, features", "key unique"),
    DataContract("depotday", "mart", "depot day", ("day", "depot_id"), ("day", "depot_id", "capacity", "saturation", "backlog_items"), _DAILY, _SHOP, "workshop", "key unique; no negative saturation"),
    DataContract("fleetweek", "mart", "fleet week", ("week", "fleet_id"), ("week", "fleet_id", "availability", "failures"), "weekly", _OPS, "narrative, strategy", "key unique"),
    DataContract("scored", "score", "component of the last day", ("component_id",), ("component_id", "family", "health_score", "failure_risk"), _DAILY, _ENG, "decisions, panel", "key unique", "relative scores, no probabilities"),
)
METRICS: tuple[MetricContract, ...] = (
    MetricContract("health_score", "component health", "technical condition now, high is good", "weighted health index, inverse deterioration, velocity and defects, restoration", "component", "score", _ENG, "maintenance, panel", "weigh by criticality for a unit", "a state, not a chance of failure", "scored", "health_score", "high", 0, 100),
    MetricContract("failure_risk", "relative failure risk", "propensity to fail soon against the other components", "percentile of weighted signals, within the family and over all", "component", "ratio", _ENG, "planning, warnings", "mean and P90 for a unit, no sum", "not calibrated, not causal", "scored", "failure_risk", "medium", 0, 1),
    MetricContract("deterioration", "deterioration index", "100 less health of the day", "100 - health", "component day", "score", _ENG, "features", "no mean over kinds", "not comparable between kinds", "mart", "deterioration", "high", 0, 100),
    MetricContract("mart_health", "day health", "health of the day from sensors and alerts", "weighted inputs of the day", "component day", "score", _ENG, "KPIs", "mean by kind", "not the health score", "mart", "health", "high", 0, 100),
    MetricContract("stress", "operating stress", "load and surroundings against normal", "product of load and context", "component day", "ratio", _ENG, "features, risk", "mean", "no limit value", "mart", "stress", "medium", 0, None),
    MetricContract("unit_risk", "unit unavailability risk", "risk that the unit is not available", "weighted failures, alerts, backlog and health", "unit day", "score", _OPS, "KPIs, workshop", "mean by fleet", "not a probability", "unitday", "risk", "medium", 0, None),
    MetricContract("availability", "unit availability", "available against planned hours", "available_h / planned_h", "unit day", "ratio", _OPS, "narrative", "sum hours, then divide", "align periods first", "unitday", "availability", "high", 0, 1),
    MetricContract("saturation", "depot saturation", "work against capacity", "hours and backlog over capacity", "depot day", "ratio", _SHOP, "workshop, panel", "mean by depot", "over 1 is possible", "depotday", "saturation", "high", 0, None),
    MetricContract("backlog_items", "physical backlog", "open orders of the snapshot", "count of open orders", "depot day", "count", _SHOP, "workshop", "sum by depot", "not the risk of deferral", "depotday", "backlog_items", "high", 0, None),
    MetricContract("fleet_availability", "fleet availability", "mean availability of the week", "mean of unit availability", "fleet week", "ratio", _OPS, "management", "mean by fleet week", "align filters first", "fleetweek", "availability", "high", 0, 1),
    MetricContract("downtime_h", "failure downtime", "hours out of service after a failure", "1 + value / 50", "failure", "hours", _ENG, "KPIs, strategy", "sum", "includes waiting", "failures", "downtime_h", "medium", 0, None),
)


def _columns(**of: str) -> set[tuple[str, str]]:
    return {(table, c) for table, names in of.items() for c in names.split()}


_EVENTS, _SIGNALS = "event_id ts user_id event_type value", "ts user_id event_type value"
_SCORE, _CONDITION = _columns(events=_EVENTS, part="p_partkey p_type p_size p_retailprice"), _columns(events=_EVENTS, part="p_partkey p_size p_retailprice")
#: Input columns behind each metric, as declared; the plans are held to it.
LINEAGE: dict[str, set[tuple[str, str]]] = {
    "health_score": _SCORE, "failure_risk": _SCORE, "deterioration": _CONDITION, "mart_health": _CONDITION, "stress": _columns(events=_EVENTS, part="p_partkey"), "unit_risk": _CONDITION,
    "availability": _columns(events=_SIGNALS), "fleet_availability": _columns(events=_SIGNALS), "saturation": _columns(events=_EVENTS, part="p_partkey", supplier="s_nationkey s_acctbal", nation="n_nationkey"),
    "backlog_items": _columns(events="ts user_id event_type", nation="n_nationkey"), "downtime_h": _columns(events="event_type value"),
}
OBJECTS = (
    "mart_component_day", "mart_unit_day", "mart_fleet_week", "component_daily_health", "unit_operational_risk", "depot_pressure", "failure_repetition", "condition_value", "kpi_top_units", "kpi_top_components", "kpi_top_depots",
    "kpi_repetitive_failures", "kpi_unavailable_units", "kpi_backlog_critical", "kpi_health_trend", "inspection_family_kpi", "unit_availability", "val_row_counts", "val_null_rates", "val_sensor_ranges", "val_temporal", "val_scores_actions",
    "val_health_balance", "val_backlog_semantics", "key_report", "reference_report", "join_guards", "val_metric_ranges", "val_business",
)
ALL_INPUTS = tuple(audit.RAW_KEYS)


def tables(f: Fleet) -> dict[str, DataFrame]:
    """The contracts' tables by name."""
    raw = {n: getattr(f.kept, n) for n in ("components", "units", "readings", "inspections", "failures", "maintenance", "backlog", "service")}
    weeks = f.stored("fleet_week", lambda: marts.mart_fleet_week(f.kept, catalogue._stored_units(f)))
    return raw | {"mart": catalogue._stored_mart(f), "unitday": catalogue._stored_units(f), "depotday": catalogue._stored_depots(f), "fleetweek": weeks, "scored": catalogue._scored(f)}


def checks(f: Fleet) -> DataFrame:
    return f.stored("contract_checks", lambda: contracts.contract_checks(f.spark, DATA, METRICS, tables(f)))


def read_by_metric(f: Fleet) -> dict[str, set[tuple[str, str]]]:
    """The input columns behind each metric: what its pruned plan scans, and behind written marts what theirs scanned."""
    with lineage.recording() as seen:
        mart = marts.mart_component_day(f)  # plans, not written tables: so that a metric's pruning reaches the inputs
        units = marts.mart_unit_day(f, mart)
        known = {"failures": f.failures, "mart": mart, "unitday": units, "depotday": marts.depot_pressure(f, units), "fleetweek": marts.mart_fleet_week(f, units), "scored": catalogue._scored(f)}
        names = {lineage.plain_path(f"{f.path}/{t}.parquet"): t for t in ALL_INPUTS}
        found = {m.metric: lineage.closure(lineage.reads(known[m.source].select(m.column)), seen) for m in METRICS}
    return {m: {(names.get(path, path), column) for path, column in x} for m, x in found.items()}


def metric_lineage(f: Fleet) -> DataFrame:
    """(metric, source, column, status): declared inputs against those that the plans read."""
    return contracts.lineage_report(f.spark, LINEAGE, read_by_metric(f))


def objects(f: Fleet) -> dict[str, Callable[[], DataFrame]]:
    """The exported objects, each built from marts that are made once."""
    known = catalogue.Q | audit.AUDIT
    return {n: lambda q=known[n]: q.shape(q.build(f)) for n in OBJECTS}


def export_run(spark: SparkSession, sf_dir: str, folder: str, kind: str = "csv") -> DataFrame:
    """Exports all objects of a data folder; the execution manifest.  A later run over the same inputs and code finds all of them."""
    warehouse = Warehouse.over(spark, folder, input_manifest(spark, sf_dir, ALL_INPUTS))
    f = Fleet(spark, sf_dir, warehouse)
    return warehouse.export(objects(f), kind)


def _export_manifest(f: Fleet) -> DataFrame:
    return export_run(f.spark, f.path, f"{shared_dir(f.spark)}/exports")


def publish(spark: SparkSession, source: str, folder: str) -> Snapshots:
    """Publishes a folder's tables as the current snapshot of a managed folder, if they keep their contracts."""
    require_inputs(spark, source, [f"{t}.parquet" for t in ALL_INPUTS])
    area = Snapshots(spark, folder)
    area.publish({t: spark.read.parquet(f"{source}/{t}.parquet") for t in ALL_INPUTS}, lambda staged: [f"{n}: {', '.join(x)}" for n, x in audit.contract_faults(spark, staged).items()])
    return area


def _published(f: Fleet) -> DataFrame:
    area = publish(f.spark, f.path, f"{shared_dir(f.spark)}/snapshots-{uuid.uuid4().hex}")
    return area.manifest()


def _checks_sql() -> str:
    fixed, counted = [], []
    for c in DATA:
        fixed += [(f"data_contract_table_exists::{c.table}", "data", "critical", f"table={c.table}"), (f"data_contract_required_columns::{c.table}", "data", "high", "missing=")]
        key = ", ".join(c.key)
        null = " OR ".join(f"{k} IS NULL" for k in c.key)
        counted.append(f"SELECT 'data_contract_key::{c.table}' AS check_id, 'data' AS contract_type, 'high' AS severity, d = 0 AND e = 0 AS passed, 'key={','.join(c.key)} duplicates=' || d || ' nulls=' || e AS detail FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {c.table})) AS d, count(*) FILTER ({null}) AS e FROM {c.table})")
    for m in METRICS:
        fixed.append((f"metric_contract_source_exists::{m.metric}", "metric", "high", f"source={m.source}.{m.column}"))
        outside = " OR ".join([f"{m.column} < {m.low}"] * (m.low is not None) + [f"{m.column} > {m.high}"] * (m.high is not None))
        counted.append(f"SELECT 'metric_contract_range::{m.metric}', 'metric', 'medium', n = 0, 'outside=' || n FROM (SELECT count(*) FILTER ({outside}) AS n FROM {m.source})")
    values = ", ".join(f"('{a}', '{b}', '{c}', TRUE, '{d}')" for a, b, c, d in fixed)
    rows = " UNION ALL ".join([*counted, f"SELECT * FROM (VALUES {values})"])
    return f"(SELECT *, NOT passed AND severity IN ('critical', 'high') AS blocker FROM ({rows}))"


def _lineage_sql() -> str:
    rows = ", ".join(f"('{m}', '{t}', '{c}')" for m, x in LINEAGE.items() for t, c in sorted(x))
    return f"(SELECT metric, source, \"column\", 'read' AS status FROM (VALUES {rows}) v(metric, source, \"column\"))"


def _export_sql() -> str:
    known = catalogue.Q | audit.AUDIT
    one = "SELECT '{0}' AS object, (SELECT count(*) FROM {1}) AS n_rows, {2} AS n_columns"
    return "(" + " UNION ALL ".join(one.format(n, known[n].source, len(known[n].plain.split()) + len(known[n].doubles.split())) for n in OBJECTS) + ")"


def _inputs_sql() -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns FROM {t}" for t in ALL_INPUTS) + ")"


_GATE_SQL = "(SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (blocker) AS blockers, count(*) > 0 AND count(*) FILTER (blocker) = 0 AS allowed FROM {})"
Q: dict[str, Query] = {
    "contract_checks": Query(checks, "check_id contract_type severity passed detail blocker", "", _checks_sql()),
    "contract_gate": Query(lambda f: contracts.publication_gate(checks(f)), "checks failed blockers allowed", "", _GATE_SQL.format(_checks_sql())),
    "metric_lineage": Query(metric_lineage, "metric source column status", "", _lineage_sql()),
    "export_manifest": Query(_export_manifest, "object n_rows n_columns", "", _export_sql()),
    "published_snapshot": Query(_published, "table n_rows n_columns", "", _inputs_sql()),
    "input_manifest": Query(lambda f: input_manifest(f.spark, f.path, ALL_INPUTS), "table n_rows n_columns", "", _inputs_sql()),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q.run for name, q in Q.items()}
SQL: dict[str, str] = {name: q.sql() for name, q in Q.items()}
