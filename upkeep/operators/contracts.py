"""Contracts of tables and metrics, their checks, and the policy that blocks a publication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities whose failed checks block.
BLOCKING = ("critical", "high")


@dataclass(frozen=True)
class DataContract:
    """What a table promises: its key is unique and never null, its required columns are there."""

    table: str
    layer: str
    grain: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    freshness: str
    owner: str
    consumers: str
    rules: str
    notes: str = ""


@dataclass(frozen=True)
class MetricContract:
    """What a metric promises: the column of a table that holds it, and the range of its values."""

    metric: str
    name: str
    definition: str
    formula: str
    grain: str
    unit: str
    owner: str
    consumers: str
    aggregation: str
    caution: str
    source: str
    column: str
    maturity: str
    low: float | None = None
    high: float | None = None


_ROW = "check_id string, contract_type string, severity string, passed boolean, detail string"


def registry(spark: SparkSession, contracts: Sequence[DataContract] | Sequence[MetricContract]) -> DataFrame:
    """The contracts as a table, a row each; lists are joined by commas."""
    plain = lambda v: ",".join(v) if isinstance(v, tuple) else float(v) if isinstance(v, int) else v
    rows = [{k: plain(v) for k, v in asdict(c).items()} for c in contracts]
    kinds = {"low": "double", "high": "double"}
    return spark.createDataFrame(rows, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in asdict(contracts[0])))


def _literal(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), _ROW)


def _table_checks(contract: DataContract, df: DataFrame | None, spark: SparkSession) -> list[DataFrame]:
    t, out = contract.table, []
    out.append(_literal(spark, [(f"data_contract_table_exists::{t}", "data", "critical", df is not None, f"table={t}")]))
    if df is None:
        return out
    missing = [c for c in contract.required if c not in df.columns]
    out.append(_literal(spark, [(f"data_contract_required_columns::{t}", "data", "high", not missing, f"missing={','.join(missing)}")]))
    lost = [c for c in contract.key if c not in df.columns]
    if lost:
        out.append(_literal(spark, [(f"data_contract_key::{t}", "data", "high", False, f"key lacks={','.join(lost)}")]))
        return out
    null = reduce(Column.__or__, (F.col(c).isNull() for c in contract.key))
    counts = df.groupBy(*contract.key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("e"))
    out.append(counts.select(F.lit(f"data_contract_key::{t}").alias("check_id"), F.lit("data").alias("contract_type"), F.lit("high").alias("severity"), ((F.col("d") == 0) & (F.col("e") == 0)).alias("passed"), F.concat(F.lit(f"key={','.join(contract.key)} duplicates="), F.col("d"), F.lit(" nulls="), F.col("e")).alias("detail")))
    return out


def _metric_checks(contract: MetricContract, df: DataFrame | None, spark: SparkSession) -> list[DataFrame]:
    there = df is not None and contract.column in df.columns
    out = [_literal(spark, [(f"metric_contract_source_exists::{contract.metric}", "metric", "high", there, f"source={contract.source}.{contract.column}")])]
    if there and (contract.low is not None or contract.high is not None):
        x = F.col(contract.column)
        outside = [x < contract.low] if contract.low is not None else []
        outside += [x > contract.high] if contract.high is not None else []
        n = df.agg(F.count_if(reduce(Column.__or__, outside)).alias("n"))
        out.append(n.select(F.lit(f"metric_contract_range::{contract.metric}").alias("check_id"), F.lit("metric").alias("contract_type"), F.lit("medium").alias("severity"), (F.col("n") == 0).alias("passed"), F.concat(F.lit("outside="), F.col("n")).alias("detail")))
    return out


def contract_checks(spark: SparkSession, data: Sequence[DataContract], metrics: Sequence[MetricContract], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(check_id, contract_type, severity, passed, detail, blocker): a row for each check; tables that are not in ``tables`` are missing.

    A failed check of high or critical severity blocks the publication; a metric out
    of its range is of medium severity and doesn't.
    """
    parts = [p for c in data for p in _table_checks(c, tables.get(c.table), spark)] + [p for c in metrics for p in _metric_checks(c, tables.get(c.source), spark)]
    out = reduce(DataFrame.union, parts)
    return out.withColumn("blocker", ~F.col("passed") & F.col("severity").isin(*BLOCKING))


def publication_gate(checks: DataFrame) -> DataFrame:
    """One row: checks, failed, blockers, and whether publication is allowed; without any check it is not."""
    out = checks.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("blocker").alias("blockers"))
    return out.withColumn("allowed", (F.col("checks") > 0) & (F.col("blockers") == 0))


def require_publishable(checks: DataFrame) -> None:
    """Raises with the first blockers where there are any, or no checks at all."""
    gate = publication_gate(checks).first()
    if not gate.checks:
        raise ValueError("no contract was checked")
    if gate.blockers:
        first = checks.where("blocker").orderBy("check_id").limit(10).collect()
        raise ValueError(f"{gate.blockers} contract blockers: " + "; ".join(f"{r.check_id} ({r.detail})" for r in first))


def lineage_report(spark: SparkSession, declared: Mapping[str, set[tuple[str, str]]], found: Mapping[str, set[tuple[str, str]]]) -> DataFrame:
    """(metric, source, column, status) of what each metric is declared to come from and what its plans read: read, unread or undeclared."""
    rows = []
    for m in sorted({*declared, *found}):
        want, got = declared.get(m, set()), found.get(m, set())
        rows += [(m, *x, "read" if x in want & got else "unread" if x in want else "undeclared") for x in sorted(want | got)]
    return spark.createDataFrame(rows, "metric string, source string, column string, status string")
