"""Contracts, manifests, decision ids, approvals, metrics and lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """Columns with types, key (none if rows may repeat), dates and references (column to table and column)."""

    columns: Mapping[str, str]
    key: Sequence[str]
    dates: Sequence[str] = ()
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def check_contract(df: DataFrame, contract: Contract, tables: Mapping[str, DataFrame] | None = None) -> list[str]:
    """Faults of a raw table: missing or repeated columns, no rows, null or repeated keys, bad dates, orphans."""
    lower = [c.lower() for c in df.columns]
    faults = [f"repeated column {c}" for c in sorted({c for c in lower if lower.count(c) > 1})]
    missing = sorted(set(contract.columns) - set(df.columns))
    faults += [f"missing column {c}" for c in missing]
    if missing or faults:
        return faults
    key = list(contract.key)
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"k_{c}") for c in key), *(F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("timestamp").isNull()).alias(f"d_{c}") for c in contract.dates)).first()
    if not row.n:
        return ["no rows"]
    faults += [f"null key {c}" for c in key if row[f"k_{c}"]]
    faults += [f"bad date {c}" for c in contract.dates if row[f"d_{c}"]]
    if key and df.groupBy(*key).count().where("count > 1").limit(1).count():
        faults.append("repeated key")
    for c, (table, column) in contract.references.items():
        parent = (tables or {}).get(table)
        if parent is None or df.where(F.col(c).isNotNull()).join(parent.select(F.col(column).alias(c)), c, "left_anti").limit(1).count():
            faults.append(f"orphan {c}")
    return faults


def manifest(spark, folder: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def decision_id(*parts: str) -> Column:
    """DEC- and sixteen hex digits of the parts' SHA-256."""
    text = F.concat_ws("|", *(F.col(p).cast("string") for p in parts))
    return F.concat(F.lit("DEC-"), F.upper(F.substring(F.sha2(text, 256), 1, 16)))


def decision_register(cases: DataFrame) -> DataFrame:
    """Decisions in shadow mode: an id each, and whether a person must approve, as all that act must."""
    gate = F.col("decision") != "D06_none"
    return cases.withColumn("decision_id", decision_id("day", "unit_id", "component_id", "decision")).select("decision_id", "day", "unit_id", "component_id", "decision", gate.alias("needs_approval"), F.lit(False).alias("auto"))


APPROVALS = ("approved", "rejected", "escalated")


def approval_faults(approvals: DataFrame, register: DataFrame) -> DataFrame:
    """(decision_id, fault) of approvals with a bad status, reviewer, time, a repeated key or an unknown decision."""
    a = approvals.withColumn("_at", F.col("reviewed_at").cast("string").try_cast("timestamp")).join(register.select("decision_id", F.lit(1).alias("_known")).distinct(), "decision_id", "left")
    repeated = approvals.groupBy("decision_id", "reviewed_at").count().where("count > 1").select("decision_id", F.lit("repeated").alias("fault"))
    fault = F.when(~F.coalesce(F.col("approval_status").isin(*APPROVALS), F.lit(False)), "status").when(F.coalesce(F.trim("reviewer_id"), F.lit("")) == "", "reviewer").when(F.col("_at").isNull(), "time").when(F.col("_known").isNull(), "unknown")
    return a.withColumn("fault", fault).where("fault is not null").select("decision_id", "fault").union(repeated)


def latest_approvals(approvals: DataFrame) -> DataFrame:
    """The last review of each decision."""
    return approvals.groupBy("decision_id").agg(F.max_by(F.struct("approval_status", "reviewer_id"), "reviewed_at").alias("a")).select("decision_id", "a.*")


def reviewed_register(register: DataFrame, reviews: DataFrame, as_of: Column) -> DataFrame:
    """register with the state of each decision as of a moment: approval_status, reviewer_id, reviewed_at, reviews, contradicting, late.

    register: decision_id, day, decision, window_days.  reviews: decision_id,
    approval_status, reviewer_id, reviewed_at, review_id; those after the moment, with
    another status, or without reviewer or time don't count.  The last one holds, of
    one time the larger review_id.  contradicting: reviews of more than one status;
    late: the last came after the decision's window.  Decisions without a review are
    pending.  Nothing is authorised: the register runs in shadow mode.
    """
    c = F.col
    fine = c("approval_status").isin(*APPROVALS) & (F.trim(F.coalesce("reviewer_id", F.lit(""))) != "") & (c("reviewed_at") <= as_of)
    kinds = F.bit_or(sum((F.when(c("approval_status") == s, 1 << k).otherwise(0) for k, s in enumerate(APPROVALS)), F.lit(0)))
    last = reviews.where(fine).groupBy("decision_id").agg(F.max_by(F.struct("approval_status", "reviewer_id", "reviewed_at"), F.struct("reviewed_at", "review_id")).alias("last"), F.count("*").alias("reviews"), (F.bit_count(kinds) > 1).alias("contradicting"))
    out = register.join(last, "decision_id", "left")
    return out.select(
        *(c(x) for x in register.columns), (c("decision") != "D06_none").alias("approval_required"), F.coalesce("last.approval_status", F.lit("pending")).alias("approval_status"), c("last.reviewer_id").alias("reviewer_id"), c("last.reviewed_at").alias("reviewed_at"), F.coalesce("reviews", F.lit(0)).alias("reviews"),
        F.coalesce("contradicting", F.lit(False)).alias("contradicting"), F.coalesce(F.datediff(F.to_date("last.reviewed_at"), "day") > c("window_days"), F.lit(False)).alias("late"), F.when(c("last").isNull(), "system_pending_review").otherwise("human_review").alias("record_origin"), F.lit("shadow").alias("operating_mode"), F.lit(False).alias("auto_execution_allowed"), F.lit(False).alias("execution_authorized"),
    )


def governance_checks(register: DataFrame, reviews: DataFrame) -> DataFrame:
    """(check, passed, observed, expected, blocker): the six checks of a reviewed register, two passes over decisions and one over reviews."""
    c = F.col
    again = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(c("n") - 1), F.lit(0)).alias("n"))
    counts = register.agg(
        F.count_if(c("operating_mode") != "shadow").alias("outside"), F.count_if("auto_execution_allowed").alias("auto"), F.count_if("approval_required").alias("material"), F.count_if((c("decision") != "D06_none") & ~c("approval_required")).alias("unasked"),
        F.count_if((c("approval_status") == "approved") & (F.trim(F.coalesce("reviewer_id", F.lit(""))) == "")).alias("unsigned"),
    )
    one = counts.crossJoin(F.broadcast(again(register, "decision_id").withColumnRenamed("n", "ids"))).crossJoin(F.broadcast(again(reviews, "decision_id", "reviewed_at").withColumnRenamed("n", "events")))  # one row each
    checks = [
        ("decision_id_unique", c("ids") == 0, c("ids"), "0 duplicate ids"), ("shadow_mode_enforced", c("outside") == 0, c("outside"), "0 decisions outside shadow mode"), ("automatic_execution_disabled", c("auto") == 0, c("auto"), "0 automatically executable decisions"),
        ("critical_decisions_require_approval", c("unasked") == 0, c("material"), "all material actions"), ("approved_decisions_have_reviewer", c("unsigned") == 0, c("unsigned"), "0 approved decisions without reviewer"), ("review_event_identity_unique", c("events") == 0, c("events"), "0 duplicate review events"),
    ]
    rows = [F.struct(F.lit(n).alias("check"), ok.alias("passed"), seen.cast("long").alias("observed"), F.lit(want).alias("expected"), F.lit(True).alias("blocker")) for n, ok, seen, want in checks]
    return one.select(F.inline(F.array(*rows)))


def require_governed(checks: DataFrame) -> None:
    """Raises where a check of the register failed."""
    if failed := [r["check"] for r in checks.where("NOT passed").collect()]:
        raise ValueError("decision checks failed: " + ", ".join(failed))


def scalars(**frames: tuple[DataFrame, str]) -> DataFrame:
    """(metric, value) rows from one-row frames; frames: metric to (frame, column)."""
    out = None
    for name, (df, column) in frames.items():
        one = df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))
        out = one if out is None else out.union(one)
    return out


def outlier_units(units: DataFrame, value: str, width: float = 1.5) -> DataFrame:
    """One row: units at or over mean plus ``width`` standard deviations."""
    row = units.agg((F.avg(value) + width * F.stddev_samp(value)).alias("bar"))
    return units.crossJoin(F.broadcast(row)).agg(F.count_if(F.col(value) >= F.col("bar")).alias("n"))
