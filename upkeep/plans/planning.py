"""Queries of workshop planning: both schedules and what they achieve, the capacity gate, and the bounded allocation.

The SQL of the schedules books the queue one case a step, by a recursive query.  An
allocation is a search, which SQL can't express; tests hold it against an exhaustive one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.operators import allocation, scheduling, workshop
from upkeep.plans import catalogue, decisions
from upkeep.plans.catalogue import Query
from upkeep.plans.ctes import CTES
from upkeep.sources.fleet import Fleet

RESOURCES = 0.6


def _kept(f: Fleet, tag: str):
    """A checkpoint that writes into the fleet's tables under a tag."""
    return lambda df, name: f.stored(f"{tag}-{name}", lambda: df)


def redesigned(f: Fleet) -> tuple[DataFrame, DataFrame]:
    """(plan, ledger) of the 35-day schedule."""
    plan, ledger = scheduling.schedule(catalogue.cases(f), catalogue.calendar(f), RESOURCES, _kept(f, "redesigned"))
    return f.stored("redesigned-plan", lambda: plan), ledger


def legacy(f: Fleet) -> tuple[DataFrame, DataFrame]:
    """(plan, ledger) of the 21-day schedule."""
    days = scheduling.legacy_calendar(f.depots.select("depot_id", "capacity").crossJoin(F.broadcast(f.span)), F.col("last_day"))  # one row
    plan, ledger = scheduling.legacy_schedule(catalogue.cases(f), days, _kept(f, "legacy"))
    return f.stored("legacy-plan", lambda: plan), ledger


def weekly(f: Fleet) -> DataFrame:
    """Hours by depot and week of the calendar."""
    return catalogue.calendar(f).groupBy("depot_id", F.ceil(F.col("offset") / 7).cast("int").alias("week")).agg(F.sum(F.col("regular_h") + F.col("flex_h")).alias("hours"))


def _allocated(f: Fleet) -> tuple[DataFrame, DataFrame]:
    weeks = f.stored("weekly", lambda: weekly(f))
    return allocation.bounded_allocation(allocation.allocation_candidates(catalogue.cases(f), weeks.select("depot_id", "week")), weeks, checkpoint=_kept(f, "allocation"))


def _allocation_rows(f: Fleet) -> DataFrame:
    rows, quality = _allocated(f)
    return rows.crossJoin(F.broadcast(quality.select(F.col("label").alias("solver_status"), "gap")))  # one row


def _both_metrics(f: Fleet) -> DataFrame:
    return scheduling.before_after(scheduling.schedule_metrics(*legacy(f)), scheduling.schedule_metrics(*redesigned(f)))



def _booked_sql(queue: str, slots: str, rule: scheduling.Booking) -> str:
    """The bookings of a queue, a case a step.  queue: rank, unit, family, hours, flexible, options (s, late) in order; slots: s, regular, flex."""
    own = "list_filter(log, lambda b: b.s = o.s)"
    used = lambda c: f"coalesce(list_sum(list_transform({own}, lambda b: b.{c})), 0.0)"
    met = lambda c: f"len(list_filter({own}, lambda b: coalesce(b.{c} = q.{c}, false))) > 0"
    need = f"greatest({rule.least}::DOUBLE, q.hours + CASE WHEN {met('unit')} THEN {rule.again} ELSE {rule.setup} END::DOUBLE + CASE WHEN {met('family')} THEN {-rule.bonus} ELSE 0 END::DOUBLE)"
    looked = f"list_transform(q.options, lambda o: struct_pack(s := o.s, late := o.late, lr := c.regular[o.s] - {used('r')}, lf := c.flex[o.s] - {used('f')}, need := {need}))"
    found = f"list_filter({looked}, lambda e: e.lr >= e.need OR (e.late AND q.flexible AND e.lr + e.lf >= e.need))[1]"
    entry = "struct_pack(rank := rank, s := p.s, r := CASE WHEN p.lr >= p.need THEN p.need ELSE p.lr END, f := CASE WHEN p.lr >= p.need THEN 0.0::DOUBLE ELSE p.need - p.lr END, unit := unit, family := family, slot := CASE WHEN p.lr >= p.need THEN 'regular' ELSE 'flex' END)"
    return f"""WITH RECURSIVE filled AS (SELECT map_from_entries(list((s, regular))) AS regular, map_from_entries(list((s, flex))) AS flex FROM {slots}),
steps AS (SELECT 0::BIGINT AS rank, []::STRUCT(rank BIGINT, s BIGINT, r DOUBLE, f DOUBLE, unit BIGINT, family VARCHAR, slot VARCHAR)[] AS log
  UNION ALL SELECT rank, CASE WHEN p IS NULL THEN log ELSE list_append(log, {entry}) END FROM (SELECT q.rank, q.unit, q.family, t.log, {found} AS p FROM steps t JOIN {queue} q ON q.rank = t.rank + 1 CROSS JOIN filled c))
SELECT b.rank, b.s // 100 AS depot_id, (b.s % 100)::INT AS day, b.slot, b.r, b.f FROM (SELECT unnest(log) AS b FROM steps WHERE rank = (SELECT max(rank) FROM steps))"""


def _options_sql(tries: str) -> str:
    days = lambda first, last, late: f"flatten(list_transform({tries}, lambda d: list_transform(range({first}, {last} + 1), lambda k: struct_pack(s := d * 100 + k, late := {late}))))"
    return f"list_concat({days('1', 'near_day', 'false')}, {days('near_day + 1', 'far_day', 'true')})"


_CALENDAR = str(catalogue.Q["capacity_calendar"].source)
_WINDOW = "greatest(1, window_days)"
CTES["days35"] = f"SELECT depot_id, \"offset\", slot AS slot_day, regular_h, flex_h, depot_id * 100 + \"offset\" AS s, regular_h AS regular, flex_h AS flex FROM {_CALENDAR}"
CTES["days21"] = f"SELECT depot_id, k::INT AS \"offset\", capacity * {scheduling.LEGACY_SHARE}::DOUBLE AS regular_h, 0.0::DOUBLE AS flex_h, depot_id * 100 + k AS s, regular_h AS regular, flex_h AS flex FROM depots, range(1, {scheduling.LEGACY_HORIZON + 1}) r(k)"
CTES["queue35"] = f"""SELECT *, {_options_sql("string_split(candidates, '|')[1:3]::BIGINT[]")} AS options FROM (SELECT *, row_number() OVER (ORDER BY bucket, queue_score DESC, entry) AS rank, unit_id AS unit, bucket IN ('P1', 'P2') AS flexible, {_WINDOW} AS preferred, least({workshop.HORIZON}, {_WINDOW}) AS near_day,
    least({workshop.HORIZON}, {_WINDOW} + {decisions._lookup("bucket", workshop.CARRY_DAYS, 14)}) AS far_day FROM cases)"""
CTES["queue21"] = f"SELECT *, {_options_sql('[depot]')} AS options FROM (SELECT *, entry AS rank, unit_id AS unit, false AS flexible, {_WINDOW} AS preferred, least({scheduling.LEGACY_HORIZON}, {_WINDOW}) AS near_day, near_day AS far_day FROM cases)"
CTES["booked35"], CTES["booked21"] = _booked_sql("queue35", "days35", scheduling.Booking()), _booked_sql("queue21", "days21", scheduling.PLAIN)
_CONFLICT = "decision = 'D07_conflict' OR decision_conflict = 1 OR (bucket = 'P1' AND confidence_flag = 'low')"
_OPERATION = "coalesce(windows, 0) <= 0 AND decision IN ('D01_now', 'D02_window', 'D02B_blocked') AND bucket IN ('P1', 'P2') AND service >= 82 AND service_criticality >= 0.70"


def _plan_sql(queue: str, booked: str, open_status: str, open_detail: str) -> str:
    return f"""SELECT component_id, unit_id, coalesce(b.depot_id, depot) AS depot_id, b.day AS planned_day, coalesce(b.slot, 'none') AS slot, CASE WHEN b.day <= preferred THEN 'booked' WHEN b.day IS NOT NULL THEN 'next_window' {open_status} END AS status,
    CASE WHEN b.day <= preferred THEN 'in preferred window' WHEN b.day IS NOT NULL THEN 'carried over' {open_detail} END AS detail, greatest(0, b.day - preferred) AS days_late, CASE WHEN b.day IS NOT NULL THEN (b.depot_id <> depot)::INT ELSE 0 END AS moved, bucket, hours, deferral, service, delay_cost
    FROM {queue} q LEFT JOIN {booked} b ON b.rank = q.rank"""


def _ledger_sql(days: str, booked: str) -> str:
    return f"SELECT *, regular_h + flex_h AS capacity_h, regular_h - regular_left + flex_h - flex_left AS used_h FROM (SELECT d.*, d.regular_h - coalesce(r, 0) AS regular_left, d.flex_h - coalesce(f, 0) AS flex_left FROM {days} d LEFT JOIN (SELECT depot_id * 100 + day AS s, sum(r) AS r, sum(f) AS f FROM {booked} GROUP BY 1) USING (s))"


CTES["plan35"] = _plan_sql("queue35", "booked35", f"WHEN {_CONFLICT} THEN 'escalate' WHEN {_OPERATION} THEN 'waits_operation' ELSE 'waits_capacity'", f"WHEN {_CONFLICT} THEN 'high risk with low confidence or conflict' WHEN {_OPERATION} THEN 'no feasible operating window' ELSE 'not enough capacity in the horizon'")
CTES["plan21"] = _plan_sql("queue21", "booked21", "ELSE 'waits_capacity'", "ELSE 'no slot within the window'")
CTES["ledger35"], CTES["ledger21"] = _ledger_sql("days35", "booked35"), _ledger_sql("days21", "booked21")


def _metrics_sql(plan: str, ledger: str) -> str:
    share = lambda x: f"avg(({x})::INT) * 100"
    done, weight = "status IN ('booked', 'next_window')", "(0.6 * coalesce(deferral, 0) + 0.4 * coalesce(service, 0))"
    capture = decisions._lookup("status", workshop.CAPTURE, 0.0)
    states = ", ".join(f"{share(f'status = $${n}$$')} AS {n}_pct".replace("$$", "'") for n in workshop.CAPTURE)
    return f"""SELECT *, value - captured AS not_captured FROM (SELECT count(*) AS cases, {states}, {share(f'NOT {done}')} AS pending_pct, {share(done)} AS actionable_pct, coalesce(sum({weight}) FILTER (NOT {done}), 0) / greatest(sum({weight}), 1e-6) * 100 AS residual_risk_pct,
    sum(coalesce(delay_cost, 0) * {capture}) AS captured, sum(coalesce(delay_cost, 0)) AS value FROM {plan}) CROSS JOIN (SELECT sum(used_h) AS used_h, coalesce(sum(used_h) / nullif(sum(capacity_h), 0), 0) * 100 AS utilisation_pct FROM {ledger})"""


CTES["metrics35"], CTES["metrics21"] = _metrics_sql("plan35", "ledger35"), _metrics_sql("plan21", "ledger21")
_CHANGES = "(SELECT *, round_even(after - before, 3) AS delta FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round_even((SELECT {m} FROM metrics21)::DOUBLE, 3) AS before, round_even((SELECT {m} FROM metrics35)::DOUBLE, 3) AS after" for m in scheduling.METRICS) + "))"
_SHARES = "(SELECT plan, status, count(*) AS cases, count(*) / sum(count(*)) OVER (PARTITION BY plan) * 100 AS share_pct FROM (SELECT 'legacy' AS plan, status FROM plan21 UNION ALL SELECT 'redesigned', status FROM plan35) GROUP BY 1, 2)"
_NECKS = "(SELECT depot_id, count(*) AS cases, count(*) FILTER (status = 'waits_capacity') AS waiting, sum(hours) AS hours, round(count(*) FILTER (status = 'waits_capacity') / count(*) * 100, 2) AS pending_pct FROM plan21 GROUP BY 1)"
_NEED = f"(SELECT *, max_utilisation >= {workshop.FULL_DAY} AND saturated_share >= {workshop.FULL_SHARE} AND waiting > 0 AS required FROM (SELECT coalesce(max(used_h / nullif(capacity_h, 0)), 0) AS max_utilisation, coalesce(avg((used_h / nullif(capacity_h, 0) >= {workshop.FULL_DAY})::INT), 0) AS saturated_share FROM ledger35) CROSS JOIN (SELECT count(*) FILTER (status = 'waits_capacity') AS waiting FROM plan35))"
_STRESS = f"""(SELECT *, demand_h / nullif(available_h, 0) AS load, demand_h > available_h * {workshop.FULL_DAY} AS breach FROM (SELECT scenario, (u + w) * d AS demand_h, c * k AS available_h FROM (VALUES ('baseline', 1.0::DOUBLE, 1.0::DOUBLE), ('demand_plus_15', 1.15, 1.0), ('capacity_minus_10', 1.0, 0.9), ('both', 1.15, 0.9)) v(scenario, d, k)
    CROSS JOIN (SELECT sum(capacity_h) AS c, sum(used_h) AS u FROM ledger35) CROSS JOIN (SELECT coalesce(sum(hours) FILTER (status = 'waits_capacity'), 0) AS w FROM plan35)))"""

_PLAN = "component_id unit_id depot_id planned_day slot status detail days_late moved bucket"
Q: dict[str, Query] = {
    "schedule_plan": Query(lambda f: redesigned(f)[0].withColumnRenamed("day", "planned_day"), _PLAN, "", "plan35"),
    "schedule_plan_legacy": Query(lambda f: legacy(f)[0].withColumnRenamed("day", "planned_day"), _PLAN, "", "plan21"),
    "schedule_ledger": Query(lambda f: redesigned(f)[1], "depot_id offset", "regular_h flex_h regular_left flex_left capacity_h used_h", "ledger35"),
    "schedule_metrics": Query(lambda f: scheduling.schedule_metrics(*redesigned(f)), "cases", "actionable_pct pending_pct residual_risk_pct captured not_captured used_h utilisation_pct", "metrics35"),
    "schedule_before_after": Query(_both_metrics, "metric", "before after delta", _CHANGES),
    "schedule_status_shares": Query(lambda f: scheduling.status_shares({"legacy": legacy(f)[0], "redesigned": redesigned(f)[0]}), "plan status cases", "share_pct", _SHARES),
    "schedule_bottlenecks": Query(lambda f: scheduling.bottlenecks(legacy(f)[0]), "depot_id cases waiting", "hours pending_pct", _NECKS),
    "capacity_gate": Query(lambda f: workshop.capacity_gate(*redesigned(f)), "waiting required", "max_utilisation saturated_share", _NEED),
    "stress_scenarios": Query(lambda f: workshop.stress_scenarios(*redesigned(f)), "scenario breach", "demand_h available_h load", _STRESS),
    "capacity_allocation": Query(_allocation_rows, "component_id depot_id week status solver_status", "cost gap"),
    "allocation_quality": Query(lambda f: _allocated(f)[1], "label rounds cases allocated", "cost bound gap"),
    "allocation_utilisation": Query(lambda f: allocation.utilisation(_allocated(f)[0], weekly(f)), "depot_id week", "hours used_h utilisation"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q.run for name, q in Q.items()}
SQL: dict[str, str] = {name: q.sql() for name, q in Q.items() if q.source}
