"""Finite-capacity workshop schedules that equal a serial queue, found in parallel rounds.

The queue's rule: cases come in order of rank, and each takes the first day with room,
its preferred days at all its depots before its later days at any of them.  So a case
depends on those of smaller rank alone.  A round fixes what each case asks for (a stage
and a depot); every depot then books its requests by rank into its own days, and every
case looks up, in the days as they stood before its rank, the first request that would
succeed.  Where no case changes its mind, the bookings are those of the serial queue: the
first case is right at once, and a case is right one round after all before it are.
Cases before the first change are settled and not looked at again.

A depot books at most as many requests as its hours can hold, those of smallest rank, so
nothing grows with the queue but rows.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.functions.ordering import placed
from upkeep.functions.scalars import bound, filled
from upkeep.operators.workshop import CANDIDATES, CAPTURE, CARRY_DAYS, HORIZON, lookup
from upkeep.sources.store import materialize

LEGACY_HORIZON, LEGACY_SHARE = 21, 0.78
#: Resources under which sensitive kinds wait for parts.
SCARCE = 0.50
SENSITIVE = ("pantograph_head", "gearbox_drive", "brake_disc", "brake_disc_pad")


@dataclass(frozen=True)
class Booking:
    """Hours of a booking: setup on a day without the unit, again with it, bonus off where the family is there, at least ``least``."""

    setup: float = 1.10
    again: float = 0.35
    bonus: float = 0.15
    least: float = 1.8

    def need(self, case: Column, log: Column) -> Column:
        there = F.exists(log, lambda b: b["unit"] == case["unit"])
        same = F.exists(log, lambda b: b["family"] == case["family"])
        return F.greatest(F.lit(self.least), case["hours"] + F.when(there, self.again).otherwise(self.setup) + F.when(same, -self.bonus).otherwise(0.0))

    def least_need(self) -> float:
        return min(self.setup, self.again) - self.bonus


PLAIN = Booking(0.0, 0.0, 0.0, 0.0)
_LOG = "array<struct<rank:long,regular:double,flex:double,unit:long,family:string,slot:string>>"


def _left(day: Column, log: Column, name: str) -> Column:
    """Hours left on a day after the bookings of a log."""
    return F.when(F.size(log) > 0, F.element_at(log, -1)[name]).otherwise(day[name])


def _fits(day: Column, log: Column, case: Column, late: Column, rule: Booking) -> Column:
    regular, all_ = _left(day, log, "regular"), _left(day, log, "regular") + _left(day, log, "flex")
    return bound(rule.need(case, log), lambda need: (regular >= need) | (late & case["flexible"] & (all_ >= need)))


def _booked(day: Column, case: Column, rule: Booking) -> Column:
    """The day with the case's booking at the end of its log: regular hours, or all of them and some flexible ones."""
    regular, flex = _left(day, day["log"], "regular"), _left(day, day["log"], "flex")

    def entry(need: Column) -> Column:
        plain = regular >= need
        return F.struct(
            case["rank"].alias("rank"), F.when(plain, regular - need).otherwise(0.0).alias("regular"), F.when(plain, flex).otherwise(flex - (need - regular)).alias("flex"),
            case["unit"].alias("unit"), case["family"].alias("family"), F.when(plain, "regular").otherwise("flex").alias("slot"),
        )

    log = F.concat(day["log"], F.array(bound(rule.need(case, day["log"]), entry)).cast(_LOG))
    return F.struct(day["day"].alias("day"), day["regular"].alias("regular"), day["flex"].alias("flex"), log.alias("log"))


def _logs(now: DataFrame, days: DataFrame, rule: Booking, most: int | None) -> DataFrame:
    """(depot_id, days): each depot's days with the log of what it books of the requests of ``now``."""
    c = F.col
    late = c("option") >= CANDIDATES
    asked = now.where("option IS NOT NULL").withColumns({"depot_id": F.element_at("tries", (c("option") % CANDIDATES + 1).cast("int")), "late": late, "from_day": F.when(late, c("near") + 1).otherwise(1), "to_day": F.when(late, c("far")).otherwise(c("near"))})
    if most is not None:
        asked = asked.withColumn("n", F.row_number().over(Window.partitionBy("depot_id").orderBy("rank"))).where(c("n") <= most)
    asked = asked.groupBy("depot_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit", "family", "hours", "flexible", "late", "from_day", "to_day"))).alias("asked"))

    def book(state: Column, case: Column) -> Column:
        open_ = F.filter(state, lambda d: (d["day"] >= case["from_day"]) & (d["day"] <= case["to_day"]) & _fits(d, d["log"], case, case["late"], rule))
        return bound(F.get(open_, F.lit(0))["day"], lambda at: F.when(at.isNull(), state).otherwise(F.transform(state, lambda d: F.when(d["day"] == at, _booked(d, case, rule)).otherwise(d))))

    state = F.aggregate(F.coalesce("asked", F.array().cast("array<struct<rank:long,unit:long,family:string,hours:double,flexible:boolean,late:boolean,from_day:int,to_day:int>>")), c("days"), book)
    return days.join(asked, "depot_id", "left").select("depot_id", state.alias("days"))


def _answers(now: DataFrame, logs: DataFrame, rule: Booking) -> DataFrame:
    """now with the first request of each case that would succeed, and whether it is another one."""
    each = now.select("*", F.posexplode_outer("tries").alias("place", "depot_id")).join(logs, "depot_id", "left")
    case = F.struct("rank", "unit", "family", "hours", "flexible")

    def works(first: Column, last: Column, late: bool) -> Column:
        before = lambda d: F.filter(d["log"], lambda b: b["rank"] < F.col("rank"))
        return F.exists("days", lambda d: (d["day"] >= first) & (d["day"] <= last) & bound(before(d), lambda log: _fits(d, log, case, F.lit(late), rule)))

    near, far = F.col("near"), F.col("far")
    option = F.when(works(F.lit(1), near, False), F.col("place")).when(works(near + 1, far, True), F.col("place") + CANDIDATES)
    found = each.groupBy(*now.columns).agg(F.min(option).alias("next"))
    out = found.withColumn("changed", ~F.col("next").eqNullSafe(F.col("option"))).drop("option").withColumnRenamed("next", "option")
    return out


def serial_bookings(cases: DataFrame, calendar: DataFrame, rule: Booking | None = None, checkpoint=materialize) -> tuple[DataFrame, DataFrame]:
    """(bookings, ledger) of the serial queue.

    cases: rank (unique), unit, family, hours, flexible (may use flexible hours late),
    tries (at most CANDIDATES depots), near and far (last preferred and last later
    day).  calendar: depot_id, offset, regular_h, flex_h.  bookings: rank, depot_id,
    day, slot; a case without one has no row.  ledger: depot_id, offset, regular_left,
    flex_left.  A null unit or family equals none; depots without calendar have no
    room.  ``checkpoint(df, name)`` writes each round, so lost executors cost a round.
    """
    rule = rule or Booking()
    empty = F.array().cast(_LOG)
    day = F.struct(F.col("offset").cast("int").alias("day"), F.col("regular_h").alias("regular"), F.col("flex_h").alias("flex"), empty.alias("log"))
    days = checkpoint(calendar.groupBy("depot_id").agg(F.array_sort(F.collect_list(day)).alias("days"), F.sum(F.col("regular_h") + F.col("flex_h")).alias("hours")), "days")
    now = checkpoint(cases.select(
        F.col("rank").cast("long").alias("rank"), F.col("unit").cast("long").alias("unit"), "family", "hours", F.coalesce("flexible", F.lit(False)).alias("flexible"), F.col("tries").cast("array<long>").alias("tries"),
        F.col("near").cast("int").alias("near"), F.col("far").cast("int").alias("far"), F.when(F.size("tries") > 0, 0).alias("option"),
    ), "asked0")
    sizes = now.agg(F.min("hours").alias("least")).crossJoin(days.agg(F.max("hours").alias("room"))).first()
    least = max(rule.least, (sizes.least or 0.0) + rule.least_need())
    most = int((sizes.room or 0.0) / least) + 1 if least > 0 else None

    settled, k = None, 0
    while True:
        answers = checkpoint(_answers(now, _logs(now if settled is None else settled.unionByName(now), days, rule, most), rule), f"asked{k + 1}")
        first = answers.where("changed").agg(F.min("rank")).first()[0]
        rest = answers.drop("changed")
        if first is None:
            now = rest if settled is None else settled.unionByName(rest)
            break
        done = rest.where(F.col("rank") < first)
        settled = done if settled is None else settled.unionByName(done)
        now, k = rest.where(F.col("rank") >= first), k + 1
    logs = checkpoint(_logs(now, days, rule, most).select("depot_id", F.inline("days")), "booked")
    bookings = logs.select("depot_id", "day", F.inline("log").alias("rank", "r", "f", "unit", "family", "slot")).select("rank", "depot_id", "day", "slot")
    left = lambda name: F.when(F.size("log") > 0, F.element_at("log", -1)[name]).otherwise(F.col(name)).alias(f"{name}_left")
    return bookings, logs.select("depot_id", F.col("day").alias("offset"), left("regular"), left("flex"))


def _plan(cases: DataFrame, bookings: DataFrame, status: Column, detail: Column) -> DataFrame:
    c = F.col
    return cases.drop("depot_id", "day", "slot").join(bookings, "rank", "left").select(
        "component_id", "unit_id", F.coalesce("depot_id", c("depot").cast("long")).alias("depot_id"), "day", F.coalesce("slot", F.lit("none")).alias("slot"), status.alias("status"), detail.alias("detail"), F.greatest(F.lit(0), c("day") - c("near")).alias("days_late"),
        F.when(c("depot_id").isNotNull(), (c("depot_id") != c("depot")).cast("int")).otherwise(0).alias("moved"), "entry", "bucket", "hours", "deferral", "service", "delay_cost",
    )


def _ledger(calendar: DataFrame, left: DataFrame) -> DataFrame:
    both = calendar.join(left, ["depot_id", "offset"])
    c = F.col
    return both.withColumns({"capacity_h": c("regular_h") + c("flex_h"), "used_h": c("regular_h") - c("regular_left") + c("flex_h") - c("flex_left")})


def schedule(cases: DataFrame, calendar: DataFrame, resources: float = 0.6, checkpoint=materialize) -> tuple[DataFrame, DataFrame]:
    """(plan, ledger) of queued cases over 35 days at up to three depots each, as the serial queue books them.

    plan: component_id, depot_id, day (null if open), slot, status, detail, days_late,
    moved.  ledger: calendar with the hours used.  An open case waits for a decision,
    for operations, for parts or for capacity, the first that holds.
    """
    c = F.col
    tries = F.slice(F.array_distinct(F.concat(F.array(c("depot").cast("long")), F.split("candidates", "\\|").cast("array<long>"), F.array(c("home").cast("long")))), 1, CANDIDATES)
    window = F.greatest(F.lit(1), c("window_days").cast("int"))
    cases = checkpoint(placed(cases, "rank", [c("bucket"), c("queue_score").desc(), c("entry")]), "queue")
    cases = cases.withColumns({"near": window, "tries": tries})
    asked = cases.select("rank", c("unit_id").alias("unit"), "family", "hours", c("bucket").isin("P1", "P2").alias("flexible"), "tries", F.least(F.lit(HORIZON), window).alias("near"), F.least(F.lit(HORIZON), window + lookup("bucket", CARRY_DAYS, 14)).alias("far"))
    bookings, left = serial_bookings(asked, calendar, checkpoint=checkpoint)
    escalate = (c("decision") == "D07_conflict") | (c("decision_conflict") == 1) | ((c("bucket") == "P1") & (c("confidence_flag") == "low"))
    operation = (filled("windows", 0) <= 0) & c("decision").isin("D01_now", "D02_window", "D02B_blocked") & c("bucket").isin("P1", "P2") & (c("service") >= 82) & (c("service_criticality") >= 0.70)
    parts = F.lit(resources < SCARCE) & c("kind").isin(*SENSITIVE) & (c("priority") >= 62)
    on_time = c("day") <= c("near")
    status = F.when(on_time, "booked").when(c("day").isNotNull(), "next_window").when(escalate, "escalate").when(operation, "waits_operation").when(parts, "waits_parts").otherwise("waits_capacity")
    detail = F.when(on_time, "in preferred window").when(c("day").isNotNull(), "carried over").when(escalate, "high risk with low confidence or conflict").when(operation, "no feasible operating window").when(parts, "parts at risk under low resources").otherwise("not enough capacity in the horizon")
    return _plan(cases, bookings, status, detail), _ledger(calendar, left)


def legacy_calendar(depots: DataFrame, start: Column) -> DataFrame:
    """The first plan's days: a share of each depot's capacity, the same each day; depots: depot_id, capacity."""
    days = depots.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(LEGACY_HORIZON))))
    return days.select("depot_id", "offset", F.date_add(start, F.col("offset")).alias("slot"), (F.col("capacity") * LEGACY_SHARE).alias("regular_h"), F.lit(0.0).alias("flex_h"))


def legacy_schedule(cases: DataFrame, calendar: DataFrame, checkpoint=materialize) -> tuple[DataFrame, DataFrame]:
    """(plan, ledger) of the first plan: 21 days, entry order, only the best depot, strict windows, no setup hours."""
    c = F.col
    window = F.greatest(F.lit(1), c("window_days").cast("int"))
    cases = cases.withColumns({"rank": c("entry").cast("long"), "near": window})
    last = F.least(F.lit(LEGACY_HORIZON), window)
    asked = cases.select("rank", c("unit_id").alias("unit"), "family", "hours", F.lit(False).alias("flexible"), F.array(c("depot").cast("long")).alias("tries"), last.alias("near"), last.alias("far"))
    bookings, left = serial_bookings(asked, calendar, PLAIN, checkpoint)
    there = c("day").isNotNull()
    return _plan(cases, bookings, F.when(there, "booked").otherwise("waits_capacity"), F.when(there, "in preferred window").otherwise("no slot within the window")), _ledger(calendar, left)


METRICS = ("cases", "booked_pct", "next_window_pct", "pending_pct", "waits_capacity_pct", "waits_parts_pct", "waits_operation_pct", "escalate_pct", "actionable_pct", "utilisation_pct", "used_h", "residual_risk_pct", "captured", "not_captured")


def schedule_metrics(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Shares by status, utilisation, residual risk, captured and lost value: one row."""
    weight = 0.6 * filled("deferral", 0) + 0.4 * filled("service", 0)
    done = F.col("status").isin("booked", "next_window")
    share = lambda x: F.avg(x.cast("double")) * 100
    cost = filled("delay_cost", 0)
    a = plan.agg(
        F.count("*").alias("cases"), *(share(F.col("status") == s).alias(f"{s}_pct") for s in CAPTURE), share(~done).alias("pending_pct"), share(done).alias("actionable_pct"),
        (F.sum(F.when(~done, weight).otherwise(0.0)) / F.greatest(F.sum(weight), F.lit(1e-6)) * 100).alias("residual_risk_pct"), F.sum(cost * lookup("status", CAPTURE, 0.0)).alias("captured"), F.sum(cost).alias("value"),
    )
    b = ledger.agg(F.sum("used_h").alias("used_h"), (F.coalesce(F.try_divide(F.sum("used_h"), F.sum("capacity_h")), F.lit(0.0)) * 100).alias("utilisation_pct"))
    return a.crossJoin(F.broadcast(b)).withColumn("not_captured", F.col("value") - F.col("captured")).select(*METRICS)  # one row each


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two rows of metrics, rounded to three digits as plans report them."""
    long = lambda df, name: df.select(*(F.col(m).cast("double") for m in METRICS)).unpivot([], [*METRICS], "metric", name)
    both = long(before, "before").join(F.broadcast(long(after, "after")), "metric")  # a row for each metric
    r = lambda x: F.bround(x, 3)
    return both.select("metric", r("before").alias("before"), r("after").alias("after"), r(r("after") - r("before")).alias("delta"))


def status_shares(plans: dict[str, DataFrame]) -> DataFrame:
    """(plan, status, cases, share_pct) of each plan."""
    out = None
    for name, plan in plans.items():
        n = plan.groupBy("status").agg(F.count("*").alias("cases"))
        total = F.sum("cases").over(Window.partitionBy("plan"))  # a row for each status
        one = n.withColumn("plan", F.lit(name)).withColumn("share_pct", F.col("cases") / total * 100).select("plan", "status", "cases", "share_pct")
        out = one if out is None else out.unionByName(one)
    return out


def bottlenecks(plan: DataFrame) -> DataFrame:
    """By depot: cases, hours asked for, cases that wait for capacity and their share; the fullest come first."""
    waits = F.count_if(F.col("status") == "waits_capacity")
    df = plan.groupBy("depot_id").agg(F.count("*").alias("cases"), F.sum("hours").alias("hours"), waits.alias("waiting"), F.round(waits / F.count("*") * 100, 2).alias("pending_pct"))
    return df.orderBy(F.col("waiting").desc(), F.col("hours").desc(), "depot_id")
