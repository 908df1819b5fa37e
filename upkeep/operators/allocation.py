"""Allocation of cases to depot-weeks with a bound on what any allocation must cost.

Prices on depot-weeks (Lagrangian multipliers of their hours) make cases independent:
each takes its cheapest option at cost plus price times hours, in one pass without a
join, and what this costs, less the priced capacity, bounds every allocation from
below.  Subgradient rounds move the prices by the overload.  The allocation itself comes
from rounds of bids, at these prices or at plain costs, whichever is cheaper, and
exchanges that make room for cases left open.  A round sends a row for each depot-week to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.operators.workshop import CARRY_DAYS, HORIZON, lookup
from upkeep.sources.store import materialize

#: Gap of a solution that counts as optimal within tolerance, and the widest that is accepted.
TOLERANCE, ACCEPTED = 0.05, 0.10
ROUNDS, GOOD_GAP, PATIENCE = 60, 0.001, 4
ASKERS = 16
#: Prices of more depot-weeks than this are joined instead of being a constant of the plan.
CONSTANT_SLOTS = 10_000


def allocation_candidates(cases: DataFrame, weeks: DataFrame) -> DataFrame:
    """Cost of each case in each candidate depot and week, and of leaving it open (null depot); weeks: depot_id, week."""
    c = F.col
    span = F.greatest(F.lit(1), F.ceil(F.least(F.lit(HORIZON), c("window_days") + lookup("bucket", CARRY_DAYS, 14)) / 7))
    ranked = cases.select("component_id", "hours", "queue_score", "deferral", "home", span.alias("span"), F.posexplode(F.split("candidates", "\\|")).alias("place", "d")).withColumn("depot_id", c("d").cast("long"))
    slots = ranked.join(weeks, "depot_id").where(c("week") <= c("span"))
    cost = c("place") * 4.0 + (c("week") - 1) * (1.0 + c("queue_score") / 25.0) + F.when(c("depot_id") == c("home"), 0.0).otherwise(2.0)
    out = slots.select("component_id", "hours", "depot_id", "week", cost.alias("cost"))
    none = cases.select("component_id", "hours", F.lit(None).cast("long").alias("depot_id"), F.lit(None).cast("int").alias("week"), (100.0 + c("queue_score") * 5.0 + c("deferral") * 2.0).alias("cost"))
    return out.unionByName(none)


def allocate(candidates: DataFrame, capacity: DataFrame, checkpoint=materialize, prices: DataFrame | None = None) -> DataFrame:
    """(component_id, depot_id, week, cost, hours): each case at its cheapest slot with room, by rounds of bids.

    In a round every open case bids for its cheapest slot left, at cost plus price
    times hours (prices: depot_id, week, price; none by default); a slot takes bids by
    regret, the loss of going elsewhere, while their running hours fit.  The first of
    them always fits, so each round with a bid books a case; the rounds end when no
    open case has a slot with room, and these get a null slot.  Of a slot's bids only
    as many are ordered as its hours can hold.  ``checkpoint`` writes each round's
    results.  capacity: depot_id, week, hours.
    """
    room = capacity.select("depot_id", "week", F.col("hours").alias("room"))
    slots, taken, k = candidates.where("depot_id is not null"), None, 0
    if prices is None:
        slots = slots.withColumn("bid", F.col("cost"))
    else:
        slots = slots.join(prices, ["depot_id", "week"], "left").withColumn("bid", F.col("cost") + F.coalesce("price", F.lit(0.0)) * F.col("hours")).drop("price")
    bounds = candidates.agg(F.min("hours").alias("least")).crossJoin(room.agg(F.max("room").alias("room"))).first()
    most = int((bounds.room or 0.0) / bounds.least) + 1 if bounds.least and bounds.least > 0 else None
    w = Window.partitionBy("component_id").orderBy("bid", "depot_id", "week")
    by_regret = Window.partitionBy("depot_id", "week").orderBy(F.col("regret").desc(), "component_id")
    fill = by_regret.rowsBetween(Window.unboundedPreceding, 0)
    while True:
        live = checkpoint(slots.join(room, ["depot_id", "week"]).where("hours <= room"), f"slots{k}")  # room only shrinks: the others are lost for good
        bids = live.withColumns({"n": F.row_number().over(w), "next": F.lead("bid").over(w)}).where("n = 1").withColumn("regret", F.coalesce("next", F.lit(1e6)) - F.col("bid"))
        if most is not None:
            bids = bids.withColumn("place", F.row_number().over(by_regret)).where(F.col("place") <= most)
        won = checkpoint(bids.withColumn("sum", F.sum("hours").over(fill)).where("sum <= room").select("component_id", "depot_id", "week", "cost", "hours"), f"bids{k}")
        taken = won if taken is None else taken.unionByName(won)
        if won.isEmpty():
            break
        slots = live.drop("room").join(won.select("component_id"), "component_id", "left_anti")
        used = won.groupBy("depot_id", "week").agg(F.sum("hours").alias("u"))
        room = checkpoint(room.join(used, ["depot_id", "week"], "left").select("depot_id", "week", (F.col("room") - F.coalesce("u", F.lit(0.0))).alias("room")), f"room{k}")
        k += 1
    taken = checkpoint(taken, "taken")
    rest = candidates.where("depot_id is null").join(taken.select("component_id"), "component_id", "left_anti").select("component_id", "depot_id", "week", "cost", "hours")
    return taken.unionByName(rest)


def repair(taken: DataFrame, candidates: DataFrame, capacity: DataFrame, checkpoint=materialize) -> DataFrame:
    """taken with open cases placed where another case that has a second choice makes room, while that lowers the cost.

    A round finds for each open case the cheapest such exchange: the slot it takes, the
    case that leaves it, and where that one goes.  Exchanges that are the best at both
    their slots are made together, so each round lowers the cost; of the open cases
    that look at a slot the ASKERS dearest are tried first.
    """
    slots = candidates.where("depot_id IS NOT NULL")
    best_at = lambda c: F.row_number().over(Window.partitionBy(f"{c}_depot", f"{c}_week").orderBy("total", "component_id"))
    k = 0
    while True:
        used = taken.where("depot_id IS NOT NULL").groupBy("depot_id", "week").agg(F.sum("hours").alias("used"))
        room = capacity.join(used, ["depot_id", "week"], "left").select("depot_id", "week", (F.col("hours") - F.coalesce("used", F.lit(0.0))).alias("room"))
        booked = taken.where("depot_id IS NOT NULL").select(F.col("component_id").alias("leaves"), F.col("depot_id").alias("from_depot"), F.col("week").alias("from_week"), F.col("cost").alias("was"), F.col("hours").alias("leaves_h"))
        other = slots.select(F.col("component_id").alias("leaves"), "depot_id", "week", F.col("cost").alias("then")).join(room, ["depot_id", "week"])
        moves = booked.join(other, "leaves").where("room >= leaves_h AND NOT (depot_id = from_depot AND week = from_week)")
        moves = moves.groupBy("leaves", "from_depot", "from_week", "leaves_h").agg(F.min(F.struct((F.col("then") - F.col("was")).alias("extra"), F.col("depot_id").alias("to_depot"), F.col("week").alias("to_week"), "then")).alias("to"))
        open_ = taken.where("depot_id IS NULL").select("component_id", F.col("cost").alias("open"))
        asks = slots.join(open_, "component_id").join(room, ["depot_id", "week"]).withColumn("n", F.row_number().over(Window.partitionBy("depot_id", "week").orderBy(F.col("open").desc(), "component_id"))).where(F.col("n") <= ASKERS)
        found = asks.join(moves, (F.col("depot_id") == F.col("from_depot")) & (F.col("week") == F.col("from_week"))).where(F.col("room") + F.col("leaves_h") >= F.col("hours"))
        total = F.col("cost") - F.col("open") + F.col("to.extra")
        exchange = F.struct(total.alias("total"), "leaves", "from_depot", "from_week", "to.to_depot", "to.to_week", "to.then", "cost", "hours", "leaves_h")
        each = checkpoint(found.where(total < -1e-9).groupBy("component_id").agg(F.min(exchange).alias("x")).select("component_id", "x.*"), f"exchanges{k}")
        ends = each.select("component_id", "total", F.explode(F.array(F.struct(F.col("from_depot").alias("at_depot"), F.col("from_week").alias("at_week")), F.struct(F.col("to_depot").alias("at_depot"), F.col("to_week").alias("at_week")))).alias("e")).select("component_id", "total", "e.*")
        first = ends.withColumn("n", best_at("at")).where("n = 1").groupBy("component_id").agg(F.count("*").alias("n")).where("n = 2").select("component_id")
        made = checkpoint(each.join(first, "component_id"), f"exchanged{k}")
        if made.isEmpty():
            return taken
        new = made.select("component_id", F.col("from_depot").alias("depot_id"), F.col("from_week").alias("week"), "cost", "hours").unionByName(
            made.select(F.col("leaves").alias("component_id"), F.col("to_depot").alias("depot_id"), F.col("to_week").alias("week"), F.col("then").alias("cost"), F.col("leaves_h").alias("hours"))
        )
        taken = checkpoint(taken.join(new.select("component_id"), "component_id", "left_anti").unionByName(new), f"repaired{k}")
        k += 1


@dataclass(frozen=True)
class Dual:
    """bound: no allocation costs less; prices: depot_id, week, price at which it was found; rounds taken."""

    bound: float
    prices: DataFrame
    rounds: int


def dual_bound(candidates: DataFrame, capacity: DataFrame, upper: float, rounds: int = ROUNDS, checkpoint=materialize, constant_slots: int = CONSTANT_SLOTS) -> Dual:
    """The best bound of some subgradient rounds; ``upper``, the cost of a known allocation, scales the steps and ends them when it is met."""
    spark = candidates.sparkSession
    slots = sorted((r.depot_id, r.week, r.hours) for r in capacity.groupBy("depot_id", "week").agg(F.sum("hours").alias("hours")).collect())
    room, number = np.array([s[2] for s in slots], float), {s[:2]: j for j, s in enumerate(slots)}

    def table(prices: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(d, w, j, float(prices[j])) for (d, w), j in number.items()], "depot_id long, week int, j int, price double")

    options = candidates.where("depot_id IS NOT NULL").join(table(np.zeros(len(slots))).drop("price"), ["depot_id", "week"])
    options = options.groupBy("component_id").agg(F.collect_list(F.struct("cost", "j")).alias("options"))
    cases = candidates.where("depot_id IS NULL").select("component_id", "hours", F.col("cost").alias("open")).join(options, "component_id", "left")
    cases = checkpoint(cases.withColumn("options", F.coalesce("options", F.array().cast("array<struct<cost:double,j:int>>"))), "options")

    def loads(prices: np.ndarray) -> list:
        """(j, hours, cost at prices) of what cases take; j is -1 for open ones."""
        none = F.struct(F.col("open").alias("r"), F.lit(-1).alias("j"))
        if len(slots) <= constant_slots:
            known = F.lit([float(p) for p in prices]) if len(prices) else F.array().cast("array<double>")
            priced: Column = F.transform("options", lambda o: F.struct((o["cost"] + F.col("hours") * F.get(known, o["j"])).alias("r"), o["j"].alias("j")))
            picks = cases.select("hours", F.array_min(F.concat(F.array(none), priced)).alias("p"))
        else:
            each = cases.select("component_id", "hours", F.inline("options")).join(table(prices).select("j", "price"), "j")
            each = each.select("component_id", "hours", F.struct((F.col("cost") + F.col("hours") * F.col("price")).alias("r"), "j").alias("p"))
            each = each.unionByName(cases.select("component_id", "hours", none.alias("p")))
            picks = each.groupBy("component_id").agg(F.min("p").alias("p"), F.min("hours").alias("hours"))
        return picks.groupBy("p.j").agg(F.sum("hours").alias("hours"), F.sum("p.r").alias("cost")).collect()

    prices = best_prices = np.zeros(len(slots))
    best, step, idle, k = -np.inf, 1.0, 0, 0
    for k in range(1, rounds + 1):
        taken = loads(prices)
        over = -room.copy()
        for r in taken:
            if r.j >= 0:
                over[r.j] += r.hours
        found = sum(r.cost for r in taken) - float(prices @ room)
        if not np.isfinite(best) or found > best + 1e-9 * max(1.0, abs(best)):
            best, best_prices, idle = found, prices, 0
        else:
            idle += 1
        if idle >= PATIENCE:
            step, idle, prices = step / 2, 0, best_prices
            continue
        move = np.where((prices <= 0) & (over < 0), 0.0, over)
        size = float(move @ move)
        if size == 0 or upper - best <= GOOD_GAP * max(abs(upper), 1e-9):
            break
        prices = np.maximum(prices + step * max(upper - found, 0.0) / size * move, 0.0)
    return Dual(best if np.isfinite(best) else 0.0, table(best_prices).drop("j"), k)


def solver_label(gap: Column) -> Column:
    """proven_optimal, optimal_within_tolerance, feasible_within_limit, or rejected beyond the accepted gap."""
    return F.when(gap <= 1e-9, "proven_optimal").when(gap <= TOLERANCE, "optimal_within_tolerance").when(gap <= ACCEPTED, "feasible_within_limit").otherwise("rejected")


def bounded_allocation(candidates: DataFrame, capacity: DataFrame, rounds: int = ROUNDS, checkpoint=materialize) -> tuple[DataFrame, DataFrame]:
    """(allocation, quality): every case once, within the hours of each depot-week, at a cost with a proven gap.

    allocation: component_id, depot_id, week (null if open), cost, hours, status.
    quality, one row: cost, bound, gap, label, rounds, cases, allocated.
    """
    candidates = checkpoint(candidates, "candidates")
    named = lambda tag: lambda df, name: checkpoint(df, f"{tag}-{name}")
    plain = checkpoint(repair(allocate(candidates, capacity, named("plain")), candidates, capacity, named("plain")), "plain")
    cost = plain.agg(F.sum("cost")).first()[0] or 0.0
    dual = dual_bound(candidates, capacity, cost, rounds, checkpoint)
    if cost - dual.bound > GOOD_GAP * max(abs(cost), 1e-9):
        priced = checkpoint(repair(allocate(candidates, capacity, named("priced"), dual.prices), candidates, capacity, named("priced")), "priced")
        other = priced.agg(F.sum("cost")).first()[0] or 0.0
        if other < cost:
            plain, cost = priced, other
    out = plain.withColumn("status", F.when(F.col("depot_id").isNull(), "unallocated").otherwise("allocated"))
    gap = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("cost") - F.col("bound"), F.col("cost")), F.lit(0.0)))
    quality = out.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("*").alias("cases"), F.count("depot_id").alias("allocated"))
    quality = quality.withColumns({"bound": F.lit(float(dual.bound)), "rounds": F.lit(dual.rounds)}).withColumn("gap", gap)
    return out, quality.withColumn("label", solver_label(F.col("gap"))).select("cost", "bound", "gap", "label", "rounds", "cases", "allocated")


def require_accepted(quality: DataFrame) -> None:
    """Raises where the gap is beyond what is accepted."""
    row = quality.first()
    if row.label == "rejected":
        raise ValueError(f"no allocation within {ACCEPTED:.0%} of the bound: cost {row.cost:.6g}, bound {row.bound:.6g}")


def utilisation(allocation: DataFrame, capacity: DataFrame) -> DataFrame:
    """(depot_id, week, hours, used_h, utilisation) of each depot-week; null where it has no hours."""
    used = allocation.where("depot_id IS NOT NULL").groupBy("depot_id", "week").agg(F.sum("hours").alias("used_h"))
    out = capacity.select("depot_id", "week", "hours").join(used, ["depot_id", "week"], "left").withColumn("used_h", F.coalesce("used_h", F.lit(0.0)))
    return out.withColumn("utilisation", F.try_divide("used_h", "hours"))
