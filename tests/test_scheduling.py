"""Schedules against a plain serial queue."""

import random

import pytest
from pyspark.sql import functions as F

from upkeep.operators import scheduling, workshop
from upkeep.plans import catalogue, planning
from upkeep.sources.fleet import Fleet

KIND = "rank long, unit long, family string, hours double, flexible boolean, tries array<long>, near int, far int"


def serial(cases, days, rule):
    """{rank: (depot, day, slot)} and the hours left, one case after the other; days: (depot, offset) to [regular, flex]."""
    left, units, families, got = {k: list(v) for k, v in days.items()}, {}, {}, {}
    for c in sorted(cases, key=lambda c: c["rank"]):
        slots = [(d, k, False) for d in c["tries"] for k in range(1, c["near"] + 1)] + [(d, k, True) for d in c["tries"] for k in range(c["near"] + 1, c["far"] + 1)]
        for d, k, late in slots:
            if (d, k) not in left:
                continue
            setup = rule.again if c["unit"] is not None and c["unit"] in units.get((d, k), ()) else rule.setup
            bonus = -rule.bonus if c["family"] is not None and c["family"] in families.get((d, k), ()) else 0.0
            need, room = max(rule.least, c["hours"] + setup + bonus), left[d, k]
            slot = "regular" if room[0] >= need else "flex" if late and c["flexible"] and room[0] + room[1] >= need else None
            if slot:
                left[d, k] = [room[0] - need, room[1]] if slot == "regular" else [0.0, room[1] - (need - room[0])]
                units.setdefault((d, k), set()).add(c["unit"])
                families.setdefault((d, k), set()).add(c["family"])
                got[c["rank"]] = (d, k, slot)
                break
    return got, left


def check(spark, cases, days, rule):
    calendar = spark.createDataFrame([(d, k, r, f) for (d, k), (r, f) in days.items()], "depot_id long, offset int, regular_h double, flex_h double")
    booked, ledger = scheduling.serial_bookings(spark.createDataFrame([tuple(c.values()) for c in cases], KIND), calendar, rule)
    want, left = serial(cases, days, rule)
    assert {r["rank"]: (r.depot_id, r.day, r.slot) for r in booked.collect()} == want
    assert {(r.depot_id, r.offset): [r.regular_left, r.flex_left] for r in ledger.collect()} == left
    return want


def made(n, depots, seed, hot):
    """Cases of which a share ``hot`` asks for depot 1 first, few hours' difference, units and families that come again."""
    rng = random.Random(seed)
    rows = []
    for rank in range(1, n + 1):
        tries = rng.sample(range(1, depots + 1), min(3, depots))
        if rng.random() < hot:
            tries = [1, *(d for d in tries if d != 1)][:3]
        near = rng.choice([1, 2, 3, 7])
        rows.append(dict(zip(KIND.replace(" array<long>", "").split(", "), (rank, rng.choice([None, *range(12)]), rng.choice([None, "wheel", "brake"]), round(rng.uniform(1.0, 6.0), 2), rng.random() < 0.5, tries, near, min(8, near + 4)), strict=True)))
    return [dict(zip(("rank", "unit", "family", "hours", "flexible", "tries", "near", "far"), r.values(), strict=True)) for r in rows]


@pytest.mark.parametrize(("n", "depots", "hot"), [(150, 5, 0.4), (90, 1, 1.0), (1, 2, 0.0)])
@pytest.mark.parametrize("rule", [scheduling.Booking(), scheduling.PLAIN])
def test_bookings_of_the_serial_queue(spark, n, depots, hot, rule):
    days = {(d, k): (8.0 + d, 1.5) for d in range(1, depots + 1) for k in range(1, 9)}
    got = check(spark, made(n, depots, n, hot), days, rule)
    assert len(got) == n or n > 80


def test_preferred_days_of_all_depots_come_before_later_days(spark):
    """Depot 1 is full on the preferred days and free on the third, depot 2 is empty: depot 2, day 1."""
    case = {"rank": 1, "unit": 1, "family": "wheel", "hours": 4.0, "flexible": True, "tries": [1, 2], "near": 2, "far": 8}
    days = {(1, 1): (1.0, 0.0), (1, 2): (1.0, 0.0), (1, 3): (20.0, 0.0), (2, 1): (20.0, 0.0)}
    assert check(spark, [case], days, scheduling.Booking()) == {1: (2, 1, "regular")}


def test_no_cases_no_depots(spark):
    days = {(1, 1): (8.0, 1.0)}
    assert check(spark, [], days, scheduling.Booking()) == {}
    lost = {"rank": 1, "unit": 1, "family": None, "hours": 2.0, "flexible": False, "tries": [9], "near": 1, "far": 3}
    assert check(spark, [lost, {**lost, "rank": 2, "tries": []}], days, scheduling.Booking()) == {}


@pytest.fixture(scope="module")
def fleet(spark, sf_dir):
    return Fleet(spark, sf_dir)


def as_days(calendar):
    return {(r.depot_id, r.offset): (r.regular_h, r.flex_h) for r in calendar.collect()}


def test_redesigned_plan_of_the_fleet(fleet):
    queue = sorted(catalogue.cases(fleet).collect(), key=lambda r: (r.bucket, -r.queue_score, r.entry))
    cases = []
    for k, r in enumerate(queue):
        depots = list(dict.fromkeys([r.depot, *(int(d) for d in r.candidates.split("|")), r.home]))[: workshop.CANDIDATES]
        near = max(1, r.window_days)
        cases.append({"rank": k, "unit": r.unit_id, "family": r.family, "hours": r.hours, "flexible": r.bucket in ("P1", "P2"), "tries": depots, "near": min(near, 35), "far": min(35, near + workshop.CARRY_DAYS[r.bucket])})
    want, left = serial(cases, as_days(catalogue.calendar(fleet)), scheduling.Booking())
    plan, ledger = planning.redesigned(fleet)
    got = {r.component_id: r for r in plan.collect()}
    assert len(got) == len(queue)
    for k, r in enumerate(queue):
        own = got[r.component_id]
        if k in want:
            assert (own.depot_id, own.day, own.slot) == want[k]
            assert own.status == ("booked" if own.day <= cases[k]["near"] else "next_window")
            assert own.moved == int(own.depot_id != r.depot) and own.days_late == max(0, own.day - cases[k]["near"])
        else:
            assert own.day is None and own.slot == "none" and own.status.startswith(("waits", "escalate"))
    assert {(r.depot_id, r.offset): [r.regular_left, r.flex_left] for r in ledger.collect()} == left


def test_legacy_plan_of_the_fleet(fleet):
    queue = catalogue.cases(fleet).collect()
    cases = [{"rank": r.entry, "unit": r.unit_id, "family": r.family, "hours": r.hours, "flexible": False, "tries": [r.depot], "near": min(21, max(1, r.window_days)), "far": min(21, max(1, r.window_days))} for r in queue]
    days = {(r.depot_id, k): (r.capacity * 0.78, 0.0) for r in fleet.depots.collect() for k in range(1, 22)}
    want, left = serial(cases, days, scheduling.PLAIN)
    plan, ledger = planning.legacy(fleet)
    assert {r.component_id: (r.depot_id, r.day, r.slot) for r in plan.where("day IS NOT NULL").collect()} == {r.component_id: want[r.entry] for r in queue if r.entry in want}
    assert {(r.depot_id, r.offset): [r.regular_left, r.flex_left] for r in ledger.collect()} == left


def test_metrics_of_a_plan(spark):
    rows = [(1, "booked", 50.0, 50.0, 100.0), (2, "next_window", 0.0, 0.0, 100.0), (3, "waits_capacity", 100.0, 50.0, 200.0), (4, "escalate", 0.0, 0.0, 100.0)]
    plan = spark.createDataFrame(rows, "depot_id long, status string, deferral double, service double, delay_cost double").withColumn("hours", F.lit(2.0))
    ledger = spark.createDataFrame([(10.0, 5.0), (10.0, 0.0)], "capacity_h double, used_h double")
    m = scheduling.schedule_metrics(plan, ledger).first()
    assert (m.cases, m.booked_pct, m.next_window_pct, m.pending_pct, m.actionable_pct, m.utilisation_pct, m.used_h) == (4, 25.0, 25.0, 50.0, 50.0, 25.0, 5.0)
    assert (m.captured, m.not_captured) == pytest.approx((100 + 65 + 32 + 12, 500 - 209)) and m.residual_risk_pct == pytest.approx(80 / 130 * 100)
    changed = {r.metric: r for r in scheduling.before_after(scheduling.schedule_metrics(plan.where("depot_id < 3"), ledger), scheduling.schedule_metrics(plan, ledger)).collect()}
    assert [*changed] and set(changed) == set(scheduling.METRICS)
    assert (changed["cases"].before, changed["cases"].after, changed["cases"].delta) == (2.0, 4.0, 2.0)
    worst = scheduling.bottlenecks(plan).first()
    assert (worst.depot_id, worst.cases, worst.waiting, worst.pending_pct) == (3, 1, 1, 100.0)
    assert scheduling.status_shares({"a": plan}).where("status = 'booked'").first().share_pct == 25.0
