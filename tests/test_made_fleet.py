"""The made fleet: its recursion against a plain loop, the same rows however it is cut, whole references, and marts that run on it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from upkeep.plans import catalogue
from upkeep.sources import made_fleet as m


@pytest.fixture(scope="module")
def made(spark):
    return m.MadeFleet(spark, units=24, days=730, seed=7)


@pytest.fixture(scope="module")
def supplied(spark, made, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("made"))
    made.write(folder)
    return m.CanonicalFleet(spark, folder)


def plain_days(seed, c, stress):
    """One component, one day after the other."""
    draw = lambda stream, k: float(m.mixed(seed, stream, np.array([c.component_id]), k)[0])
    wear, out = c.start, []
    for k, s in enumerate(stress):
        wear += c.rate * s
        if draw(0, k) < m.SHOCK * (1 + c.repeats):
            wear -= m.SHOCK_MEAN * math.log1p(-draw(1, k))
        wear = min(wear, m.TOP)
        failed = draw(2, k) < m.HAZARD + m.WORN_HAZARD * wear**4 * (1 + c.repeats)
        if failed:
            done = m.CORRECTIVE
        elif c.by_condition and wear > m.NOTICED and draw(3, k) < m.NOTICE:
            done = m.CONDITION
        elif c.by_calendar and (k + c.phase) % c.every == 0:
            done = m.PLANNED
        else:
            done = 0
        out.append((k, round(wear, 9), int(failed), done))
        wear *= {0: 1.0, m.CORRECTIVE: 0.25, m.CONDITION: 0.4, m.PLANNED: 0.55}[done]
    return out


def test_wear_is_the_recursion(spark):
    schema = "component_id long, start double, rate double, repeats int, phase int, every int, by_condition boolean, by_calendar boolean, stress array<double>"
    days = 400
    stress = [1 + 0.3 * math.sin(k / 9) for k in range(days)]
    rows = [(7, 0.9, 0.002, 1, 3, 90, True, True, stress), (8, 0.05, 0.001, 0, 200, 110, False, True, stress), (9, 1.1, 0.004, 0, 1, 300, True, False, stress), (2**40, 1.41, 0.03, 1, 5, 50, True, True, stress)]
    df = spark.createDataFrame(rows, schema)
    found = {}
    for r in df.mapInPandas(m.wear_over_days(7, days), m.STATE).orderBy("component_id", "k").collect():
        found.setdefault(r.component_id, []).append((r.k, round(r.wear, 9), r.failed, r.restored))
    assert found == {c.component_id: plain_days(7, c, stress) for c in df.collect()}
    kinds = {d for days_ in found.values() for *_, d in days_}
    assert kinds == {0, m.CORRECTIVE, m.CONDITION, m.PLANNED} and max(w for x in found.values() for _, w, *_ in x) == m.TOP
    assert df.limit(0).mapInPandas(m.wear_over_days(7, days), m.STATE).count() == 0


def digest(df):
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()


def test_same_rows_however_it_is_cut(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        few = {n: digest(df) for n, df in m.MadeFleet(spark, units=6, days=200, seed=7).tables().items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert few == {n: digest(df) for n, df in m.MadeFleet(spark, units=6, days=200, seed=7).tables().items()} and all(d.n for d in few.values())
    assert few["readings"] != digest(m.MadeFleet(spark, units=6, days=200, seed=8).readings)


def test_plausible_and_whole(spark, made, supplied, tmp_path):
    report = {r.check: r for r in m.fleet_report(supplied).collect()}
    assert set(report) == set(m.BOUNDS) and {r.check: r.value for r in report.values() if r.status != "plausible"} == {}
    assert len(m.TABLES) == 15 and supplied.components.count() == 24 * 8 and supplied.service.count() == 24 * 730
    made.write(str(tmp_path))
    lost = m.CanonicalFleet(spark, str(tmp_path))
    supplied.units.where("unit_id <> 5").write.mode("overwrite").parquet(f"{tmp_path}/units.parquet")
    with pytest.raises(ValueError, match="orphans"):
        m.require_plausible(lost)


def test_restorations_lower_wear(made):
    """The day after a restoration starts from the share that it keeps, and only adds to it."""
    days = made.state.alias("a").join(made.state.alias("b"), (F.col("a.component_id") == F.col("b.component_id")) & (F.col("a.k") + 1 == F.col("b.k")))
    kept = F.element_at(F.array(*map(F.lit, m.KEPT)), F.col("a.restored") + 1) * F.col("a.wear")
    assert days.where(F.col("b.wear") < kept).count() == 0 and days.where((F.col("a.restored") > 0) & (F.col("b.wear") >= F.col("a.wear"))).count() < days.where("a.restored > 0").count() * 0.02


def test_marts_run_on_it(supplied):
    mart = catalogue._stored_mart(supplied)
    assert mart.count() == 24 * 8 * 730 and mart.where("health IS NULL OR NOT health BETWEEN 0 AND 100").count() == 0
    scored = catalogue._scored(supplied)
    assert scored.count() == 24 * 8 and scored.select("component_id").distinct().count() == 24 * 8
    worn = mart.groupBy((F.col("wear") > 90).alias("w")).agg(F.avg("failures").alias("f")).collect()
    by = {r.w: r.f for r in worn}
    assert by[True] > 3 * by[False]
