"""Tables in sorted buckets: what they hold, how they are read again, and that features of the mart exchange nothing by component."""

import random
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from upkeep.operators import features
from upkeep.plans import catalogue
from upkeep.sources import store
from upkeep.sources.fleet import MARTS, Fleet


@pytest.fixture
def shuffled_joins(spark):
    """No join by broadcast, as at scale."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges_above(df, table: str) -> list[str]:
    """The exchanges of the plan that move rows of a table, those of aggregates and of one row apart."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for i, line in enumerate(lines):
        if table not in line:
            continue
        least, above = depth(line), []
        for upper in reversed(lines[:i]):
            if depth(upper) < least:
                least = depth(upper)
                above.append(upper.strip(" :+-"))
        out += [x for x in above if x.startswith("Exchange hashpartitioning(component_id")]
    return out


def test_buckets_are_sorted_and_read_again(spark, tmp_path, shuffled_joins):
    dice = random.Random(3)
    rows = [(dice.choice([1, 1, 1, 2, 3, 50, None]), dice.randrange(100), None if i % 9 == 0 else "x" * (i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v int, t string").withColumn("n", F.count("*").over(Window.partitionBy("k")))
    path = str(tmp_path / "b")
    n = store.save_bucketed(df, path, "k", ["v"])
    spark.sql(f"DROP TABLE {store._table_name(path)}")  # as in a session that never saw it
    again = store.read_bucketed(spark, path, df.schema, "k", ["v"], n)
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect())) and again.columns == df.columns
    assert "Exchange" not in again.groupBy("k").agg(F.max("v"))._jdf.queryExecution().executedPlan().toString()
    files = again.select("k", "v", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    by_file = {}
    for r in sorted(files, key=lambda r: r.i):
        by_file.setdefault(r.f, []).append((r.k is not None, r.k or 0, r.v))
    assert len(by_file) <= n and all(v == sorted(v) for v in by_file.values())
    homes = {}
    for r in files:
        homes.setdefault(r.k, set()).add(r.f)
    assert all(len(f) == 1 for f in homes.values())
    empty = store.materialize(df.limit(0), "empty", "k", ["v"])
    assert empty.count() == 0 and empty.columns == df.columns


@pytest.mark.parametrize("kept", [False, True])
def test_features_exchange_nothing_by_component(spark, sf_dir, tmp_path, shuffled_joins, kept):
    before = spark.conf.get(MARTS, None)
    if kept:
        spark.conf.set(MARTS, str(tmp_path))
    else:
        spark.conf.unset(MARTS)
    try:
        f = Fleet.over(spark, sf_dir)
        mart = catalogue._stored_mart(f)
        table = store._table_name(mart.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
        df = features.component_day_features(f, mart)
        assert table in df._jdf.queryExecution().executedPlan().toString() and exchanges_above(df, table) == []
        assert exchanges_above(mart.repartition(3, "component_id"), table) != []  # the finder finds
        assert df.count() == mart.count()
    finally:
        spark.conf.set(MARTS, before) if before else spark.conf.unset(MARTS)


def test_last_events_and_orders_by_component(spark):
    """days_since and with_backlog against plain loops, with ties, nulls and components without any."""
    dice = random.Random(5)
    days = [f"2024-01-{d:02d}" for d in range(1, 29)]
    base = [(c, c // 2, d) for c in range(6) for d in days if dice.random() < 0.6] + [(None, None, "2024-01-03")]
    events = [(dice.choice([0, 0, 0, 1, 2, 3, None]), dice.choice([*days, "2023-12-01", None])) for _ in range(40)]
    left = spark.createDataFrame(base, "component_id long, unit_id long, d string").withColumn("day", F.to_date("d")).drop("d")
    right = spark.createDataFrame(events, "component_id long, d string").withColumn("day", F.to_date("d")).drop("d")
    found = sorted((str(r.component_id), str(r.day), r.since) for r in features.days_since(left, right, "since").collect())
    want = []
    for c, _, d in base:
        past = [e for k, e in events if k == c and k is not None and e is not None and e <= d]
        want.append((str(c), d, (date.fromisoformat(d) - date.fromisoformat(max(past))).days if past else None))
    assert found == sorted(want, key=lambda x: (x[0], x[1])) and features.days_since(left, right, "since").columns == [*left.columns, "since"]
    orders = [(dice.choice([d for d in days if d.endswith(("01", "08", "15"))]), c // 2, c, dice.randrange(40), dice.choice(["low", "high", None]), dice.random()) for c in (0, 0, 0, 1, 2, 4) for _ in range(3)]
    backlog = spark.createDataFrame(orders, "d string, unit_id long, component_id long, age_days int, severity string, risk double").withColumn("day", F.to_date("d")).drop("d")
    joined = features.with_backlog(left, backlog)
    plain = left.join(features.backlog_component_day(backlog), ["day", "unit_id", "component_id"], "left").select(joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect())) and joined.where("age_days IS NOT NULL").count() > 0

