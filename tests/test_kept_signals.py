"""Signals are written once for marts that read them many times; cases meet depots by kind; doubles are written plainly."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from upkeep.operators import marts, workshop
from upkeep.sources import lineage, store
from upkeep.sources.fleet import Fleet


def test_kept_signals_give_the_same_tables_from_one_copy(spark, sf_dir):
    f = Fleet(spark, sf_dir)
    assert f.kept is f.kept and f.kept.kept is f.kept and f.kept.members is f.members
    for name in ("readings", "inspections", "failures", "alerts", "maintenance", "backlog", "service", "units", "components", "context", "calendar"):
        plain, kept = getattr(f, name), getattr(f.kept, name)
        assert sorted(map(str, plain.collect())) == sorted(map(str, kept.collect())) and plain.columns == kept.columns, name
    paths = {p for p, _ in lineage.reads(marts.mart_component_day(f.kept))}
    assert any(Path(p).name.startswith("signals-") for p in paths) and not any(p.endswith("events.parquet") for p in paths)


def test_members_are_all_components_seen(spark, sf_dir):
    f = Fleet(spark, sf_dir)
    assert sorted(map(str, f.read_members.collect())) == sorted(map(str, f.readings.select("component_id", "unit_id").distinct().collect()))
    assert sorted(map(str, f.members.drop("reads").collect())) == sorted(map(str, f.signals.select("component_id", "unit_id").distinct().collect()))


def test_depots_are_ranked_by_kind(spark):
    cases = spark.createDataFrame([(1, "brake_disc"), (2, None), (3, "gate"), (4, "brake_disc")], "component_id long, kind string")
    shops = [(1, "x brake_disc", 95.0, 0.5), (2, "gate", 200.0, None), (3, None, 40.0, 2.0), (4, "brake_disc", 95.0, 0.5), (5, "x", 10.0, 0.1)]
    df = workshop.rank_depots(cases, spark.createDataFrame(shops, "depot_id long, speciality string, capacity double, saturation double"))

    def fit(kind, shop):
        _, speciality, capacity, saturation = shop
        match = 1.0 if kind is not None and speciality is not None and kind in speciality else 0.42
        use = min(1.7, max(0.0, 0.90 if saturation is None else saturation))
        return round(100 * (match * 0.62 + (1 - use / 1.9) * 0.24 + min(capacity / 95, 1.0) * 0.14), 6)

    want = {}
    for c, kind in ((1, "brake_disc"), (2, None), (3, "gate"), (4, "brake_disc")):
        best = sorted((-fit(kind, s), s[0]) for s in shops)[:4]
        want[c] = (best[0][1], -best[0][0], "|".join(str(d) for _, d in best))
    assert {r.component_id: (r.depot, r.fit, r.candidates) for r in df.collect()} == want
    assert "hashpartitioning(component_id" not in df._jdf.queryExecution().executedPlan().toString()


def test_doubles_are_written_without_dictionaries(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("s")).coalesce(1)
    for table in (store.materialize(df, "plain"), store.materialize(df, "plain", "id", ["x"])):
        group = pq.ParquetFile(table.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
        coded = {group.column(i).path_in_schema: any("DICTIONARY" in e for e in group.column(i).encodings) for i in range(group.num_columns)}
        assert not coded["x"] and coded["s"] and sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
