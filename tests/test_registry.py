"""Contracts with planted breaks, lineage against plans, and exports that are built once."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from upkeep import runner
from upkeep.operators import contracts
from upkeep.plans import catalogue, registry
from upkeep.sources import lineage, store, warehouse
from upkeep.sources.fleet import MARTS, Fleet


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf_dir, name):
    mine, theirs = compare(spark, connect(sf_dir), registry.QUERIES[name], registry.SQL[name], sf_dir)
    assert mine == theirs


ONE = contracts.DataContract("t", "raw", "row", ("k", "day"), ("k", "day", "v"), "daily", "o", "c", "r")
METRIC = contracts.MetricContract("m", "m", "d", "f", "g", "u", "o", "c", "a", "c", "t", "v", "high", 0, 10)


def failed(spark, tables):
    rows = contracts.contract_checks(spark, [ONE], [METRIC], tables).where("NOT passed").collect()
    return {r.check_id: (r.severity, r.detail, r.blocker) for r in rows}


def test_planted_breaks(spark):
    good = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, None)], "k int, day int, v double")
    assert failed(spark, {"t": good}) == {}
    contracts.require_publishable(contracts.contract_checks(spark, [ONE], [METRIC], {"t": good}))
    assert failed(spark, {}) == {"data_contract_table_exists::t": ("critical", "table=t", True), "metric_contract_source_exists::m": ("high", "source=t.v", True)}
    assert failed(spark, {"t": good.drop("v")}) == {"data_contract_required_columns::t": ("high", "missing=v", True), "metric_contract_source_exists::m": ("high", "source=t.v", True)}
    assert failed(spark, {"t": good.drop("day")}) == {"data_contract_required_columns::t": ("high", "missing=day", True), "data_contract_key::t": ("high", "key lacks=day", True)}
    twice = good.union(good.where("k = 1")).union(spark.createDataFrame([(None, 5, 1.0)], good.schema))
    assert failed(spark, {"t": twice}) == {"data_contract_key::t": ("high", "key=k,day duplicates=2 nulls=1", True)}
    assert failed(spark, {"t": good.withColumn("v", F.col("v") * 5)}) == {"metric_contract_range::m": ("medium", "outside=1", False)}
    assert failed(spark, {"t": good.limit(0)}) == {}


def test_gate(spark):
    bad = contracts.contract_checks(spark, [ONE], [METRIC], {})
    gate = contracts.publication_gate(bad).first()
    assert (gate.checks, gate.failed, gate.blockers, gate.allowed) == (2, 2, 2, False)
    with pytest.raises(ValueError, match="2 contract blockers.*table_exists::t"):
        contracts.require_publishable(bad)
    assert not contracts.publication_gate(bad.limit(0)).first().allowed
    with pytest.raises(ValueError, match="no contract"):
        contracts.require_publishable(bad.limit(0))


def test_registries(spark):
    assert contracts.registry(spark, registry.DATA).count() == 13 and contracts.registry(spark, registry.METRICS).count() == 11
    assert {m.metric for m in registry.METRICS} == set(registry.LINEAGE)


def test_reads_follow_pruning_and_written_tables(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    spark.createDataFrame([(1, 2, 3)], "k int, x int, unused int").write.parquet(a)
    spark.createDataFrame([(1, 5)], "k int, y int").write.parquet(b)
    left, right = spark.read.parquet(a), spark.read.parquet(b)
    with lineage.recording() as seen:
        mid = store.materialize(left.join(right, "k").withColumn("z", F.col("x") + 1), "mid")
        last = store.materialize(mid.where("y > 1").select("z"), "last")
        found = lineage.closure(lineage.reads(last), seen)
    assert found == {(a, "k"), (a, "x"), (a, "unused"), (b, "k"), (b, "y")}
    assert lineage.reads(left.join(right, "k").select("x")) == {(a, "k"), (a, "x"), (b, "k")}
    assert lineage.closure(lineage.reads(last), {}) != found and store.materialize(left, "quiet") is not None and len(seen) == 2


def test_undeclared_and_unread_columns_show(spark):
    rows = contracts.lineage_report(spark, {"m": {("t", "a"), ("t", "b")}}, {"m": {("t", "b"), ("t", "c")}, "n": {("t", "a")}}).collect()
    assert {(r.metric, r.column): r.status for r in rows} == {("m", "a"): "unread", ("m", "b"): "read", ("m", "c"): "undeclared", ("n", "a"): "undeclared"}


@pytest.fixture
def inputs(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(f"{tmp_path}/in/t.parquet")
    return f"{tmp_path}/in"


def test_tables_are_built_once(spark, inputs, tmp_path):
    calls = []

    def run(code="1"):
        w = warehouse.Warehouse.over(spark, f"{tmp_path}/out", warehouse.input_manifest(spark, inputs, ["t"]), code)
        base = lambda: w.table("base", lambda: calls.append("base") or spark.read.parquet(f"{inputs}/t.parquet"))
        one = lambda: calls.append("one") or base().where("v > 4")
        two = lambda: calls.append("two") or base().groupBy().agg(F.sum("v").alias("total"))
        return w, {r.object: r for r in w.export({"one": one, "two": two}).collect()}

    w, first = run()
    assert calls == ["one", "base", "two"] and {r.status for r in first.values()} == {"built"}
    assert (first["one"].n_rows, first["one"].n_columns, first["two"].n_rows, first["one"].needs) == (7, 2, 1, "base") and first["one"].bytes > 0 and len(first["one"].digest) == 64
    noted = json.loads(warehouse.read_text(spark, f"{tmp_path}/out/manifest-{w.run_id}.json"))
    assert [(x["object"], x["n_rows"], x["status"]) for x in noted] == [("one", 7, "built"), ("two", 1, "built")]
    again, second = run()
    assert calls == ["one", "base", "two"] and {r.status for r in second.values()} == {"reused"} and again.run_id == w.run_id
    assert {n: (r.digest, r.n_rows, r.needs) for n, r in second.items()} == {n: (r.digest, r.n_rows, r.needs) for n, r in first.items()}
    assert run("2")[0].run_id != w.run_id and len(calls) == 6
    same = spark.read.parquet(f"{inputs}/t.parquet").orderBy(F.col("id").desc()).repartition(3)
    same.write.parquet(f"{tmp_path}/moved/t.parquet")
    key = lambda folder: warehouse.input_manifest(spark, folder, ["t"]).first()
    assert key(f"{tmp_path}/moved").digest == key(inputs).digest and (key(inputs).n_rows, key(inputs).n_columns) == (10, 2)
    spark.range(1).withColumn("v", F.lit(7).cast("long")).write.mode("append").parquet(f"{inputs}/t.parquet")
    assert run()[0].run_id != w.run_id and len(calls) == 9


def test_a_failed_run_goes_on_where_it_stopped(spark, inputs, tmp_path):
    def run(broken):
        w = warehouse.Warehouse(spark, f"{tmp_path}/out", "x", "1")
        bad = lambda: w.table("late", lambda: spark.range(3).select(F.when(F.lit(broken) & (F.col("id") == 2), F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id")))
        return w.export({"first": lambda: spark.range(2), "second": bad}, "parquet")

    with pytest.raises(Exception, match="no"):
        run(True)
    got = {r.object: r.status for r in run(False).collect()}
    assert got == {"first": "reused", "second": "built"}
    found = warehouse.Warehouse(spark, f"{tmp_path}/out", "x", "1").table("late", lambda: 1 / 0)
    assert found.count() == 3


def test_export_of_the_fleet(spark, sf_dir, tmp_path, capsys):
    folder = str(tmp_path / "out")
    assert runner.main(["export", sf_dir, "--out", folder]) == 0
    assert all(x["status"] == "passed" for x in json.loads(capsys.readouterr().out))
    manifest = registry.export_run(spark, sf_dir, folder).collect()
    assert [r.object for r in manifest] == [*registry.OBJECTS] and len(manifest) == 29
    assert {r.status for r in manifest} == {"reused"} and len({r.run_id for r in manifest}) == 1
    row = next(r for r in manifest if r.object == "mart_component_day")
    w = warehouse.Warehouse.over(spark, folder, warehouse.input_manifest(spark, sf_dir, registry.ALL_INPUTS))
    assert spark.read.option("header", True).csv(w.path("export_mart_component_day", "csv")).count() == row.n_rows == Fleet(spark, sf_dir, w).stored("component_day", lambda: 1 / 0).count()
    shutil.rmtree(folder)


def test_marts_are_kept_between_queries(spark, sf_dir, tmp_path):
    """With the session's setting, queries find each other's marts and give the same rows."""
    names = ["kpi_top_depots", "mart_fleet_week", "component_scores"]
    plain = {n: sorted(map(repr, catalogue.QUERIES[n](spark, sf_dir).collect())) for n in names}
    spark.conf.set(MARTS, str(tmp_path / "marts"))
    try:
        first = {n: sorted(map(repr, catalogue.QUERIES[n](spark, sf_dir).collect())) for n in names}
        notes = {p.name for p in (tmp_path / "marts").glob("*.json")}
        again = {n: sorted(map(repr, catalogue.QUERIES[n](spark, sf_dir).collect())) for n in names}
        assert first == plain == again
        assert {p.name for p in (tmp_path / "marts").glob("*.json")} == notes and {n.rsplit("-", 1)[0] for n in notes} >= {"component_day", "unit_day", "depot_day", "fleet_week", "features", "scores"}
        assert Fleet.over(spark, sf_dir).warehouse.state != Fleet.over(spark, str(tmp_path)).warehouse.state
    finally:
        spark.conf.unset(MARTS)
    assert Fleet.over(spark, sf_dir).warehouse is None
