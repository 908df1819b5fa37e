"""Snapshots: a failure leaves the current one, a switch shows all of the new one, a reset keeps what isn't the area's."""

import pytest
from pyspark.sql import functions as F

from upkeep import runner
from upkeep.plans import registry
from upkeep.sources.snapshots import Snapshots


def read(spark, area, name="t"):
    return sorted(r.id for r in spark.read.parquet(f"{area.current()}/{name}.parquet").collect())


def test_failures_leave_the_old_snapshot(spark, tmp_path):
    area = Snapshots(spark, f"{tmp_path}/area")
    assert area.current() is None and area.reset() == []
    with pytest.raises(FileNotFoundError):
        area.manifest()
    first = area.publish({"t": spark.range(3), "u": spark.range(1)})
    assert area.current() == first and read(spark, area) == [0, 1, 2]
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("midway"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="midway"):
        area.publish({"t": spark.range(9), "u": broken})
    with pytest.raises(ValueError, match="refused: t: no rows"):
        area.publish({"t": spark.range(0)}, lambda folder: ["t: no rows"] if not spark.read.parquet(f"{folder}/t.parquet").count() else [])
    assert area.current() == first and read(spark, area) == [0, 1, 2]
    assert sorted(p.name for p in (tmp_path / "area").iterdir() if not p.name.startswith(".")) == sorted(["CURRENT", first.rsplit("/", 1)[1]])
    second = area.publish({"t": spark.range(5)})
    assert area.current() == second != first and read(spark, area) == [0, 1, 2, 3, 4]
    assert [(r.table, r.n_rows, r.n_columns) for r in area.manifest().collect()] == [("t", 5, 1)]
    assert read(spark, type("Old", (), {"current": lambda self: first})()) == [0, 1, 2]  # who read the old one may go on


def test_a_crash_before_the_switch(spark, tmp_path, monkeypatch):
    area = Snapshots(spark, f"{tmp_path}/area")
    first = area.publish({"t": spark.range(2)})
    monkeypatch.setattr(Snapshots, "_point", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        area.publish({"t": spark.range(7)})
    assert area.current() == first and read(spark, area) == [0, 1]
    assert len(area.reset()) == 1 and read(spark, area) == [0, 1]


def test_reset_keeps_what_is_not_its_own(spark, tmp_path):
    area = Snapshots(spark, f"{tmp_path}/area")
    old, now = area.publish({"t": spark.range(1)}), area.publish({"t": spark.range(2)})
    (tmp_path / "area/notes.txt").write_text("mine")
    (tmp_path / "area/version-x").mkdir()
    assert area.reset() == [old.rsplit("/", 1)[1]] and area.current() == now
    assert set(area.reset(everything=True)) == {"CURRENT", now.rsplit("/", 1)[1]} and area.current() is None
    assert {p.name for p in (tmp_path / "area").iterdir() if not p.name.startswith(".")} == {"notes.txt", "version-x"}


def test_publish_of_the_tables(spark, sf_dir, tmp_path):
    assert runner.main(["publish", sf_dir, "--out", f"{tmp_path}/area"]) == 0
    area = Snapshots(spark, f"{tmp_path}/area")
    got = {r["table"]: r.n_rows for r in area.manifest().collect()}
    assert got == {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in registry.ALL_INPUTS}
    assert runner.main(["publish", f"{tmp_path}/none", "--out", f"{tmp_path}/area"]) == 1 and area.current() is not None
