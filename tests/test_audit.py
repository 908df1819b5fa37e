"""Audits and staging against SQL; sources, sinks, guards and the runner by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from upkeep import runner
from upkeep.operators import governance, panel, rul, validation
from upkeep.plans import audit
from upkeep.sources import files, store, synthetic
from upkeep.sources.fleet import Fleet


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(audit.SQL))
def test_matches_sql(spark, con, sf_dir, name):
    mine, theirs = compare(spark, con, audit.QUERIES[name], audit.SQL[name], sf_dir)
    assert mine == theirs


def test_gates_block(spark):
    zero, bad = (spark.createDataFrame([(0, x)], "a long, b long") for x in (0, None))
    found = {r.gate: r.status for r in validation.gate_report([("fine", True, zero), ("bad", True, bad), ("soft", False, bad)]).collect()}
    assert found == {"fine": "passed", "bad": "blocked", "soft": "warned"}
    with pytest.raises(ValueError, match="bad.b"):
        validation.assert_gates({"bad": bad}, {})
    with pytest.raises(ValueError, match="empty"):
        validation.assert_gates({"fine": zero}, {"none": zero.limit(0)})
    validation.assert_gates({"fine": zero}, {"some": zero}, spark.createDataFrame([(0.0,)], "mae double"))


def test_one_to_one_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, x int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, y int")
    assert validation.one_to_one(a, a.withColumnRenamed("x", "y"), ["k"]).count() == 2
    for left, right in ((a, b), (b, a)):
        with pytest.raises(ValueError, match="more than once"):
            validation.one_to_one(left, right, ["k"])


def test_contracts(spark, sf_dir):
    assert audit.contract_faults(spark, sf_dir) == {}
    c = governance.Contract({"k": "int", "at": "string"}, ["k"], ["at"], {"k": ("p", "id")})
    p = {"p": spark.createDataFrame([(1,)], "id int")}
    df = spark.createDataFrame([(1, "2024-01-01"), (1, "never"), (None, None), (2, None)], "k int, at string")
    assert governance.check_contract(df, c, p) == ["null key k", "bad date at", "repeated key", "orphan k"]
    assert governance.check_contract(df.limit(0), c, p) == ["no rows"]
    assert governance.check_contract(df.drop("at"), c, p) == ["missing column at"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 2.5), (2, None, None)], "k int, t string, v double")
    df.write.option("header", True).csv(str(tmp_path / "x"))
    back = files.read_csv(spark, str(tmp_path / "x"))
    assert dict(back.dtypes) == {"k": "int", "t": "string", "v": "double"} and sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(FileNotFoundError, match="gone"):
        files.require_inputs(spark, str(tmp_path), ["x", "gone"])
    (tmp_path / "one.csv").write_text("a,b\n1,x\n")
    assert files.register_raw(spark, str(tmp_path), ["one"]) == ["raw_one"] and spark.table("raw_one").first().a == 1
    assert files.to_markdown(df, "T") == "# T\n\n| k | t | v |\n|---|---|---|\n| 1 | a\\|b | 2.5 |\n| 2 |  |  |\n"
    with pytest.raises(ValueError):
        files.to_markdown(df, most=1)
    listed = governance.manifest(spark, str(tmp_path), "one.csv").collect()
    assert [(r.file, r.bytes) for r in listed] == [("one.csv", 8)]
    store.save_sorted(df, str(tmp_path / "sorted"), ["k"])
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 2


def test_approvals(spark):
    register = spark.createDataFrame([("D1",), ("D2",)], "decision_id string")
    rows = [("D1", "approved", "r", "2024-01-02"), ("D1", "rejected", "q", "2024-01-03"), ("D2", "maybe", "r", "2024-01-02"), ("D2", "approved", " ", "2024-01-03"), ("D2", "approved", "r", "soon"), ("D9", "approved", "r", "2024-01-02")]
    df = spark.createDataFrame(rows, "decision_id string, approval_status string, reviewer_id string, reviewed_at string")
    assert sorted((r.decision_id, r.fault) for r in governance.approval_faults(df, register).collect()) == [("D2", "reviewer"), ("D2", "status"), ("D2", "time"), ("D9", "unknown")]
    assert {r.decision_id: r.approval_status for r in governance.latest_approvals(df.where("decision_id = 'D1'")).collect()} == {"D1": "rejected"}


def test_payload_is_safe_in_a_script(spark):
    out = panel.payload(spark.createDataFrame([("</script>&",)], "t string")).first().json
    assert "<" not in out and "&" not in out and json.loads(out) == {"t": "</script>&"}


def test_bucket_entropy(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1.0)], "method string, share double")
    assert {r.method: round(r.entropy, 6) for r in rul.bucket_entropy(df).collect()} == {"a": 1.0, "b": 0.0}


def test_made_fleet(spark, tmp_path):
    """The same tables whatever the partitions, and a fleet model that works on them."""
    tables = synthetic.synthetic_fleet(spark, 64, 4000)
    assert tables["events"].agg(F.sum(F.xxhash64(*tables["events"].columns).cast("decimal(38,0)"))).first() == synthetic.synthetic_fleet(spark, 64, 4000)["events"].repartition(7).agg(F.sum(F.xxhash64(*tables["events"].columns).cast("decimal(38,0)"))).first()
    share = {r.event_type: r["count"] / 4000 for r in tables["events"].groupBy("event_type").count().collect()}
    assert set(share) == {"view", "click", "signup", "error", "purchase"} and 0.2 < share["view"] < 0.5
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    checks = {r.check: r for r in audit.QUERIES["plausibility"](spark, str(tmp_path)).collect()}
    assert 0 < checks["availability"].value <= 1 and checks["values_in_range"].value == 1.0
    assert set(checks) == set(audit.PLAUSIBLE) and all((r.status == "plausible") == (r.low <= r.value <= r.high) for r in checks.values())
    tables["events"].withColumn("value", F.col("value") + 2000).write.mode("overwrite").parquet(str(tmp_path / "odd/events.parquet"))
    for name in set(tables) - {"events"}:
        tables[name].write.parquet(str(tmp_path / f"odd/{name}.parquet"))
    with pytest.raises(ValueError, match="values_in_range"):
        audit.require_plausible(Fleet(spark, str(tmp_path / "odd")))
    assert Fleet(spark, str(tmp_path)).components.count() > 50


def test_runner(spark, sf_dir, tmp_path, capsys):
    found = runner.run_steps([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 1)])
    assert [(s.name, s.status) for s in found] == [("a", "passed"), ("b", "failed"), ("c", "skipped")] and "ZeroDivisionError" in found[1].error
    assert runner.main(["validate-input", str(tmp_path)]) == 1
    assert runner.main(["run", sf_dir, "--out", str(tmp_path / "out"), "--queries", "stage_units"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/stage_units")).count() > 0
    assert "passed" in capsys.readouterr().out
