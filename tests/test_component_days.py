"""The component mart deals its signals once, and carries the last events and open orders that features need."""

from pyspark.sql import functions as F

from tests.test_buckets import shuffled_joins  # noqa: F401
from upkeep.operators import features, marts
from upkeep.sources import store
from upkeep.sources.fleet import Fleet


def test_signals_are_dealt_by_component_once(spark, sf_dir, shuffled_joins):  # noqa: F811
    plan = marts.mart_component_day(Fleet(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(day" not in plan


def test_last_events_and_orders_of_the_mart(spark, sf_dir):
    """Against the joins by component, over events on days with and without readings."""
    f = Fleet(spark, sf_dir)
    mart = store.materialize(marts.mart_component_day(f), "mart")
    for name, events in {"maintenance": f.maintenance, "failure": f.failures}.items():
        both = features.days_since(mart, events, "want").withColumn("got", F.datediff("day", f"last_{name}"))
        assert both.where("NOT got <=> want").count() == 0 and both.where(f"got IS NOT NULL AND got > 0 AND NOT last_{name} <=> day").count() > 0
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(r)) for s, r in features.SEVERITY_RANK.items()))
    plain = features.with_backlog(mart.drop("order_risk"), f.backlog).withColumnRenamed("order_risk", "risk").join(mart.select("component_id", "day", "order_risk"), ["component_id", "day"])
    assert plain.where("NOT order_age <=> age_days OR NOT order_risk <=> risk").count() == 0 and plain.where(~rank.eqNullSafe(F.col("order_severity"))).count() == 0
    assert plain.where("order_age IS NOT NULL").count() > 0


def test_the_session_keeps_its_setting(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, "65535")
    with store.compiled_small(spark):
        assert int(spark.conf.get(key)) == 8000
    assert spark.conf.get(key) == before
