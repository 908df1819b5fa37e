"""Distributed places, sums, ranks and scalings against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from upkeep.functions.ordering import average_rank, placed, quantiles, running, scaled, with_quantiles
from upkeep.operators import validation

SCHEMA = "id long, g string, v double"


def made(n: int = 3000) -> list[tuple]:
    """A third of the rows share one value, most of them one group; some groups and values are null."""
    dice = random.Random(7)
    return [(i, dice.choice(["hot"] * 6 + ["a", "b", None]), dice.choice([5.0, round(dice.random() * 50, 1), None if dice.random() < 0.1 else float(dice.randrange(8))])) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(7)


def low(v):
    """Nulls before all values."""
    return (v is not None, v or 0.0)


def groups(rows, within):
    out = {}
    for r in rows:
        out.setdefault(r[1] if within else 0, []).append(r)
    return out.values()


@pytest.mark.parametrize("within", [[], ["g"]])
def test_running_and_places(frame, within):
    df = running(frame, {"s": F.col("v"), "k": F.lit(1)}, [F.col("v").desc(), F.col("id")], within)
    found = {r["id"]: (r["k"], round(r["s"], 6), r["k_total"], round(r["s_total"], 6)) for r in df.collect()}
    want = {}
    for rows in groups(made(), within):
        rows = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))
        whole, so_far = sum(r[2] or 0.0 for r in rows), 0.0
        for k, r in enumerate(rows, 1):
            so_far += r[2] or 0.0
            want[r[0]] = (k, round(so_far, 6), len(rows), round(whole, 6))
    assert found == want
    assert df.columns == ["id", "g", "v", "s_total", "k_total", "s", "k"]


@pytest.mark.parametrize("within", [[], ["g"]])
def test_average_ranks(frame, within):
    found = {r["id"]: (r["r"], round(r["p"], 9)) for r in average_rank(average_rank(frame, "v", "r", within), "v", "p", within, share=True).collect()}
    want = {}
    for rows in groups(made(), within):
        order = sorted(low(r[2]) for r in rows)
        first, n = {}, {}
        for k, v in enumerate(order, 1):
            first.setdefault(v, k)
            n[v] = n.get(v, 0) + 1
        for r in rows:
            v = low(r[2])
            want[r[0]] = (first[v] + (n[v] - 1) / 2, round((first[v] + (n[v] - 1) / 2) / len(rows), 9))
    assert found == want


@pytest.mark.parametrize("within", [[], ["g"]])
def test_scaled(frame, within):
    found = {r["id"]: (r["x"], r["same"]) for r in scaled(frame, {"x": F.col("v"), "same": F.lit(3.0)}, within).collect()}
    for rows in groups(made(), within):
        values = [r[2] for r in rows if r[2] is not None]
        for r in rows:
            x, same = found.pop(r[0])
            assert same == 0.0
            assert x is None if r[2] is None else abs(x - (r[2] - min(values)) / (max(values) - min(values))) < 1e-12
    assert not found


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert placed(none, "k", [F.col("id")]).count() == 0
    assert average_rank(none, "v", "r").count() == 0
    assert scaled(none, {"x": F.col("v")}).count() == 0


def test_no_single_partition(frame):
    """One group that holds all rows isn't gathered in one partition."""
    df = frame.sparkSession.range(0, 200_000, 1, 8).select("id", F.lit("hot").alias("g"), F.rand(3).alias("v"))
    plan = placed(df, "k", [F.col("v"), F.col("id")], ["g"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("rows", [1, 3, 40, 2_999, 60_000])
def test_quantiles(spark, by, rows):
    """Equal to the built-in exact percentile, with ties, nulls and brackets of many values."""
    v = F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 17 > 0, F.rand(5))
    df = spark.range(0, rows, 1, 5).select(F.when(F.col("id") % 4 > 0, F.col("id") % 2).cast("string").alias("g"), v.alias("v"), (F.col("id") % 7).alias("w"))
    wanted = {f"{c}{k}": (c, q) for c in ("v", "w") for k, q in enumerate((0.0, 0.1, 0.35, 0.5, 0.88, 0.95, 1.0))}
    want = df.groupBy(*by).agg(*(F.percentile(c, q).alias(n) for n, (c, q) in wanted.items()))
    plain = lambda d: sorted((tuple(x if x is None or isinstance(x, str) else round(x, 12) for x in r) for r in d.select(*by, *wanted).collect()), key=repr)
    assert plain(quantiles(df, wanted, by)) == plain(want)
    assert with_quantiles(df, wanted, by).count() == rows


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quantiles(none, {"a": ("v", 0.5)}).collect() == [(None,)]
    assert quantiles(none, {"a": ("v", 0.5)}, ["g"]).count() == 0
    nulls = spark.createDataFrame([(1, "a", None), (2, "b", 3.0)], SCHEMA)
    assert sorted(with_quantiles(nulls, {"a": ("v", 0.5)}, ["g"]).select("id", "a").collect()) == [(1, None), (2, 3.0)]


def test_numeric_profile_holds_no_column_in_one_task(spark):
    df = spark.range(20001).selectExpr("if(id % 10 = 0, null, cast(pmod(id * 7919, 20011) as double) / 7) as x")
    out = validation.numeric_profile(df, "x")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "percentile_approx(" in plan
    x = np.array([r.x for r in df.where("x IS NOT NULL").collect()])
    assert list(out.first()) == pytest.approx([x.min(), *np.quantile(x, [0.01, 0.5, 0.99]), x.max(), x.mean(), x.std()], rel=1e-12)
    assert list(validation.numeric_profile(df.where("x < 0"), "x").first()) == [None] * 7
