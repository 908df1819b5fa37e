"""The facet cube against direct counts, over any choice of facets."""

import random

import pytest
from pyspark.sql import functions as F

from upkeep.operators import panel

ROWS = [(random.Random(i).choice(["a", "b", None]), i % 3, i * 7919 % 100_000 - 50_000 if i % 11 else None, float(i)) for i in range(500)]


@pytest.fixture(scope="module")
def cube(spark):
    base = spark.createDataFrame(ROWS + ROWS[:50], "kind string, depot int, unit long, v double")
    return panel.facet_cube(base, ["kind", "depot"], "unit", {"sum_v": F.col("v")})


@pytest.mark.parametrize("filters", [{}, {"kind": ["a"]}, {"kind": ["a", "b"], "depot": [0, 2]}, {"depot": [9]}])
@pytest.mark.parametrize("by", [[], ["depot"], ["kind", "depot"]])
def test_any_choice_of_facets(cube, filters, by):
    rows = [r for r in ROWS + ROWS[:50] if all(r[("kind", "depot").index(c)] in v for c, v in filters.items())]
    want: dict = {}
    for r in rows:
        want.setdefault(tuple(r[("kind", "depot").index(c)] for c in by), []).append(r)
    got = {tuple(r[c] for c in by): (r.n_rows, r.members, r.sum_v) for r in panel.cube_view(cube, filters, by).collect()}
    if not rows and not by:
        assert got == {(): (None, 0, None)}
    else:
        assert got == {k: (len(x), len({r[2] for r in x if r[2] is not None}), sum(r[3] for r in x)) for k, x in want.items()}


def test_signature_is_of_rows_not_of_their_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.5)], "k int, t string, v double")
    one = panel.signature(df).first().signature
    assert one == panel.signature(df.orderBy(F.col("k").desc()).repartition(2)).first().signature and len(one) == 40
    assert one != panel.signature(df.limit(1)).first().signature != panel.signature(df.limit(0)).first().signature
