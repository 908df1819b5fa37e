"""Places, running sums, average ranks, quantiles and scalings over whole tables, without a task that holds a whole table.

A window over all rows sorts them in one task.  Here rows are dealt into ranges of
their order, each range sums up its own rows, and the sums of the ranges before it
(as many rows as there are ranges) are added.  Groups are dealt likewise, so one that
holds a third of all rows spreads over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.sources.store import materialize

#: The first pass over a quantile misses its place by at most a row in so many; the second counts the values around it.
ACCURACY = 10_000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which nulls are equal; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))).drop(*(f"_r_{k}" for k in keys))


def running(df: DataFrame, sums: dict[str, Column], order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """df with inclusive running sums along an order, and their totals as ``<name>_total``, over all rows or by group.

    The order should leave no ties, else equal rows take any order.  Ranges are
    sampled, so two runs may cut differently: they are written before they are read
    twice.  Null values add nothing.
    """
    keys = [*within, "_range"]
    values = {f"_v_{name}": F.coalesce(x, F.lit(0)) for name, x in sums.items()}
    dealt = df.withColumns(values).repartitionByRange(*(F.col(c) for c in within), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    parts = dealt.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))  # a row for each range
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, *(F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.sum(f"_p_{n}").over(group).alias(f"{n}_total") for n in sums))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _same(dealt, parts, keys).withColumns({n: F.sum(f"_v_{n}").over(upto) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_range", *values, *(f"_b_{n}" for n in sums))


def placed(df: DataFrame, name: str, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """df with the place of each row from 1, by an order without ties."""
    return running(df, {name: F.lit(1)}, order, within).drop(f"{name}_total")


def value_ranks(df: DataFrame, column: str, extra: Sequence[Column] = (), within: Sequence[str] = ()) -> DataFrame:
    """A row for each value of a column: _n (its rows), _rank (the mean of their places), _rows (all rows), and further aggregates.

    Nulls rank first, as one value.  Rows are counted before they are shuffled, so a
    value that many rows share is one row here.
    """
    counts = df.groupBy(*within, column).agg(F.count("*").alias("_n"), *extra)
    upto = running(counts, {"_upto": F.col("_n")}, [F.col(column)], within)
    return upto.withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2).withColumnRenamed("_upto_total", "_rows").drop("_upto")


def average_rank(df: DataFrame, column: str, name: str, within: Sequence[str] = (), share: bool = False) -> DataFrame:
    """df with the rank of a column from 1, ties at the mean of their places; with ``share`` as a part of all rows."""
    rank = F.col("_rank") / F.col("_rows") if share else F.col("_rank")
    ranks = value_ranks(df, column, within=within).select(*within, column, rank.alias(name))
    return _same(df, ranks, [*within, column])


def scaled(df: DataFrame, columns: dict[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """df with values scaled to 0..1 over all rows or by group; 0 where all are equal, null stays null."""
    df = df.withColumns(columns)
    bounds = df.groupBy(*within).agg(*(f(n).alias(f"_{k}_{n}") for n in columns for k, f in (("low", F.min), ("high", F.max))))
    both = _same(df, bounds, within) if within else df.crossJoin(F.broadcast(bounds))  # one row

    def unit(n: str) -> Column:
        low, span = F.col(f"_low_{n}"), F.col(f"_high_{n}") - F.col(f"_low_{n}")
        return F.when(span < 1e-9, F.lit(0.0)).otherwise((F.col(n) - low) / span)

    return both.withColumns({n: unit(n) for n in columns}).drop(*(f"_{k}_{n}" for n in columns for k in ("low", "high")))


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles in one row, or a row for each group; wanted: name to (column, q).

    A sketch brackets each quantile; then the rows below a bracket are one count, and
    only the values within it are counted one by one, some in a thousand of all.
    Nulls don't count; without values a quantile is null.  What there is for each
    quantile is written as SQL: a Column takes a call into the JVM for each of its parts.
    """
    source = {c: f"_c{k}" for k, c in enumerate(sorted({c for c, _ in wanted.values()}))}
    values = df.select(*by, *(F.col(c).cast("double").alias(x) for c, x in source.items()))
    margin = 4 / ACCURACY
    around = [f"struct(count({source[c]}) AS n, percentile_approx({source[c]}, array({max(q - margin, 0.0)!r}D, {min(q + margin, 1.0)!r}D), {ACCURACY}) AS `at`)" for c, q in wanted.values()]
    edges = values.groupBy(*by).agg(F.expr(f"array({', '.join(around)})").alias("_edges"))
    both = _same(values, edges, by) if by else values.crossJoin(F.broadcast(edges))  # one row
    each = [f"struct({k} AS k, {float(q)!r}D AS q, {source[c]} AS v, _edges[{k}].n AS n, _edges[{k}].`at` AS `at`)" for k, (c, q) in enumerate(wanted.values())]
    rows = both.select(*by, F.expr(f"inline(array({', '.join(each)}))")).where("v IS NOT NULL")
    rows = rows.withColumn("side", F.expr("CASE WHEN v < `at`[0] THEN -1 WHEN v > `at`[1] THEN 1 ELSE 0 END")).withColumn("mid", F.expr("CASE WHEN side = 0 THEN v END"))
    counts = rows.groupBy(*by, "k", "q", "n", "side", "mid").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = F.sum("c").over(Window.partitionBy(*by, "k").orderBy("side", "mid").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("x", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))
    place = F.col("q") * (F.col("n") - 1)
    first = lambda k: F.min(F.when(F.col("upto") > k, F.struct("upto", "x", "side", "c")))
    found = counts.groupBy(*by, "k", "q", "n").agg(first(F.floor(place)).alias("a"), first(F.ceil(place)).alias("b"))

    def value(end: str, at: Column) -> Column:
        """The value at a place; of the rows beyond a bracket only the nearest is known."""
        e = F.col(end)
        missed = ((e["side"] < 0) & (at != e["c"] - 1)) | ((e["side"] > 0) & (at != e["upto"] - e["c"]))
        return F.when(missed, F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")).otherwise(e["x"])

    low, high = value("a", F.floor(place)), value("b", F.ceil(place))
    found = found.select(*by, "k", "n", F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias("x"))
    return found.groupBy(*by).agg(*(F.expr(f"max(CASE WHEN k = {k} THEN x END) AS `{name}`") for k, name in enumerate(wanted)))


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """df with exact quantiles of its own columns, over all rows or by group."""
    found = quantiles(df, wanted, by)
    if not by:
        return df.crossJoin(F.broadcast(found))  # one row
    renamed = found.withColumnsRenamed({k: f"_r_{k}" for k in by})
    return df.join(renamed, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by)), "left").drop(*(f"_r_{k}" for k in by))
