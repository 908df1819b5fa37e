"""Queries behind the panel: filters, grouped means, window load, pages and payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_filters(df: DataFrame, facets: Mapping[str, object], text: str = "") -> DataFrame:
    """Rows that equal every facet and hold the text in any column, whatever its case."""
    for c, v in facets.items():
        df = df.where(F.col(c) == v)
    if text:
        df = df.where(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns))).contains(text.lower()))
    return df


def group_mean(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Groups of the largest mean, ties by key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n_rows")).orderBy(F.col("mean").desc(), key).limit(n)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def window_bucket(days: Column) -> Column:
    return F.when(days <= 3, "0_3").when(days <= 7, "4_7").when(days <= 14, "8_14").otherwise("15_plus")


def payload(df: DataFrame) -> DataFrame:
    """One JSON text a row, safe within a script element."""
    text = F.to_json(F.struct(*df.columns))
    for raw, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return df.select(text.alias("json"))


def signature(df: DataFrame) -> DataFrame:
    """One row: a SHA-1 of the number of rows and of the sum of their digests, whatever their order; columns by name, null as an empty text."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)))
    part = F.conv(F.substring(F.sha1(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sha1(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string"))).alias("signature"))


def facet_cube(base: DataFrame, facets: Sequence[str], member: str, sums: Mapping[str, Column]) -> DataFrame:
    """A row for each combination of facet values and each 32,768 members: n_rows, sums, and a bitmap of the members seen.

    member: an integer column; its distinct values can be counted later over any choice
    of combinations, as bitmaps unite where counts don't add up.  A bitmap has 4 KiB,
    whatever the rows.  Null members are in no bitmap.
    """
    bit = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(member)))
    return base.groupBy(*facets, F.bitmap_bucket_number(F.col(member)).alias("_bucket")).agg(F.count("*").alias("n_rows"), *(F.sum(x).alias(n) for n, x in sums.items()), bit.alias("_members"))


def cube_view(cube: DataFrame, filters: Mapping[str, Sequence], by: Sequence[str] = ()) -> DataFrame:
    """n_rows, members (distinct) and the cube's sums of the combinations that pass the filters, in one row or by facet."""
    for c, values in filters.items():
        cube = cube.where(F.col(c).isin(*values))
    sums = [c for c in cube.columns if c not in ("_bucket", "_members", *by) and dict(cube.dtypes)[c] in ("bigint", "double", "decimal(38,0)") and c.startswith(("n_rows", "sum_"))]
    united = cube.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(c) for c in sums), F.bitmap_or_agg("_members").alias("_members"))
    out = united.withColumn("_count", F.when(F.col("_bucket").isNull(), F.lit(0)).otherwise(F.bitmap_count("_members")))
    return out.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), F.coalesce(F.sum("_count"), F.lit(0)).alias("members"))


def facet_options(cube: DataFrame, facets: Sequence[str], views: Mapping[str, Mapping[str, Sequence]]) -> DataFrame:
    """(view, facet, value, ...): what each value of each facet would give under the view's other filters; facet ``*`` is the view itself."""
    out = None
    for view, filters in views.items():
        parts = [cube_view(cube, filters).withColumns({"facet": F.lit("*"), "value": F.lit(None).cast("string")}).where("n_rows IS NOT NULL")]
        for f in facets:
            one = cube_view(cube, {k: v for k, v in filters.items() if k != f}, [f])
            parts.append(one.withColumns({"facet": F.lit(f), "value": F.col(f).cast("string")}).drop(f))
        for p in parts:
            p = p.withColumn("view", F.lit(view))
            out = p if out is None else out.unionByName(p)
    return out


def completeness(df: DataFrame, columns: Sequence[str]) -> Column:
    """Share of the columns that aren't null."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / len(columns)


def smoothed(df: DataFrame, key: str, value: str, rows: int = 8, least: int = 2) -> DataFrame:
    """Trailing mean over ``rows`` rows; null with fewer than ``least``."""
    w = Window.orderBy(key).rowsBetween(1 - rows, 0)
    return df.withColumn("smoothed", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))
