"""Column helpers: null-aware clips, ratios, families and rule chains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("wheel", "brake", "bogie", "pantograph")
# Substrings that name a family, in the order of the SQL ladder.
FAMILY_WORDS = (("wheel", "wheel"), ("rodadura", "wheel"), ("brake", "brake"), ("fren", "brake"), ("bogie", "bogie"), ("suspension", "bogie"), ("pant", "pantograph"), ("capt", "pantograph"))


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds a value; null stays null, though greatest and least skip nulls."""
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def filled(name: str | Column, value: float) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(float(value)))


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b; null, or the default, where b is zero or null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def guarded(a: Column, b: Column) -> Column:
    """a / b where b is positive, else 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def family(*texts: Column, order: Sequence[str] = FAMILIES, default: str = "other") -> Column:
    """First family in the order that a text names; the SQL layer, the inspections and the scores use different orders and defaults."""
    text = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(default)
    for name in reversed(order):
        for word, of in reversed(FAMILY_WORDS):
            if of == name:
                out = F.when(text.contains(word), F.lit(name)).otherwise(out)
    return out


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def last_rule_wins(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """Rules in order of application, later ones overriding: one conditional chain, last rule first."""
    out = F.lit(default)
    for when, value in rules:
        out = F.when(F.coalesce(when, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def first_present(df: DataFrame, name: str, candidates: Sequence[str]) -> Column:
    """The first of the candidate columns that the frame has and that isn't null in the row; null if it has none of them."""
    there = [F.col(c) for c in candidates if c in df.columns]
    return (F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name)


def days_crossed(a: Column, b: Column) -> Column:
    """Midnights between two moments."""
    return F.datediff(F.to_date(b), F.to_date(a))


def hours_crossed(a: Column, b: Column) -> Column:
    """Full hours of the clock between two moments."""
    return F.timestamp_diff("HOUR", F.date_trunc("hour", a), F.date_trunc("hour", b))


def days_between(a: Column, b: Column) -> Column:
    """Elapsed time in days, with its fraction."""
    return F.timestamp_diff("MICROSECOND", a, b) / 86_400_000_000.0


def right_closed(x: Column, edges: Sequence[float], first: bool = False) -> Column:
    """Index of the bin (edge, next edge] from 0; with ``first`` the lowest edge counts to the first bin."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = x >= edges[i] if first and i == 0 else x > edges[i]
        out = F.when(low & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, for results that don't hang on the order of sums."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
