"""Quality rules: interpretable decision lists learned by sequential covering.

Statistics are DataFrame expressions.  Rules that reject are grown condition by
condition from counts of the labelled rows by feature bin (FOIL gain), pruned on
rows set aside, and applied in order as one conditional expression.  The driver
sees only counts by feature, bin and label.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share")
BINS = 24
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_PRECISION, MIN_COVER = 0.9, 5


def _without(text: Column, chars: str) -> Column:
    """Length of the text without some characters."""
    return F.length(F.translate(text, chars, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it and whatever Spark moves the expression into."""
    return F.transform(F.array(value), body)[0]


def _windows(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - 4), lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(5))))


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more: sorted, equal windows are neighbours; each adds what the one before has not covered."""

    def twice(pairs: Column) -> Column:
        near = lambda e, k: F.get(pairs, k)["h"] == e["h"]
        marked = F.transform(pairs, lambda e, k: F.struct(e["i"].alias("i"), (F.coalesce(near(e, k - 1), F.lit(False)) | F.coalesce(near(e, k + 1), F.lit(False))).alias("twice")))
        return F.array_sort(F.transform(F.filter(marked, lambda e: e["twice"]), lambda e: e["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-5).alias("last"))
        return F.aggregate(places, start, lambda s, i: F.struct((s["total"] + F.least(F.lit(5), i - s["last"])).alias("total"), i.alias("last")), lambda s: s["total"])

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, lambda x: covered(twice(x)))


def _repeat_words(hashes: Column) -> Column:
    """Words in 5-word windows found twice or more, from the array of word hashes."""
    several = lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), _covered(x)).otherwise(0)
    return F.when(F.size(hashes) >= 5, _let(_windows(hashes), several)).otherwise(0).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the FEATURES (double).

    Null text has no words.  Arrays of words and lines are bound inside one expression,
    so a filter on the statistics computes them once more at the most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.expr(r"transform(filter(split(_t, '[\\x20\\x09-\\x0D]+'), w -> w != ''), w -> xxhash64(w))")
    lines = F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w).alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    found = docs.withColumn("_t", text).withColumns({"_w": of_words, "_l": of_lines})
    found = found.withColumns({
        "n_words": F.col("_w.n"), "word_chars": _without(F.col("_t"), SPACE).cast("long"),
        "n_symbols": (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long"), "n_dup_lines": F.col("_l.dup"), "n_repeat_words": F.col("_w.again"),
        "_upper": F.length("_t") - _without(F.col("_t"), UPPER), "_marks": F.length("_t") - _without(F.col("_t"), "!?"),
    })
    n_words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    found = found.withColumns({
        "mean_word": F.col("word_chars") / n_words, "symbol_share": F.col("n_symbols") / n_words, "upper_share": F.col("_upper") / chars, "mark_share": F.col("_marks") / n_words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_l.n"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / n_words, "distinct_share": F.col("_w.distinct") / n_words,
    })
    return found.drop("_t", "_w", "_l", "_upper", "_marks")


def base_failed() -> Column:
    """Texts with few words, or with over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _holds(r)
    return out


def _best(rows: DataFrame, edges: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition | None]:
    """The condition of the largest FOIL gain, from counts by feature and bin."""
    bins = F.array(*(F.struct(F.lit(i).alias("f"), sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f]), F.lit(0)).alias("b")) for i, f in enumerate(FEATURES)))
    counts: dict[int, list[list[int]]] = {i: [[0, 0] for _ in range(len(edges[f]) + 1)] for i, f in enumerate(FEATURES)}
    for r in rows.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b", "bad").count().collect():
        counts[r["f"]][r["b"]][r["bad"]] += r["count"]
    before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for i, f in enumerate(FEATURES):
        for k, e in enumerate(edges[f]):
            for above in (True, False):
                side = counts[i][k + 1 :] if above else counts[i][: k + 1]
                n, p = sum(x[0] for x in side), sum(x[1] for x in side)
                if p and p + n < p0 + n0:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best[0] + 1e-9:
                        best = gain, Condition(f, above, e)
    return best


def learn_rules(labelled: DataFrame, id_col: str = "doc_id", max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """Rules that reject, in order, from rows (id_col, bad 0 or 1, FEATURES).

    Two of three rows grow rules; the rest prunes them.  A rule is kept if at least
    ``min_precision`` of all rows that it newly covers, and ``min_cover`` of them,
    are bad.  Without labels of both kinds there is no rule.
    """
    rows = materialize(labelled.select("bad", (F.pmod(F.xxhash64(id_col), F.lit(3)) > 0).alias("grow"), *FEATURES), "labelled")
    if len(rows.select("bad").distinct().take(2)) < 2:
        return []
    cuts = rows.select(*(F.percentile_approx(f, [k / BINS for k in range(1, BINS)]).alias(f) for f in FEATURES), *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), [k / BINS for k in range(1, BINS)]).alias(f"_{f}") for f in FEATURES)).first()
    edges = {f: sorted({*cuts[f], *cuts[f"_{f}"]}) for f in FEATURES}
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(~_any(rules))
        rule: Rule = ()
        while len(rule) < max_conditions:
            cover = left.where(F.col("grow") & _holds(rule))
            size = dict(cover.groupBy("bad").count().collect())
            p, n = size.get(1, 0), size.get(0, 0)
            if not p or not n:
                break
            _, condition = _best(cover, edges, p, n)
            if condition is None:
                break
            f, e = F.col(condition.feature), condition.threshold
            low, high = cover.agg(F.max(F.when(f <= e, f)), F.min(F.when(f > e, f))).first()
            rule += (Condition(condition.feature, condition.above, (low + high) / 2),)  # half way between its neighbours
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        if not shorter:
            break
        bad, good = F.col("bad") == 1, F.col("bad") == 0
        tally = left.agg(*(F.count_if(c & _holds(r) & side).alias(f"x{k}_{m}") for k, r in enumerate(shorter) for m, c, side in (("p", bad, ~F.col("grow")), ("n", good, ~F.col("grow")), ("P", bad, F.lit(True)), ("N", good, F.lit(True))))).first()
        value = [(tally[f"x{k}_p"] - tally[f"x{k}_n"]) / max(1, tally[f"x{k}_p"] + tally[f"x{k}_n"]) for k in range(len(shorter))]
        pick = max(range(len(shorter)), key=lambda k: (value[k], -k))
        p, n = tally[f"x{pick}_P"], tally[f"x{pick}_N"]
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(shorter[pick])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1, or 0: an ordered conditional expression."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(_holds(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The statistics of every whole text, base_failed, rule (first that rejects, else 0) and kept.

    Null text counts as empty; such texts fail the base.  Labels other than 0 and 1
    and labels without a document are left out.  Repeated rows stay, other columns
    are ignored, but ``row_col`` stays if given.
    """
    stats = text_statistics(docs.select(id_col, *([row_col] if row_col else []), F.col(text_col).alias("text"))).drop("text")
    stats = materialize(stats, "statistics")
    y = labels.where(F.col("quality").isin(0, 1)).select(id_col, (1 - F.col("quality")).cast("int").alias("bad"))
    rules = learn_rules(stats.where(~base_failed()).join(y, id_col), id_col)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
