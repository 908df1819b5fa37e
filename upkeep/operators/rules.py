"""Early warnings, component actions and operational decisions: ordered rules over exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions.ordering import with_quantiles
from upkeep.functions.scalars import clip, filled, last_rule_wins

# Weight of a confidence flag, and of an unknown one.
CONFIDENCE, UNKNOWN_CONFIDENCE = {"high": 0.92, "medium": 0.74, "low": 0.52}, 0.66


def confidence_part(name: str = "confidence_flag"):
    """0.55 of a flag's weight, rounded to the decimals that the product has: as doubles it comes out just above them."""
    part = lambda v: F.lit(round(0.55 * v, 4))
    return F.coalesce(*(F.when(F.col(name) == k, part(v)) for k, v in CONFIDENCE.items()), part(UNKNOWN_CONFIDENCE))


def early_warnings(df: DataFrame) -> DataFrame:
    """active_rules, level and action from thresholds by family.  df: family, failure_risk, health_score, rul_days, driver."""
    bounds = {
        "_risk": ("failure_risk", 0.75, 0.45, 0.72), "_risk2": ("failure_risk", 0.90, 0.62, 0.86), "_health": ("health_score", 0.30, 32, 52), "_health2": ("health_score", 0.15, 20, 40),
        "_rul": ("rul_days", 0.25, 20, 70), "_rul2": ("rul_days", 0.10, 8, 45),
    }
    df = with_quantiles(df, {name: (c, q) for name, (c, q, _, _) in bounds.items()}, ["family"])
    df = df.withColumns({name: clip(F.col(name), low, high) for name, (_, _, low, high) in bounds.items()})
    risk, rul, health = F.col("failure_risk"), filled("rul_days", 365), F.col("health_score")
    high = risk >= F.col("_risk")
    rules = [high, health <= F.col("_health"), F.coalesce(rul <= F.col("_rul"), F.lit(False)), F.col("driver").isin("backlog", "repetition", "anomalies") & high]
    df = df.withColumn("active_rules", sum((r.cast("int") for r in rules), F.lit(0)))
    n, very = F.col("active_rules"), risk >= F.col("_risk2")
    level = last_rule_wins([(n >= 1, "preventive"), ((n >= 2) | very, "high"), ((n >= 3) | (very & (rul <= F.col("_rul2"))) | (health <= F.col("_health2")), "critical")], "none")
    action = {"none": "monitor", "preventive": "inspect_72h", "high": "next_window", "critical": "act_now"}
    df = df.withColumn("level", level)
    return df.withColumn("action", F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in action.items()))).drop("_risk", "_risk2", "_health", "_health2", "_rul", "_rul2")


def component_actions(df: DataFrame) -> DataFrame:
    """rule, action, conflict and rationale of each component; later rules override earlier ones.

    df: failure_risk, health_score, deterioration_index, risk, service_impact,
    confidence_recent, critical_alerts, exposed, confidence_flag; nulls get defaults.
    """
    health = clip(filled("health_score", 50), 0, 100)
    df = df.withColumns({
        "_r": clip(filled("failure_risk", 0), 0, 1), "_h": health, "_d": clip(F.coalesce(F.col("deterioration_index").cast("double"), 100 - health), 0, 100), "_u": clip(filled("risk", 0), 0, 1), "_s": clip(filled("service_impact", 45), 0, 100), "_c": clip(filled("confidence_recent", 0.62), 0, 1), "_a": F.greatest(filled("critical_alerts", 0), F.lit(0.0)), "_b": clip(filled("exposed", 0), 0, 1),
    })
    df = df.withColumns({"_conf": clip(confidence_part() + 0.45 * F.col("_c"), 0, 1), "_i": F.round(clip(0.65 * F.col("_s") / 100.0 + 0.35 * F.col("_u"), 0, 1), 9)})
    df = df.withColumn("_urgency", clip(F.col("_r") * 0.45 + (1 - F.col("_h") / 100.0) * 0.22 + F.col("_d") / 100.0 * 0.13 + F.col("_i") * 0.12 + F.col("_b") * 0.08, 0, 1))
    wanted = {"r20": ("_r", 0.20), "r35": ("_r", 0.35), "r70": ("_r", 0.70), "r88": ("_r", 0.88), "r95": ("_r", 0.95), "h12": ("_h", 0.12), "h35": ("_h", 0.35), "h65": ("_h", 0.65), "h80": ("_h", 0.80), "i35": ("_i", 0.35), "i45": ("_i", 0.45), "i75": ("_i", 0.75), "d30": ("_d", 0.30), "d70": ("_d", 0.70), "d88": ("_d", 0.88)}
    df = with_quantiles(df, wanted)
    c = F.col
    quiet = (c("_r") <= c("r20")) & (c("_h") >= c("h80")) & (c("_d") <= c("d30")) & (c("_i") <= c("i35")) & (c("_a") == 0) & (c("_b") == 0)
    observe = (c("_r") <= c("r35")) & (c("_h") >= c("h65")) & (c("_i") <= c("i45")) & (c("_a") <= 1) & ~quiet
    between = (c("_r") >= F.greatest(F.lit(0.40), c("r35"))) & (c("_r") < F.greatest(F.lit(0.55), c("r70")))
    inspect = (between & (c("_conf") < 0.62)) | ((c("_d") >= c("d70")) & (c("_i") < c("i45")) & (c("_r") < c("r88"))) | ((c("_a") >= 2) & (c("_conf") < 0.68))
    window = (c("_r") >= c("r70")) | (c("_h") <= c("h35")) | (c("_urgency") >= 0.62)
    hit = c("_i") >= c("i75")
    now = ((c("_r") >= c("r95")) & hit & (c("_conf") >= 0.50)) | ((c("_h") <= c("h12")) & hit & (c("_conf") >= 0.55)) | ((c("_r") >= c("r88")) & hit & (c("_a") >= 2) & (c("_conf") >= 0.58)) | ((c("_r") >= 0.88) & (c("_a") >= 1) & (c("_i") >= 0.55))
    conflict = (((c("_r") >= c("r88")) & (c("_conf") < 0.56)) | ((c("_h") <= c("h12")) & (c("_r") <= c("r35"))) | ((c("_d") >= c("d88")) & hit & (c("_conf") < 0.60))) & ~now
    rule = last_rule_wins([(quiet, "R06_none"), (observe, "R05_observe"), (inspect, "R03_inspect"), (window, "R02_window"), (now, "R01_now"), (conflict, "R07_conflict")], "R04_monitor")
    df = df.withColumn("rule", rule)
    why = F.concat_ws("", c("rule"), F.lit(" | risk="), F.format_number("_r", 3), F.lit(", health="), F.format_number("_h", 1), F.lit(", deterioration="), F.format_number("_d", 1), F.lit(", confidence="), F.format_number("_conf", 2))
    return df.withColumns({"conflict": (c("rule") == "R07_conflict").cast("int"), "rationale": why}).drop("_r", "_h", "_d", "_u", "_s", "_c", "_a", "_b", "_conf", "_i", "_urgency", *wanted)


def operational_decisions(df: DataFrame) -> DataFrame:
    """decision, conflict and rationale of each case; later rules override earlier ones, a blocked immediate one all.

    df: failure_risk, health_score, rul_days, priority, deferral, service, fit,
    windows, saturation, service_criticality, risk, rul_confidence, confidence_flag,
    rule (the component's); nulls get defaults.
    """
    df = df.withColumns({
        "_p": clip(filled("failure_risk", 0), 0, 1), "_h": clip(filled("health_score", 50), 0, 100), "_l": clip(filled("rul_days", 365), 1, 365), "_n": clip(filled("priority", 0), 0, 100), "_f": clip(filled("deferral", 0), 0, 100), "_s": clip(filled("service", 0), 0, 100), "_fit": clip(filled("fit", 50), 0, 100),
        "_w": F.greatest(filled("windows", 0), F.lit(0.0)), "_sat": F.greatest(filled("saturation", 1), F.lit(0.0)), "_k": clip(filled("service_criticality", 0.55), 0, 1), "_u": clip(filled("risk", 0), 0, 1), "_c": clip(confidence_part() + 0.45 * clip(filled("rul_confidence", 0.6), 0, 1), 0, 1),
    })
    wanted = {"p15": ("_p", 0.15), "p30": ("_p", 0.30), "p65": ("_p", 0.65), "p80": ("_p", 0.80), "p92": ("_p", 0.92), "n30": ("_n", 0.30), "n45": ("_n", 0.45), "n70": ("_n", 0.70), "n92": ("_n", 0.92), "s25": ("_s", 0.25), "s45": ("_s", 0.45), "s80": ("_s", 0.80), "l05": ("_l", 0.05), "l10": ("_l", 0.10), "l20": ("_l", 0.20), "l50": ("_l", 0.50), "l70": ("_l", 0.70), "l90": ("_l", 0.90), "h15": ("_h", 0.15), "h35": ("_h", 0.35), "h62": ("_h", 0.62), "h80": ("_h", 0.80), "f70": ("_f", 0.70), "f92": ("_f", 0.92)}
    df = with_quantiles(df, wanted)
    c = F.col
    telling = (c("l90") - c("l10") >= 30) & (c("l10") < 220)
    l05, l20 = F.when(telling, c("l05")).otherwise(F.lit(7.0)), F.when(telling, c("l20")).otherwise(F.lit(21.0))
    impact = clip(0.50 * c("_s") / 100.0 + 0.30 * c("_u") + 0.20 * c("_k"), 0, 1)
    full, shut = (c("_fit") < 45) | (c("_sat") > 1.05), c("_w") <= 0
    near = telling & (c("_l") <= F.least(l05, F.lit(14.0)))
    urgent = (c("_p") >= c("p92")) | near | (c("_n") >= c("n92")) | (c("_f") >= c("f92"))
    quiet = (c("_p") <= c("p15")) & (c("_h") >= c("h80")) & (~telling | (c("_l") > c("l70"))) & (c("_s") <= c("s25")) & (c("_n") <= c("n30"))
    observe = (c("_p") <= c("p30")) & (c("_h") >= c("h62")) & (~telling | (c("_l") > c("l50"))) & (c("_s") <= c("s45")) & (c("_n") <= c("n45")) & ~quiet
    inspect = ((c("_p") >= F.greatest(F.lit(0.42), c("p30"))) & (c("_p") < c("p80")) & (c("_c") < 0.63)) | ((c("_h") <= c("h35")) & (impact < 0.52) & (c("_p") < c("p80"))) | F.coalesce(c("rule") == "R03_inspect", F.lit(False))
    window = (c("_p") >= c("p65")) | (telling & (c("_l") <= F.least(l20, F.lit(28.0)))) | (c("_n") >= c("n70")) | (c("_f") >= c("f70"))
    now = urgent & (c("_s") >= c("s80")) & (c("_c") >= 0.56) & ~full
    conflict = ((c("_p") >= c("p80")) & (c("_c") < 0.56)) | (near & full & (c("_p") >= c("p65"))) | ((c("_h") <= c("h15")) & (c("_p") <= c("p30")))
    blocked = now & (shut | full) & (c("_p") < 0.88)
    rule = last_rule_wins([(quiet, "D06_none"), (observe, "D05_observe"), (inspect, "D03_inspect"), (window, "D02_window"), (now, "D01_now"), (conflict, "D07_conflict"), (blocked, "D02B_blocked")], "D04_monitor")
    df = df.withColumns({"decision": rule, "decision_conflict": F.coalesce(conflict, F.lit(False)).cast("int")})
    why = F.concat_ws("", c("decision"), F.lit(" | risk="), F.format_number("_p", 3), F.lit(", rul="), F.format_number("_l", 1), F.lit(", impact="), F.format_number("_s", 1), F.lit(", fit="), F.format_number("_fit", 1))
    return df.withColumn("decision_rationale", why).drop("_p", "_h", "_l", "_n", "_f", "_s", "_fit", "_w", "_sat", "_k", "_u", "_c", *wanted)
