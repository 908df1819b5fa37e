"""Validation over time, decisions and reviews: queries against SQL, operators against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from upkeep.operators import governance, monitoring
from upkeep.plans import decisions, planning, validation_plans
from upkeep.sources.fleet import MARTS

PLANS = (decisions, planning, validation_plans)
QUERIES, SQL = ({k: v for p in PLANS for k, v in getattr(p, of).items()} for of in ("QUERIES", "SQL"))


@pytest.fixture(scope="module", autouse=True)
def marts(spark, tmp_path_factory):
    """The queries share what they build."""
    spark.conf.set(MARTS, str(tmp_path_factory.mktemp("marts")))
    yield
    spark.conf.unset(MARTS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    mine, theirs = compare(spark, connect(sf_dir), QUERIES[name], SQL[name], sf_dir)
    assert mine == theirs


def test_allocation_of_the_fleet(spark, sf_dir):
    """Each case once, within the hours of each depot-week, at the cost that the quality row names."""
    rows, quality = QUERIES["capacity_allocation"](spark, sf_dir).collect(), QUERIES["allocation_quality"](spark, sf_dir).first()
    assert len({r.component_id for r in rows}) == len(rows) == quality.cases and quality.bound <= quality.cost == pytest.approx(sum(r.cost for r in rows), abs=1e-3)
    assert all((r.status == "allocated") == (r.depot_id is not None) and r.solver_status == quality.label for r in rows)
    used = QUERIES["allocation_utilisation"](spark, sf_dir).collect()
    assert all(r.used_h <= r.hours + 1e-6 for r in used) and sum(r.used_h > 0 for r in used) >= 1


def plain_metrics(rows):
    """The ten figures of (cut, component, score, y, p) rows by plain loops."""
    order = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    n, pos = len(rows), sum(r[3] for r in rows)
    neg, hits, precision = n - pos, 0, 0.0
    for k, r in enumerate(order, 1):
        hits += r[3]
        precision += hits / k if r[3] else 0
    wins = sum((a[2] > b[2]) + (a[2] == b[2]) / 2 for a in rows if a[3] for b in rows if not b[3])
    top = order[: max(1, math.ceil(n * 0.10))]
    known = [r for r in rows if r[4] is not None]
    bins: dict[int, list] = {}
    for r in known:
        bins.setdefault(next(k for k in range(10) if r[4] <= (k + 1) / 10), []).append(r)
    error = sum(abs(sum(r[3] for r in b) - sum(r[4] for r in b)) for b in bins.values()) / len(known) if known else None
    brier = lambda k, of: sum((r[k] - r[3]) ** 2 for r in of) / len(of) if of else None
    return [n, pos, pos / n, wins / (pos * neg) if pos and neg else None, precision / pos if pos else None, sum(r[3] for r in top) / len(top) / (pos / n) if pos else None, brier(2, rows), len(known), brier(4, known), error]


def test_fold_metrics(spark):
    rng = random.Random(1)
    rows = [(dt.date(2024, 1, 1 + 7 * k), c, round(rng.random(), 1), int(rng.random() < 0.3), rng.choice([None, 0.0, 0.1, 0.25, 0.3, 1.0]) if k else None) for k in range(3) for c in range(37)]
    rows += [(dt.date(2024, 2, 1), 1, 0.5, 0, 0.5), (dt.date(2024, 2, 8), 1, 0.5, 1, None)]
    got = {r.fold: r for r in monitoring.fold_metrics(spark.createDataFrame(rows, "cut date, component_id int, score double, y int, p double")).collect()}
    folds = {str(c): [r for r in rows if r[0] == c] for c in {r[0] for r in rows}} | {"overall": rows}
    assert set(got) == set(folds)
    for name, own in folds.items():
        assert list(got[name])[1:] == [x if x is None else pytest.approx(x) for x in plain_metrics(own)], name


def test_readiness_measures_all(spark):
    kind = "fold string, failures long, roc_auc double, calibration_error double"
    good = spark.createDataFrame([(f"c{k}", 10, 0.7, None) for k in range(6)] + [("overall", 60, 0.7, 0.05)], kind)
    drift = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "feature string, psi double")
    passed = monitoring.readiness(good, drift, external=True)
    assert {r.status for r in passed.collect()} == {"passed"}
    assert tuple(monitoring.deployment_gate(passed, True).first()) == ("risk_model_autonomous_use", "external", True, "controlled", "")
    bad = monitoring.readiness(spark.createDataFrame([("overall", 5, None, None)], kind), spark.createDataFrame([("a", 0.25)], "feature string, psi double"))
    assert [(r["check"], r.observed) for r in bad.where("blocks").collect()] == [("external_historical_source", 0.0), ("mature_temporal_folds", 0.0), ("observed_failures", 5.0), ("discrimination_roc_auc", None), ("out_of_sample_calibration_error", None), ("feature_drift_psi", 0.25)]
    gate = monitoring.deployment_gate(bad).first()
    assert not gate.allowed and gate.mode == "shadow" and gate.failed_checks.count("|") == 5


REGISTER = "decision_id string, day date, decision string, window_days int"
REVIEWS = "review_id int, decision_id string, approval_status string, reviewer_id string, reviewed_at timestamp"


def test_reviews_as_of_a_moment(spark):
    day = dt.date(2024, 1, 1)
    register = spark.createDataFrame([("A", day, "D01_now", 2), ("B", day, "D02_window", 7), ("C", day, "D06_none", 21), ("D", day, "D03_inspect", 3)], REGISTER)
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [
        (1, "A", "approved", "r", at(2)), (2, "A", "rejected", "q", at(5)), (3, "A", "approved", "q", at(5)), (4, "B", "escalated", "r", at(3)), (5, "B", "approved", "r", at(20)),
        (6, "D", "maybe", "r", at(2)), (7, "D", "approved", " ", at(2)), (8, "D", "approved", None, at(2)), (9, "D", "approved", "r", None), (10, "Z", "approved", "r", at(2)),
    ]
    reviews = spark.createDataFrame(rows, REVIEWS)
    out = governance.reviewed_register(register, reviews, F.lit(at(10)))
    got = {r.decision_id: (r.approval_required, r.approval_status, r.reviewer_id, r.reviews, r.contradicting, r.late, r.record_origin) for r in out.collect()}
    assert got == {
        "A": (True, "approved", "q", 3, True, True, "human_review"), "B": (True, "escalated", "r", 1, False, False, "human_review"), "C": (False, "pending", None, 0, False, False, "system_pending_review"), "D": (True, "pending", None, 0, False, False, "system_pending_review"),
    }
    later = {r.decision_id: (r.approval_status, r.late) for r in governance.reviewed_register(register, reviews, F.lit(at(30))).collect()}
    assert later["B"] == ("approved", True)
    checks = {r["check"]: (r.passed, r.observed) for r in governance.governance_checks(out, reviews).collect()}
    assert checks == {"decision_id_unique": (True, 0), "shadow_mode_enforced": (True, 0), "automatic_execution_disabled": (True, 0), "critical_decisions_require_approval": (True, 3), "approved_decisions_have_reviewer": (True, 0), "review_event_identity_unique": (False, 3)}
    with pytest.raises(ValueError, match="review_event_identity_unique"):
        governance.require_governed(governance.governance_checks(out, reviews))
    broken = out.union(out.where("decision_id = 'B'")).withColumns({"operating_mode": F.lit("live"), "auto_execution_allowed": F.lit(True), "approval_required": F.lit(False), "reviewer_id": F.lit(" ")})
    bad = {r["check"]: r.passed for r in governance.governance_checks(broken, reviews.limit(1)).collect()}
    assert bad == dict.fromkeys(checks, False) | {"review_event_identity_unique": True}
    governance.require_governed(governance.governance_checks(out, reviews.where("review_id IN (1, 4)")))
