"""Scores, lives and cases write the features of the last days alone, with the same values as in the whole tables."""

from datetime import timedelta

from pyspark.sql import functions as F

from upkeep.operators import features
from upkeep.plans import catalogue
from upkeep.sources.fleet import Fleet


def rows(df) -> list[str]:
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(sorted(df.columns)).collect())


def test_last_days_equal_those_of_the_whole_tables(spark, sf_dir):
    f, whole = Fleet(spark, sf_dir), Fleet(spark, sf_dir)
    scored = catalogue._scored(f)
    catalogue._depots_now(f)
    assert {"recent", "units_now", "unit_features_now", "depots_now"} <= set(f._stored) and not {"features", "unit_day", "unit_features", "depot_day"} & set(f._stored)
    feats = catalogue._features(whole)
    last = feats.agg(F.max("day")).first()[0]
    recent = catalogue._recent(f)
    assert rows(recent) == rows(feats.where(F.col("day") > last - timedelta(days=catalogue.WINDOW))) and 0 < recent.count() < feats.count()
    for now, all_ in ((catalogue._units_now(f), catalogue._stored_units(whole)), (catalogue._unit_features_now(f), catalogue._unit_features(whole)), (catalogue._depots_now(f), catalogue._stored_depots(whole))):
        assert rows(features.latest(now)) == rows(features.latest(all_)) and rows(now.where(F.col("day") == last)) == rows(all_.where(F.col("day") == last)) != []
    assert catalogue._recent(whole) is feats and catalogue._unit_features_now(whole) is catalogue._unit_features(whole)
    assert rows(catalogue._scored(whole)) == rows(scored)
