"""The pipeline against its stages by brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import base_pii, check_packed, components, expected_pieces  # noqa: F401
from upkeep.llm import queries, quality


def test_stages_keep_columns_and_whole_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns
        if name.startswith("n-gram"):
            comp = components([(r.doc_id, r.text) for r in docs.collect()])
            assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in comp.values()})
        if name == "PII":
            assert kept.count() == docs.count()
            assert not any(base_pii(r.text or "") for r in kept.collect())
        docs = corpus_pipeline.materialize(kept, "t")
        assert 0 < docs.count() <= before
        before = docs.count()
    check_packed(corpus_pipeline.pack(spark, docs, sf_dir), [(r.doc_id, r.text or "") for r in docs.collect()])


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    good = docs.join(good.select("doc_id"), "doc_id", "left_semi")
    passed = quality.text_statistics(good).where(~quality.base_failed()).select("doc_id")
    kept = corpus_pipeline.drop_poor(spark, corpus_pipeline.drop_toxic(spark, docs, sf_dir), sf_dir)
    lost = passed.join(kept.select("doc_id"), "doc_id", "left_anti").count()
    assert lost <= 0.03 * passed.count()


def test_null_and_repeated_ids(spark, sf_dir):
    """Stages go by row: a null id is kept like another, and neither of two texts of one id decides on the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_poor(spark, docs.where("lang = 'en'"), sf_dir), sf_dir).orderBy("doc_id").limit(4).collect()
    poor = {**good[0].asDict(), "text": "word " * 50}
    odd = [{**good[0].asDict(), "doc_id": None}, good[1].asDict(), {**good[2].asDict(), "doc_id": good[1].doc_id}, {**poor, "doc_id": good[1].doc_id}, {**good[3].asDict(), "doc_id": None}, {**good[1].asDict(), "doc_id": None}]
    odd = spark.createDataFrame(odd, docs.schema)
    rest = docs.where(~F.col("text").isin([r.text for r in good]))
    seen = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect() if r.text in {g.text for g in good} | {poor["text"]})
    want = sorted([(True, 0, good[0].text), (False, good[1].doc_id, good[1].text), (False, good[1].doc_id, good[2].text), (True, 0, good[3].text)])
    kept = corpus_pipeline.drop_poor(spark, rest.unionByName(odd), sf_dir)
    assert seen(kept) == sorted([*want, (True, 0, good[1].text)])
    assert seen(corpus_pipeline.drop_near_copies(spark, kept.where(F.col("text").isin([r.text for r in good])), sf_dir)) == want


def test_rows_of_the_registered_query(spark, sf_dir):
    assert queries.pipeline(spark, sf_dir).where(F.col("length") > 0).count() > 0


def test_stages_keep_further_columns_of_any_name(spark, sf_dir):
    """Columns named as the stages' own helpers pass through with their values, row by row."""
    names = ["_row", "_score", "first", "n_shingles", "component_id", "kept", "score", "_t", "n_words", "id", "label"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.col("doc_id") * 100 + k)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    got = docs.collect()
    assert len(got) > 20 and all(r[n] == r.doc_id * 100 + k for r in got for k, n in enumerate(names))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
