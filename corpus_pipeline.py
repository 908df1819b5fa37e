"""A training corpus from the documents: toxic and poor texts go, near copies too, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs,
further ones of any name included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm import ngram_join, packing, pii, quality, toxicity
from upkeep.llm.common import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with an id of each row, written, and that column's name: ids of documents may be null or come again."""
    row = _free(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _keep(rows: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    return rows.join(kept.select(row), row, "left_semi").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity.learn(docs, _labels(spark, sf_dir))
    score = _free(docs, "_score")
    return toxicity.with_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and no rule rejects."""
    rows, row = _with_rows(docs)
    judged = quality.quality(rows.select("doc_id", "text", row), _labels(spark, sf_dir), row_col=row)
    return _keep(rows, judged.where("kept"), row).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id (a null is the largest) of each group of near copies; of repeated rows without words, one."""
    rows, row = _with_rows(docs)
    linked = ngram_join.ngram_components(rows.select(row, "text"), row).select(row, "n_shingles", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")
    kept = rows.select(row, "doc_id").join(linked.where("n_shingles > 0"), row).groupBy("component_id").agg(first)
    empty = rows.select(row, "doc_id", "text").join(linked.where("n_shingles = 0").select(row), row).groupBy("doc_id", "text", F.when(F.col("doc_id").isNull(), F.col(row))).agg(first)
    return _keep(rows, kept.select(f"first.{row}").union(empty.select(f"first.{row}")), row).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return packing.pack_sequences(pieces)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("n-gram Jaccard join", drop_near_copies), ("PII", mask_personal_data), ("packing", pack)]

#: Learned stages, an iteration and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
