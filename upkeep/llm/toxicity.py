"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Document frequencies of hashed character n-grams are counted over all labelled
training texts.  The features with the strongest ratios get a logistic model
(L1, fitted on a bounded sample of the training rows); a feature's value is its
log-count ratio where the text holds it, else 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.llm.common import slices, small_batches

_U = np.uint64
BITS, LENGTHS = 20, (4, 5, 6)
MIN_TEXTS = 5
FEATURES = 4096
SAMPLE_ROWS = 20_000
BROADCAST_LABELS = 2_000_000
#: Bytes of text taken at once: its n-grams take some hundred times as much in a worker.
TEXT_BYTES = 1 << 18
_letters: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to itself, or to a space if it is no letter or digit."""
    if not _letters:
        x = np.arange(0x110000, dtype=np.uint32)
        x[np.array([not chr(i).isalnum() for i in range(0x110000)])] = 32
        _letters.append(x)
    return _letters[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the text's index and the hashed feature of each position."""
    texts = [f" {t.lower()} " for t in texts]
    size = np.array([len(t) for t in texts])
    c = _fold()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    own = np.repeat(np.arange(len(texts)), size)
    x = c
    for n in range(2, max(LENGTHS) + 1):
        if len(c) < n:
            return
        x = x[:-1] * _U(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n in LENGTHS:
            inside = own[: len(x)] == own[n - 1 :]
            yield own[: len(x)][inside], (((x ^ (x >> _U(31))) * _U(0xC2B2AE3D27D4EB4F + 2 * n)) >> _U(64 - BITS)).astype(np.int64)[inside]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies by label of the features that the task has seen, in parts to be summed."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in slices(batches, "text", TEXT_BYTES):
        label = np.array(batch.column("label").to_pylist(), np.int64)
        pairs = np.unique(np.concatenate([own << BITS | f for own, f in grams(_texts(batch))] or [np.zeros(0, np.int64)]))
        np.add.at(total, (label[pairs >> BITS], pairs & ((1 << BITS) - 1)), 1)
    for at in range(0, 1 << BITS, 1 << 16):
        there = at + np.flatnonzero(total[:, at : at + (1 << 16)].any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[0, there]), pa.array(total[1, there])], names=["feature", "negative", "positive"])


def ngram_counts(train: DataFrame) -> DataFrame:
    """(feature, negative, positive): texts of each label that hold a hashed n-gram, over all rows (text, label 0 or 1)."""
    parts = train.select("text", "label").mapInArrow(_count, "feature int, negative long, positive long")
    return parts.groupBy("feature").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))


@dataclass(frozen=True)
class ToxicityModel:
    """The bias, and the weight of each feature: its log-count ratio times the fitted weight."""

    bias: float
    features: np.ndarray
    weights: np.ndarray


def _present(features: np.ndarray):
    """For each labelled text, which of ``features`` it holds, one bit each: the driver gets so many bytes a row and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(1 << BITS, -1, np.int32)
        at[features] = np.arange(len(features))
        for batch in slices(batches, "text", TEXT_BYTES):
            held = np.zeros((batch.num_rows, len(features)), bool)
            for own, f in grams(_texts(batch)):
                held[own[at[f] >= 0], at[f[at[f] >= 0]]] = True
            bits = np.packbits(held, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in bits], pa.binary())], names=["label", "bits"])

    return run


def _fit(label: np.ndarray, own: np.ndarray, ids: np.ndarray, ratio: np.ndarray, l1: float = 1e-4, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression by accelerated proximal gradient steps."""
    n, k = len(label), len(ratio)
    value = ratio[ids]
    w, z, b, zb, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    row = np.bincount(own, value * value, minlength=n).max(initial=1.0)
    step = 4.0 / (min(row, 400.0) + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(own, value * z[ids], minlength=n) + zb, -30, 30)))
        g = (p - label) / n
        new = z - step * np.bincount(ids, value * g[own], minlength=k)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = zb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), w * ratio


def train_toxicity(train: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit on rows (id, text, label 0 or 1).  Without both labels the model is its prior.

    Counts cover all rows; the fit takes at most ``sample_rows`` rows, those of the
    smallest hashes of their ids.
    """
    size = dict(train.groupBy("label").count().collect())
    neg, pos = size.get(0, 0), size.get(1, 0)
    if not pos or not neg:
        return ToxicityModel(float(np.log((pos + 0.5) / (neg + 0.5))), np.zeros(0, np.int64), np.zeros(0))
    counts = ngram_counts(train).where(F.col("negative") + F.col("positive") >= MIN_TEXTS)
    ratio = F.log((F.col("positive") + 1) / (pos + 2)) - F.log((F.col("negative") + 1) / (neg + 2))
    counts = counts.withColumn("ratio", ratio).orderBy((F.abs("ratio") * F.sqrt(F.col("positive") + F.col("negative") * (pos / neg))).desc(), "feature").limit(features)
    kept = counts.select("feature", "ratio").collect()
    chosen, r = np.array([x.feature for x in kept], np.int64), np.array([x.ratio for x in kept], float)
    rows = train if pos + neg <= sample_rows else train.join(F.broadcast(train.select("id").orderBy(F.xxhash64("id"), "id").limit(sample_rows).distinct()), "id", "left_semi")
    found = rows.select("text", "label").mapInArrow(_present(chosen), "label int, bits binary").toArrow()
    bits = np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8).reshape(len(found), -1)
    own, ids = (np.concatenate(x).astype(np.int32) for x in zip(*([o + at, i] for at in range(0, max(1, len(bits)), 1024) for o, i in [np.nonzero(np.unpackbits(bits[at : at + 1024], axis=1, count=len(chosen)))]), strict=True))
    bias, weights = _fit(found.column("label").to_numpy().astype(float), own, ids, r)
    used = weights != 0
    return ToxicityModel(bias, chosen[used], weights[used])


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text; null and empty texts score as texts without a feature."""
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    bias, features, weights = model.bias, model.features, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[features] = weights
        for batch in slices(batches, text_col, TEXT_BYTES):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            pairs = [own[table[f] != 0] << BITS | f[table[f] != 0] for own, f in grams(texts)]
            pairs = np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)]))
            total = bias + np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], minlength=batch.num_rows)
            score = pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, label) of the labelled documents; labels are broadcast only while their count allows."""
    y = labels.where(F.col(target).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("label"))
    few = y.count() <= BROADCAST_LABELS
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y) if few else y, "id")


def held_out(id_col: str = "doc_id"):
    """Rows never trained on: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """The model of the labels of the rows not held out."""
    small_batches(docs.sparkSession)
    return train_toxicity(labelled(docs, labels.where(~held_out(id_col)), "toxic", id_col, text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of all documents, learned from the labels of the rows not held out.

    Labels other than 0 and 1 are left out, and so are labels without a document.
    Repeated rows stay; other columns are ignored.
    """
    model = learn(docs, labels, id_col, text_col)
    out = with_toxicity(docs.select(id_col, text_col), model, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
