"""Whitening of embeddings by a covariance in two passes.

Vectors become integers.  A first pass sums them exactly, so the mean is exact.  A
second pass centres them and sums their outer products by matrix products, a matrix
for each partition; treeAggregate merges the matrices, so the driver gets one.  The
eigenvectors of the covariance are broadcast (a vector a component) and project the
centred vectors.  A third pass measures the covariance of what comes out.  Each length
of vectors is a fit of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import finite_vector, small_batches

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BATCH_ROWS = 1024
#: Integers are held to this size, so that sums of halves and differences fit in 64 bits; vectors within +-2^50 are far from it.
LARGEST = 1 << 61
_HALF = np.int64((1 << 32) - 1)


@dataclass(frozen=True)
class Fit:
    """n vectors with exact sums; by component: axes (columns), values (of the covariance, falling), explained."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the mean's whole part in integers, the rest in double."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return (x - np.array(whole, np.int64)).astype(float) - np.array(rest, float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sum)^2 by vector; None where a long can't hold it."""
        whole, rest = (np.array(v, np.int64) for v in zip(*(divmod(s, self.n) for s in self.sums), strict=True))
        far = x - whole
        if self.n * (int(np.abs(far).max(initial=0)) + 1) < 2**31 / max(1, x.shape[1]) ** 0.5:
            return ((self.n * far - rest) ** 2).sum(axis=1).tolist()
        about = ((self.n * far.astype(float) - rest) ** 2).sum(axis=1)
        rows = zip(about, far.tolist(), strict=True)
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) if size < 2.0**64 else None for size, row in rows]
        return [v if v is not None and v < 1 << 63 else None for v in exact]

    def sound(self) -> np.ndarray:
        """Which components stand above the rounding of the covariance; the others have no whitened value."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.sound(), self.centred(x) @ self.axes / np.sqrt(np.maximum(self.values, 0)), np.nan)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as integers) of each length in a batch."""
    vectors = batch.column("vector")
    values, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = values if len(at) == len(sizes) else values[(begin[at][:, None] + np.arange(d)).ravel()]
        whole = np.clip(np.floor(x.reshape(len(at), d) * float(SCALE)), -float(LARGEST), float(LARGEST)).astype(np.int64)
        yield at, np.minimum(whole + SHIFT, LARGEST)


def _totals(vectors: DataFrame, part: Callable[[int, np.ndarray], np.ndarray], kind: type) -> dict[int, tuple[int, list]]:
    """By length: rows, and the sum of ``part`` over the partitions, as exact integers or as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in _by_length(batch) if batch.num_rows else ():
                d = x.shape[1]
                n[d], one = n.get(d, 0) + len(at), part(d, x)
                sums[d] = sums[d] + one if d in sums else one
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*n], pa.int32()), pa.array([*n.values()], pa.int64()), pa.array([sums[d].tobytes() for d in n], pa.binary())], names=["d", "n", "sums"])

    def plus(a: dict, b: dict) -> dict:
        for d, (n, sums) in b.items():
            a[d] = (a[d][0] + n, a[d][1] + sums) if d in a else (n, sums)
        return a

    def add(a: dict, row) -> dict:
        sums = np.frombuffer(row.sums, kind)
        return plus(a, {row.d: (row.n, sums.astype(object) if kind is np.int64 else sums)})

    return vectors.select("vector").mapInArrow(run, "d int, n long, sums binary").rdd.treeAggregate({}, add, plus)


def _halves(d: int, x: np.ndarray) -> np.ndarray:
    """Sums of the upper and of the lower halves of the integers: exact for 2^31 rows of a partition."""
    return np.concatenate([(x >> np.int64(32)).sum(axis=0), (x & _HALF).sum(axis=0)])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length; vectors: a column ``vector`` of finite arrays."""
    sc = vectors.sparkSession.sparkContext
    sums = {d: (n, tuple((int(a) << 32) + int(b) for a, b in zip(s[:d], s[d:], strict=True))) for d, (n, s) in _totals(vectors, _halves, np.int64).items()}
    blank = np.zeros(0)
    means = sc.broadcast({d: Fit(n, s, blank, blank, blank) for d, (n, s) in sums.items()})

    def outer(d: int, x: np.ndarray) -> np.ndarray:
        c = means.value[d].centred(x)
        return (c.T @ c).ravel()

    fits = {}
    for d, (n, products) in _totals(vectors, outer, np.float64).items():
        v = products.reshape(d, d) / n
        values, axes = np.linalg.eigh((v + v.T) / 2)
        k = min(components, d)
        values, axes, trace = values[::-1][:k], axes[:, ::-1][:, :k], float(np.trace(v))
        fits[d] = Fit(n, sums[d][1], axes, values, values / trace if trace > 0 else np.full(k, np.nan))
    known = sc.broadcast(fits)

    def after(d: int, x: np.ndarray) -> np.ndarray:
        f = known.value[d]
        w = f.whitened(x)[:, f.sound()]
        return (w.T @ w).ravel()

    out = {}
    for d, (n, products) in _totals(vectors, after, np.float64).items():
        k = int(fits[d].sound().sum())
        error = float(np.abs(products.reshape(k, k) / n - np.eye(k)).max()) if k else None
        out[d] = Fit(n, fits[d].sums, fits[d].axes, fits[d].values, fits[d].explained, error)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped; null
    and repeated ids stay, each row a vector.  A vector with d entries has min(d,
    components) rows.  whitened is null for components whose variance is not above
    rounding (fewer vectors than entries, or equal ones), explained if there is no
    variance at all, deviation if a long can't hold it.  Other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, BATCH_ROWS)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(finite_vector(v) & (F.size(v) > 0)).select(F.col(id_col).alias("id"), v.alias("vector"))
    fits = spark.sparkContext.broadcast(fit(rows, components))
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch) if batch.num_rows else ():
                f = fits.value[x.shape[1]]
                w, k, m = f.whitened(x), len(f.values), len(at)
                again = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(at[again])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)), pa.array(f.deviation(x), pa.int64()).take(pa.array(again)),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(f.explained, m), from_pandas=True), pa.array([f.identity_error] * (m * k), pa.float64()),
                ], names=names)

    kind = vectors.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
