"""Maximum inner product search by score-aware (anisotropic) product quantisation.

Codebooks of 16 centres for each group of dimensions are fitted on a bounded
sample.  The loss weighs the part of a vector's residual that is parallel to the
vector more than the rest, since that part moves the inner products that count.
All vectors get four-bit codes.  Queries meet all codes in blocks: table scans of
the codes (two at a time) give the candidates, and exact inner products in double
precision rank them.  The best ``RERANK`` by code set a bar; all others whose code
comes within ``MARGIN`` standard errors of it are ranked exactly too, so a cluster
of near-equal vectors of any size is told apart.  An index block carries its vectors
next to their codes, once for each block of QUERY_BLOCK queries: fetching candidates
by a join instead would move hundreds of vectors a query, which is more until there
are millions of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.llm.common import small_batches

SAMPLE = 4096
GROUP_DIMS = 2
QUERY_BLOCK, INDEX_BLOCK, AT_ONCE = 8192, 32_768, 256
RERANK = 200
MARGIN = 3.0
THRESHOLD = 0.2


@dataclass(frozen=True)
class Codebooks:
    """centres: groups x 16 x dimensions of a group; eta: weight of parallel against other residual."""

    centres: np.ndarray
    eta: float


def _split(x: np.ndarray) -> np.ndarray:
    """Rows as groups x GROUP_DIMS, zero-padded."""
    n, d = x.shape
    groups = -(-d // GROUP_DIMS)
    return np.pad(x, ((0, 0), (0, groups * GROUP_DIMS - d))).reshape(n, groups, GROUP_DIMS)


def encode(x: np.ndarray, books: Codebooks, rounds: int = 3) -> np.ndarray:
    """Codes (rows x groups) by coordinate descent on the anisotropic loss |r|^2 + (eta - 1) <r, x / |x|>^2."""
    g = _split(x.astype(np.float32))
    unit = g / np.maximum(np.linalg.norm(x, axis=1), 1e-30).astype(np.float32)[:, None, None]
    n, groups, _ = g.shape
    c = books.centres.astype(np.float32)
    square = np.empty((n, groups, 16), np.float32)
    along = np.empty((n, groups, 16), np.float32)
    for k in range(groups):
        square[:, k] = (g[:, k] ** 2).sum(1)[:, None] - 2 * g[:, k] @ c[k].T + (c[k] ** 2).sum(1)
        along[:, k] = (g[:, k] * unit[:, k]).sum(1)[:, None] - unit[:, k] @ c[k].T
    code = square.argmin(axis=2)
    row = np.arange(n)
    parallel = along[row[:, None], np.arange(groups), code].sum(axis=1)
    for _ in range(rounds):
        for k in range(groups):
            rest = parallel - along[row, k, code[:, k]]
            loss = square[:, k] + np.float32(books.eta - 1) * (rest[:, None] + along[:, k]) ** 2
            code[:, k] = loss.argmin(axis=1)
            parallel = rest + along[row, k, code[:, k]]
    return code.astype(np.uint8)


def fit_codebooks(x: np.ndarray, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Alternate encoding with the weighted least squares of the centres given the codes."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    g = _split(x)
    groups = g.shape[1]
    picks = rng.integers(0, len(x), (groups, 16))
    centres = np.stack([g[picks[k], k] + 1e-6 * rng.standard_normal((16, GROUP_DIMS)) for k in range(groups)])
    unit = g / np.linalg.norm(x, axis=1)[:, None, None]
    for _ in range(rounds):
        code = encode(x, Codebooks(centres, eta), 1)
        made = centres[np.arange(groups), code]
        parallel = ((g - made) * unit).sum(axis=(1, 2))
        for k in range(groups):
            rest = parallel - ((g[:, k] - made[:, k]) * unit[:, k]).sum(1)
            new = centres[k].copy()
            for j in range(16):
                own = code[:, k] == j
                if own.sum() < 2:
                    new[j] = g[rng.integers(0, len(g)), k]
                    continue
                u, v = unit[own, k], g[own, k]
                a = own.sum() * np.eye(GROUP_DIMS) + (eta - 1) * u.T @ u
                b = v.sum(0) + (eta - 1) * u.T @ (rest[own] + (v * u).sum(1))
                new[j] = np.linalg.solve(a, b)
            centres[k] = new
            made[:, k] = new[code[:, k]]
            parallel = rest + ((g[:, k] - made[:, k]) * unit[:, k]).sum(1)
    return Codebooks(centres, eta)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _encode_batches(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = encode(_matrix(batch.column("vector")).astype(float), books)
                code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
                packed = code[:, 0::2] << 4 | code[:, 1::2]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "vector", "code"])

    return run


def _scan(books: Codebooks, top: int, rerank: int):
    """Top rows of each query of a block among the vectors of an index block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        right = right.sort_by("id")
        q, x = _matrix(left.column("vector")).astype(float), _matrix(right.column("vector")).astype(float)
        qid, xid = left.column("id").to_numpy(), right.column("id").to_numpy()
        first: dict[bytes, int] = {}
        same = np.array([first.setdefault(r.tobytes(), i) for i, r in enumerate(x)])
        one = np.flatnonzero(same == np.arange(len(x)))  # equal vectors are scanned once
        order = np.argsort(same, kind="stable")
        begin = np.searchsorted(same[order], one)
        count = np.diff(np.append(begin, len(x)))
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(right), -1)[one]
        pairs = [np.ascontiguousarray(code[:, k]) for k in range(code.shape[1])]
        centres = np.pad(books.centres, ((0, books.centres.shape[0] % 2), (0, 0), (0, 0)))
        made = centres[np.arange(centres.shape[0])[None], np.stack((code >> 4, code & 15), axis=2).reshape(len(one), -1)].reshape(len(one), -1)[:, : x.shape[1]]
        slack = MARGIN * np.linalg.norm(x[one] - made, axis=1) / np.sqrt(x.shape[1])
        norm = np.linalg.norm(q, axis=1)
        keep = min(len(one), rerank)
        out = []
        for i in range(len(q)):
            if i % AT_ONCE == 0:  # tables of some queries at a time
                some = _split(q[i : i + AT_ONCE])
                table = np.einsum("qgd,gcd->qgc", np.pad(some, ((0, 0), (0, centres.shape[0] - some.shape[1]), (0, 0))), centres).astype(np.float32)
                both = (table[:, 0::2, :, None] + table[:, 1::2, None, :]).reshape(len(some), len(pairs), 256)
            near = both[i % AT_ONCE, 0][pairs[0]]
            for k in range(1, len(pairs)):
                near += both[i % AT_ONCE, k][pairs[k]]
            edge = np.partition(near, len(one) - keep)[len(one) - keep]
            found = np.flatnonzero(near >= edge)
            if len(found) < len(one):
                score = (x[one[found]] * q[i]).sum(axis=1)
                score = np.sort(score[one[found] != same[np.flatnonzero(xid == qid[i])[0]]] if (xid == qid[i]).any() else score)[-top:]
                if len(score) == top:
                    found = np.flatnonzero(near + slack * norm[i] >= score[0])
            score = (x[one[found]] * q[i]).sum(axis=1)
            size = np.minimum(count[found], top + 1)  # of equal vectors the smallest ids, one of which may be the query's
            at = np.repeat(begin[found] - np.cumsum(size) + size, size) + np.arange(size.sum())
            found, score = order[at], np.repeat(score, size)
            score, found = score[xid[found] != qid[i]], found[xid[found] != qid[i]]
            best = np.lexsort((xid[found], -score))[:top]
            out.append((np.full(len(best), qid[i]), xid[found][best], score[best]))
        return pa.table({n: np.concatenate([o[k] for o in out]) for k, n in enumerate(names)})

    return run


def inner_product_search(vectors: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of largest inner product with each query, but those of its own id.

    rank counts from 1; ties go to the smaller id.  Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no part.
    Repeated rows of one id are candidates each; repeated queries are one.  Other
    columns are ignored; an empty table gives no rows.  Codebooks are fitted on
    ``sample`` vectors, those of the smallest hashes.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
        return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))

    pool = clean(vectors)
    size = pool.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return nothing
    pool = pool.where(F.size("vector") == size.d)
    asked = clean(queries).where(F.size("vector") == size.d).dropDuplicates(["id"])
    picked = pool.orderBy(F.xxhash64("id", "vector"), "id").limit(sample).select("vector").toArrow()
    books = fit_codebooks(_matrix(picked.column("vector")))

    index_blocks, query_blocks = -(-size["count"] // INDEX_BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))
    coded = pool.mapInArrow(_encode_batches(books), "id long, vector array<double>, code binary")
    coded = coded.withColumn("ib", F.pmod(F.xxhash64("id", "vector", F.monotonically_increasing_id()), F.lit(index_blocks)).cast("int"))
    coded = coded.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))))
    near = asked.groupBy("qb", "ib").cogroup(coded.groupBy("qb", "ib")).applyInArrow(_scan(books, top, rerank), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
