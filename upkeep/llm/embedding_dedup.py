"""Near copies of embeddings by sorted projection passes.

A pass gives each vector a key of concatenated random hashes, the sides of random
planes on which it lies, and orders the vectors of a label lexicographically by it.
Each vector is compared with the WINDOW ones that follow.  Near vectors share long
prefixes, so a pass brings a pair into one window with a chance that falls with the
number of vectors; passes are as many as keep the chance that all miss a pair at the
threshold below MISS.  A task hands on a spanning forest of the verified pairs it saw,
not the pairs, and these forests are united across passes.

Windows are bounded, groups are not.  So links are counted afterwards, within each
group whole: its vectors are dealt into rings by their angle to one of them, only the
same ring and the next can hold a link, and rings are compared in blocks.  Equal
vectors are one vector with a weight throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.llm.common import components, dealt_again, finite_vector, materialize, partitions, small_batches

COSINE = 0.98
WINDOW = 128
BITS = 62
#: Accepted chance that no pass sees a pair at the threshold, and bits by which cells may be fuller than even ones.
MISS, SLACK_BITS = 1e-4, 2
PASSES_AT_ONCE = 4
TASK_BYTES = 16 << 20
BLOCK, STEP = 1024, 256
BATCH_ROWS = 1024


def passes_for(most: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with a chance below ``miss``, among ``most`` vectors."""
    depth = max(0.0, math.log2(max(1, most) / window)) + SLACK_BITS
    seen = (1 - math.acos(cosine) / math.pi) ** depth
    return math.ceil(math.log(miss) / math.log1p(-seen))


def _units(column: pa.Array, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) of each length."""
    values = column.to_pylist()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.frombuffer(b"".join([values[i] for i in at]), float).reshape(len(at), d)


def _as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column vector as d and unit, its bytes in double precision."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("vector")
        values, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(vectors.offsets.to_numpy())
        units = []
        for x in np.split(values, np.cumsum(sizes)[:-1]):
            x = x / np.abs(x).max()  # squares of very large or small entries stay in range
            units.append((x / np.sqrt(x @ x)).tobytes())
        rest = [n for n in batch.schema.names if n != "vector"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(sizes, pa.int32()), pa.array(units, pa.binary())], names=[*rest, "d", "unit"])


def _keyed(passes: range, seed: int):
    """A row for each vector and pass, with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for at, u in _units(batch.column("unit"), sizes) if batch.num_rows else ():
                for p in passes:
                    planes = np.random.default_rng((seed, p, u.shape[1])).standard_normal((u.shape[1], BITS))
                    key = (u @ planes > 0).astype(np.int64) @ weights
                    some = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), some.column("label"), some.column("d"), pa.array(key), some.column("cls"), some.column("unit")], names=["pass", "label", "d", "key", "cls", "unit"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that links lead to, for each of n places."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _forest(rows: pa.Table, cosine: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the near pairs within a window of rows in order."""
    n = len(rows)
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    change = np.zeros(n, bool)
    for c in (label, rows.column("pass").to_numpy(), rows.column("d").to_numpy()):
        change[1:] |= c[1:] != c[:-1]
    begin = np.concatenate([[0], np.flatnonzero(change), [n]])
    cls, units = rows.column("cls").to_numpy(), rows.column("unit").to_pylist()
    us, vs = [], []
    for lo, hi in zip(begin[:-1], begin[1:], strict=True):
        if hi - lo < 2:
            continue
        u = np.frombuffer(b"".join(units[lo:hi]), float).reshape(hi - lo, -1)
        left, right = [], []
        for a in range(0, len(u), STEP):
            i, j = np.nonzero(u[a : a + STEP] @ u[a : a + STEP + window].T >= cosine)
            near = (j > i) & (j - i <= window)
            left.append(i[near] + a)
            right.append(j[near] + a)
        root = _roots(len(u), np.concatenate(left), np.concatenate(right))
        found = np.flatnonzero(root != np.arange(len(u)))
        us.append(cls[lo + root[found]])
        vs.append(cls[lo + found])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


_SEEN = ["edge", "side", "place", "u", "v", "pass", "label", "d", "cls", "unit"]


def _windows(cosine: float, window: int):
    """Links within a sorted partition, batch by batch, and the rows at its ends, which the next and the last one need."""

    def out(kinds: pa.Schema, n: int, **columns) -> pa.RecordBatch:
        types = {"edge": pa.int32(), "side": pa.int32(), "place": pa.int32(), "u": pa.int64(), "v": pa.int64(), "pass": pa.int32(), "label": kinds.field("label").type, "d": pa.int32(), "cls": pa.int64(), "unit": pa.binary()}
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], types[c]) if c in columns else pa.nulls(n, types[c]) for c in _SEEN], names=_SEEN)

    def ends(rows: pa.Table, edge: int, side: int) -> pa.RecordBatch:
        own = {c: rows.column(c).combine_chunks() for c in ("pass", "label", "d", "cls", "unit")}
        return out(rows.schema, len(rows), edge=np.full(len(rows), edge), side=np.full(len(rows), side), place=np.arange(len(rows)), **own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, head = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if head < window:  # the next rows of the head go with the same boundary
                first = ends(now.slice(0, window - head), part, 1)
                yield first.set_column(2, "place", pa.array(first.column("place").to_numpy() + head, pa.int32()))
                head += len(first)
            both = now if before is None else pa.concat_tables([before, now])
            u, v = _forest(both, cosine, window)
            if len(u):
                yield out(now.schema, len(u), u=u, v=v)
            before = both.slice(max(0, len(both) - window))
        if before is not None:
            yield ends(before, part + 1, 0)

    return run


def _across(cosine: float, window: int):
    """Links between the last rows of a partition and the first of the next."""

    def run(rows: pa.Table) -> pa.Table:
        u, v = _forest(rows.sort_by([("side", "ascending"), ("place", "ascending")]), cosine, window)
        return pa.table({"u": u, "v": v})

    return run


def _passes(classes: DataFrame, passes: range, parts: int, cosine: float, window: int, seed: int) -> DataFrame:
    """Forest edges (u, v) of some passes."""
    label = classes.schema["label"].dataType.simpleString()
    order = ["pass", "label", "d", "key", "cls"]
    keyed = classes.select("label", "d", "cls", "unit").mapInArrow(_keyed(passes, seed), f"pass int, label {label}, d int, key long, cls long, unit binary")
    rows = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    seen = materialize(rows.mapInArrow(_windows(cosine, window), f"edge int, side int, place int, u long, v long, pass int, label {label}, d int, cls long, unit binary"), "windows")
    across = seen.where("edge IS NOT NULL").groupBy("edge").applyInArrow(_across(cosine, window), "u long, v long")
    return seen.where("edge IS NULL").select("u", "v").union(across)


def _ring(width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, pivots, ring = batch.column("d").to_numpy(), batch.column("pivot"), np.zeros(batch.num_rows, np.int32)
            for (at, u), (_, p) in zip(_units(batch.column("unit"), sizes), _units(pivots, sizes), strict=True):
                ring[at] = np.floor(np.arccos(np.clip((u * p).sum(axis=1), -1, 1)) / width)
            yield batch.drop_columns(["pivot"]).append_column("ring", pa.array(ring))

    return run


def _count(cosine: float):
    """Weights of the links of each vector within pairs of blocks."""

    def run(rows: pa.Table) -> pa.Table:
        keys = ["component", "r", "s", "step", "t"]
        rows = rows.sort_by([(k, "ascending") for k in [*keys, "side"]])
        change = np.zeros(len(rows), bool)
        for k in keys:
            c = rows.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        begin = np.concatenate([[0], np.flatnonzero(change), [len(rows)]])
        cls, n, side = (rows.column(c).to_numpy() for c in ("cls", "n", "side"))
        units, links = rows.column("unit").to_pylist(), np.zeros(len(rows), np.int64)
        for lo, hi in zip(begin[:-1], begin[1:], strict=True):
            u = np.frombuffer(b"".join(units[lo:hi]), float).reshape(hi - lo, -1)
            cut = lo + int(np.searchsorted(side[lo:hi], 1))
            if side[lo] == 2:  # a block with itself
                near = u @ u.T >= cosine
                np.fill_diagonal(near, False)
                links[lo:hi] = near @ n[lo:hi]
            elif lo < cut < hi:
                near = u[: cut - lo] @ u[cut - lo :].T >= cosine
                links[lo:cut], links[cut:hi] = near @ n[cut:hi], near.T @ n[lo:cut]
        return pa.table({"cls": cls, "links": links})

    return run


def _links(members: DataFrame, cosine: float, width: int) -> DataFrame:
    """(cls, links): linked vectors by weight, counted whole within each component; width: bytes of the longest vector.

    A component's blocks meet in pairs, each pair in one task with at most two blocks.
    """
    pivot = members.where("cls = component").select("component", F.col("unit").alias("pivot"))
    angle = math.acos(cosine) * 1.000001 + 1e-6  # rounding of angles can't part a link by two rings
    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in ("component", "cls", "n", "d", "unit"))
    placed = members.select("component", "cls", "n", "d", "unit").join(pivot, "component").select("component", "cls", "n", "d", "unit", "pivot")
    placed = materialize(placed.mapInArrow(_ring(angle), f"{kinds}, ring int"), "rings")

    near = Window.partitionBy("component").orderBy("ring")  # a row for each ring, at most pi / angle + 1
    sizes = placed.groupBy("component", "ring").agg(F.count("*").alias("rows")).withColumn("m", F.ceil(F.col("rows") / BLOCK).cast("int"))
    beside = lambda f, by: F.coalesce(F.when(f("ring").over(near) == F.col("ring") + by, f("m").over(near)), F.lit(0))
    sizes = materialize(sizes.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)}), "ring-sizes")
    total = sizes.agg(F.sum(F.col("rows") * (F.col("m") + F.col("before") + F.col("after")))).first()[0] or 0
    tasks = max(partitions(members.sparkSession), -(-total * width // TASK_BYTES))

    def pairs(first, last, r, s, step, t, side):
        """A block's pairs with the blocks first..last of a ring; s and t of the pair by the other's number."""
        one = lambda k: F.struct(r.alias("r"), s(k).alias("s"), F.lit(step).alias("step"), t(k).alias("t"), side(k).alias("side"))
        return F.when(first <= last, F.transform(F.sequence(first, last), one)).otherwise(F.array().cast("array<struct<r:int,s:int,step:int,t:int,side:int>>"))

    ring, s, zero = F.col("ring"), F.col("s0"), F.lit(0)
    left, right, own, other = (lambda k: F.lit(0)), (lambda k: F.lit(1)), (lambda k: s), (lambda k: k)
    each = F.concat(
        pairs(s, F.col("m") - 1, ring, own, 0, other, lambda k: F.when(k == s, 2).otherwise(0)), pairs(zero, s - 1, ring, other, 0, own, right),
        pairs(zero, F.col("after") - 1, ring, own, 1, other, left), pairs(zero, F.col("before") - 1, ring - 1, other, 1, own, right),
    )
    rows = placed.join(sizes, ["component", "ring"]).withColumn("s0", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int"))
    rows = rows.select("component", "cls", "n", "unit", F.inline(each)).withColumn("task", F.pmod(F.xxhash64("component", "r", "s", "step", "t"), F.lit(tasks)))
    found = rows.groupBy("task").applyInArrow(_count(cosine), "cls long, links long")
    return found.groupBy("cls").agg(F.sum("links").alias("links"))


def near_copies(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", window: int = WINDOW, miss: float = MISS, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) of each row: vectors of one label and length link at a cosine of at least ``cosine``.

    n_links counts other rows, equal vectors too; component_id is the smallest id that
    links lead to; kept where it is the row's own.  Rows without label, and vectors
    that are null, zero or hold null or non-finite entries link with nothing.  Repeated
    rows are vectors each, and keep the same verdict.  A null id is never smallest and
    never kept.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, BATCH_ROWS)
    v = F.col(vector_col).cast("array<double>")
    fine = finite_vector(v) & F.exists(v, lambda e: e != 0) & F.col(label_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector"), F.when(fine, F.unhex(F.sha2(v.cast("string"), 256))).alias("digest"))
    rows = rows.withColumn("h", F.xxhash64("label", "digest"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    classes = rows.where("digest IS NOT NULL").groupBy("h", "label", "digest").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    classes = classes.mapInArrow(_as_units, f"h long, label {kind['label']}, digest binary, least {kind['id']}, n long, d int, unit binary")
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    most = classes.groupBy("label", "d").agg(F.count("*").alias("c")).agg(F.max("c").alias("c"), F.sum("c").alias("n"), F.max("d").alias("d")).first()
    edges = spark.createDataFrame([], "u long, v long")
    rounds = passes_for(most.c, cosine, window, miss) if most.n else 0
    for k in range(0, rounds, PASSES_AT_ONCE):
        some = range(k, min(k + PASSES_AT_ONCE, rounds))
        parts = max(1, -(-most.n * len(some) * most.d * 8 // TASK_BYTES))
        edges = edges.union(_passes(classes, some, parts, cosine, window, seed))
    grouped = components(edges, "near")
    members = materialize(classes.select("cls", "least", "n", "d", "unit").join(grouped.withColumnRenamed("node", "cls"), "cls"), "members")
    smallest = members.groupBy("component").agg(F.min("least").alias("smallest"))
    links = _links(members, cosine, 8 * (most.d or 1)) if rounds else spark.createDataFrame([], "cls long, links long")
    known = members.select("cls", "component").join(dealt_again(smallest, "component"), "component").join(links, "cls").select("cls", "smallest", "links")
    out = classes.select("cls", "h", "label", "digest", "least", "n").join(known, "cls", "left")
    out = materialize(out.select("h", "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("smallest")), "verdicts")
    both = rows.select("id", "label", "digest", "h").join(out, ["h", "label", "digest"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("smallest"))
    both = both.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return both.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
