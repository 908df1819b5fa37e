"""Near-duplicate join on word shingles with PartEnum signatures.

Stages, each linear in the text but for the last, which sees only groups of
documents that share signatures:

1. Texts become sets of shingle hashes, of which 48 bits travel.  Equal sets are
   one class.
2. Shingles meet in hash partitions; those of a single class are dropped, since
   no intersection holds them.  A class left with under the threshold's share
   of its shingles can't link with another class and is dropped.  A shingle that
   several classes of one batch hold is known to be shared: only a mark of it is
   sent to its partition, so a frequent shingle gathers a mark a batch there.
3. PartEnum: for each band of sizes the domain is cut into n1 parts of n2 parts;
   all subsets of n2 - k2 parts of each are signatures.  Two sets over the
   threshold differ in at most k elements and so agree on a signature.  Empty
   projections give none; a set for which this could lose a partner (too many
   empty parts) also emits the tokens of an exact prefix filter, under which
   two such sets meet.
4. A bucket's smallest member, its pivot, stands for it; from here on buckets are
   gone and only pairs (pivot, class) are kept.  Each class is compared with the
   pivot that it shares most buckets with; exact intersections make links, links
   make components.  Two classes of one bucket share a pivot.  So the classes of a
   pivot that has classes of several components compare across them: those outside
   the group's largest component with all of it.  Small groups do so in batches of
   groups, larger ones in blocks of a bounded number of classes; no pairs are made.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import components, dealt_again, materialize, slices, small_batches
from upkeep.llm.shingles import mix, shingle_sets, text_bytes

_U = np.uint64
_BITS = _U((1 << 48) - 1)
FLUSH = 500_000
#: Bytes of text for one partition of the shingles' and the classes' domains.
PART_BYTES = 16 << 20
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 2_000_000
#: Rows that travel: documents, shingles of one class of a batch, shingles known to be shared, marks of those, sizes of classes.
DOCS, LONE, SHARED, MARKS, SIZES = range(5)
_RUNS = pa.schema([("p", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
_RUNS_DDL = "p int, kind byte, blob binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("elements", pa.list_(pa.int64()))])
_OUT_DDL = "doc_id long, n long, cls long, elements array<long>"
_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _six(h: np.ndarray) -> bytes:
    """Hashes of 48 bits, six bytes each."""
    return h.astype(np.uint32).tobytes() + (h >> _U(32)).astype(np.uint16).tobytes()


def _of_six(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.frombuffer(blob, np.uint32, n, at).astype(np.uint64) | np.frombuffer(blob, np.uint16, n, at + 4 * n).astype(np.uint64) << _U(32)


def _pack(cls: np.ndarray, count: np.ndarray, h: np.ndarray) -> bytes:
    """Runs of classes' shingle hashes; counts in the least width that holds them."""
    code = int(count.max(initial=0) > 0xFF) + int(count.max(initial=0) > 0xFFFF)
    return np.array([len(cls), code], np.int32).tobytes() + cls.astype(np.int64).tobytes() + count.astype(_WIDTHS[code]).tobytes() + _six(h)


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class and shingle hash of each element, filled into arrays of the size that they need."""
    counts = []
    for b in blobs:
        k, code = np.frombuffer(b, np.int32, 2).tolist()
        counts.append(np.frombuffer(b, _WIDTHS[code], k, 8 + 8 * k))
    ends = np.cumsum([0, *(int(c.sum()) for c in counts)]).tolist()
    cls, h = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.uint64)
    for b, count, lo, hi in zip(blobs, counts, ends, ends[1:], strict=False):
        cls[lo:hi] = np.repeat(np.frombuffer(b, np.int64, len(count), 8), count)
        h[lo:hi] = _of_six(b, hi - lo, 8 + 8 * len(count) + count.nbytes)
    return cls, h


def _deal(part: np.ndarray, cls: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs by part, of elements whose classes come in runs."""
    if not len(h):
        return
    order = np.argsort(part, kind="stable")
    part, cls, h = part[order], cls[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (cls[1:] != cls[:-1]))))
    count = np.diff(np.append(new, len(h)))
    at = np.flatnonzero(np.concatenate(([True], part[new][1:] != part[new][:-1])))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(new)], strict=True):
        lo, hi = new[a], new[b] if b < len(new) else len(h)
        yield int(part[lo]), _pack(cls[new[a:b]], count[a:b], h[lo:hi])


def _deal_rows(part: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
    for lo, hi in zip(at, [*at[1:], len(part)], strict=True):
        yield int(part[lo]), rows[lo:hi]


def _home(cls: np.ndarray, parts: int) -> np.ndarray:
    return (cls.astype(np.uint64) % _U(parts)).astype(np.int32)


def _flushed(held: list[tuple[int, int, np.ndarray]], docs: list[tuple[int, int, int]], parts: int) -> pa.RecordBatch:
    out = []
    if held:
        cls = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[2]) for x in held])
        h = np.concatenate([x[2] for x in held])
        order = np.argsort(h, kind="stable")
        again = h[order][1:] == h[order][:-1]
        many = np.zeros(len(h), bool)
        many[order] = np.concatenate((again, [False])) | np.concatenate(([False], again))
        out += [(p, LONE, b) for p, b in _deal((h[~many] % _U(parts)).astype(np.int32), cls[~many], h[~many])]
        out += [(p, SHARED, b) for p, b in _deal(_home(cls[many], parts), cls[many], h[many])]
        marks = np.unique(h[many])
        out += [(p, MARKS, _six(x)) for p, x in _deal_rows((marks % _U(parts)).astype(np.int32), marks)]
        sizes = np.array([x[:2] for x in held], np.int64)
        out += [(p, SIZES, x.tobytes()) for p, x in _deal_rows(_home(sizes[:, 0], parts), sizes)]
    if docs:
        d = np.array(docs, np.int64)
        out += [(p, DOCS, x.tobytes()) for p, x in _deal_rows((d[:, 0] % parts).astype(np.int32), d)]
    return pa.RecordBatch.from_pylist([dict(zip(_RUNS.names, x, strict=True)) for x in out], schema=_RUNS)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Class, size and 48-bit hashes of each text's set; size and class come from 64-bit hashes."""
    for s in shingle_sets(*text_bytes(column), width):
        h = np.sort(s & _BITS)
        yield int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True), len(s), h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _shingle_batches(id_col: str, text_col: str, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # classes sent, up to a million; in any case those of this flush
        held, docs, size = [], [], 0
        for batch in slices(batches, text_col):
            for i, (cls, n, h) in zip(batch.column(id_col).to_pylist(), _sets(batch.column(text_col), width), strict=True):
                docs.append((i, n, cls))
                if n > 2 and cls not in done:  # one or two shingles link with equal sets only
                    done.add(cls)
                    held.append((cls, n, h))
                    size += len(h)
            if size >= FLUSH or len(docs) >= FLUSH:
                yield _flushed(held, docs, parts)
                held, docs, size = [], [], 0
                if len(done) > 1_000_000:
                    done.clear()
        yield _flushed(held, docs, parts)

    return run


def _class_batches(width: int):
    """(id, n, cls): size and class of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [*_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[1] for x in sets], pa.int64()), pa.array([x[0] for x in sets], pa.int64())], names=["id", "n", "cls"])

    return run


def _by_kind(table: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {k: [] for k in (DOCS, LONE, SHARED, MARKS, SIZES)}
    for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        out[k].append(b)
    return out


def _held(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted pool."""
    if not len(pool):
        return np.zeros(len(x), bool)
    return pool[np.minimum(np.searchsorted(pool, x), len(pool) - 1)] == x


def _shared_shingles(parts: int):
    """Of one part of the domain, the shingles of two classes or more, dealt by class; what is for the classes' part goes on."""

    def run(table: pa.Table) -> pa.Table:
        blobs = _by_kind(table)
        cls, h = _unpack(blobs.pop(LONE))
        marks = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_of_six(b, len(b) // 6) for b in blobs[MARKS])]))
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        same = sorted_h[1:] == sorted_h[:-1]
        del sorted_h
        many = _held(h, marks)
        many[order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(h) else order] = True
        del order, same
        cls, h = cls[many], h[many]
        order = np.lexsort((cls, h))
        cls, h = cls[order], h[order]
        if len(h):
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])))
            cls, h = cls[fresh], h[fresh]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(start, len(h)))
            keep = np.repeat(count > 1, count) | _held(h, marks)
            order = np.argsort(cls[keep], kind="stable")
            cls, h = cls[keep][order], h[keep][order]
        here = int(table.column("p")[0].as_py())
        out = [(here, k, b) for k in (DOCS, SHARED, SIZES) for b in blobs[k]]
        out += [(p, SHARED, b) for p, b in _deal(_home(cls, parts), cls, h)]
        return pa.Table.from_pylist([dict(zip(_RUNS.names, x, strict=True)) for x in out], schema=_RUNS)

    return run


def _survivors(percent: int):
    """Rows of documents, and of the classes with enough shared shingles."""

    def run(table: pa.Table) -> pa.Table:
        blobs = _by_kind(table)
        d, sizes = (np.concatenate([np.zeros((0, w), np.int64), *(np.frombuffer(b, np.int64).reshape(-1, w) for b in blobs[k])]) for k, w in ((DOCS, 3), (SIZES, 2)))
        known, first = np.unique(sizes[:, 0], return_index=True)
        cls, h = _unpack(blobs[SHARED])
        order = np.lexsort((h, cls))
        cls, h = cls[order], h[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]))) if len(h) else np.zeros(0, bool)
        cls, h = cls[fresh], h[fresh]
        at = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))) if len(cls) else np.zeros(0, int)
        size = np.diff(np.append(at, len(cls)))
        n = sizes[first[np.searchsorted(known, cls[at])], 1]
        keep = np.flatnonzero(100 * size >= percent * n)
        elements = [None] * len(d) + [h[at[i] : at[i] + size[i]].astype(np.int64) for i in keep.tolist()]
        doc_id = pa.array([*d[:, 0].tolist(), *[None] * len(keep)], pa.int64())
        return pa.Table.from_arrays([doc_id, pa.array(np.concatenate((d[:, 1], n[keep])), pa.int64()), pa.array(np.concatenate((d[:, 2], cls[at][keep])), pa.int64()), pa.array(elements, pa.list_(pa.int64()))], schema=_OUT)

    return run


@lru_cache(None)
def bands(percent: int, largest: int) -> list[tuple[int, int, int, int, int, int]]:
    """(lowest size, highest size, k, n1, n2, k2) of the bands up to a size.

    A pair is compared in the band of its larger set; k bounds how many elements
    the two sets differ in.  n1 has a tenth more parts than needed, for empty ones.
    """
    out, below = [], 2
    while below < largest:
        top = max(below + 2, below * 178 // 100)
        k = 2 * top * (100 - percent) // (100 + percent)
        n1, n2, k2 = (1, k + 2, k) if k <= 3 else (-(-(k + 1) // 2) + 1 + k // 20, 3, 1)
        out.append((-(-percent * (below + 1) // 100), top, k, n1, n2, k2))
        below = top
    return out


def signatures(elements: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The 64-bit signatures of a set of ``n`` shingles of which ``elements`` are shared."""
    m, e = len(elements), elements.astype(np.uint64)
    out, unsafe = [], False
    value = mix(e + _U(0x5851F42D4C957F2D))
    for low, top, _, n1, n2, k2 in bands(percent, m * 100 // percent + 2):
        if not low <= m <= top:
            continue
        where = mix(e ^ _U(top * 0x632BE5AB))
        cell = (where % _U(n1)).astype(np.int64) * n2 + ((where >> _U(40)) % _U(n2)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1])))
        total, full = np.zeros(n1 * n2, np.uint64), np.zeros(n1 * n2, bool)
        total[cell[order][at]] = np.add.reduceat(value[order], at)
        full[cell[order][at]] = True
        total, full = total.reshape(n1, n2), full.reshape(n1, n2)
        for s, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
            i = np.flatnonzero(full[:, subset].any(axis=1))
            out.append(mix(total[i][:, subset].sum(axis=1, dtype=np.uint64) ^ mix(i.astype(np.uint64) * _U(64) + _U(s) + _U(top << 32))))
        k = (m + min(top, m * 100 // percent)) * (100 - percent) // (100 + percent)  # of this set with any partner
        if n1 == 1:
            unsafe |= int(full.sum()) <= k
        else:
            unsafe |= n1 - k // (k2 + 1) - int((full.sum(axis=1) <= k2).sum()) < 1
    if unsafe:
        out.append(mix(np.sort(e)[: m - -(-percent * n // 100) + 1] ^ _U(0xD6E8FEB86659FD93)))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _signature_batches(percent: int):
    schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, cls, size = [], [], 0
            for c, n, e in zip(batch.column("cls").to_pylist(), batch.column("n").to_pylist(), batch.column("elements"), strict=True):
                x = signatures(e.values.to_numpy(zero_copy_only=False), n, percent)
                sig.append(x), cls.append(np.full(len(x), c))
                size += len(x)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(cls))], schema=schema)
                    sig, cls, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(cls))], schema=schema)

    return run


def _plausible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes, and counts of shared shingles, leave room for the threshold."""
    u, v = (sizes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}")) for x in "uv")
    both = F.least("mu", "mv")
    return pairs.join(u, "u").join(v, "v").where(100 * both >= percent * (F.col("nu") + F.col("nv") - both)).drop("nu", "nv", "mu", "mv")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose Jaccard similarity reaches the threshold."""
    left = sets.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("elements").alias("eu"))
    right = sets.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("elements").alias("ev"))
    both = F.size(F.array_intersect("eu", "ev"))
    near = f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"
    return pairs.join(left, "u").join(right, "v").where(near).where(100 * both >= percent * (F.col("nu") + F.col("nv") - both)).select("u", "v")


def _cross_links(cls: np.ndarray, comp: np.ndarray, n: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links of classes at ``left`` with those at ``right`` of other components, as a spanning forest of the components."""
    own = np.repeat(np.arange(len(right)), [len(sets[j]) for j in right])
    flat = np.concatenate([sets[j] for j in right])
    order = np.argsort(flat, kind="stable")
    own, flat = own[order], flat[order]
    up = {int(c): int(c) for c in comp}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in left.tolist():
        a, b = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        size = b - a
        near = own[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())]
        both = np.bincount(near, minlength=len(right))
        for j in right[(100 * both >= percent * (n[i] + n[right] - both)) & (comp[right] != comp[i])].tolist():
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                yield int(cls[i]), int(cls[j])


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    cls, comp, n = (table.column(c).to_numpy() for c in ("cls", "comp", "n"))
    return cls, comp, n, [x.values.to_numpy(zero_copy_only=False) for x in table.column("elements")], table.column("is_left").to_numpy(zero_copy_only=False)


def _links_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=_LINKS)


def _block_links(percent: int):
    """The links of one block: rows of its left with rows of its right."""

    def run(table: pa.Table) -> pa.Table:
        *rows, is_left = _columns(table)
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        return _links_table([*_cross_links(*rows, left, right, percent)] if len(left) and len(right) else [])

    return run


def _batch_links(percent: int):
    """The links of some whole groups: of each pivot, the rows marked left with all."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pivot")
        pivot = table.column("pivot").to_numpy()
        cls, comp, n, sets, is_left = _columns(table)
        edge = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1], [True]))).tolist()
        out = []
        for a, b in zip(edge, edge[1:], strict=False):
            if is_left[a:b].any():
                out += _cross_links(cls[a:b], comp[a:b], n[a:b], sets[a:b], np.flatnonzero(is_left[a:b]), np.arange(b - a), percent)
        return _links_table(out)

    return run


def _blocks(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Links of the classes of large groups, in blocks of bounded size."""
    full = members.join(groups.select("pivot", "largest", "rights", "lefts"), "pivot").join(sets, "cls").withColumn("rest", F.col("comp") != F.col("largest"))
    mine = lambda k: F.pmod(F.xxhash64("cls"), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = full.where("rest").withColumn("l", mine("lefts")).withColumn("r", every("rights")).withColumn("is_left", F.lit(True))
    right = full.withColumn("l", every("lefts")).withColumn("r", mine("rights")).withColumn("is_left", F.lit(False))
    both = left.unionByName(right).select("pivot", "l", "r", "is_left", "cls", "comp", "n", "elements")
    return both.groupBy("pivot", "l", "r").applyInArrow(_block_links(percent), "u long, v long")


def _labelled(pairs: DataFrame, label: DataFrame, key: str) -> DataFrame:
    """pairs with the component of a class, itself where it has no link."""
    of = label.select(F.col("node").alias(key), F.col("component").alias("_c"))
    return pairs.join(of, key, "left").withColumn(f"comp_{key}", F.coalesce("_c", key)).drop("_c")


def _open_links(shared: DataFrame, label: DataFrame, sets: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Links between components among the classes of each pivot (u) that has classes (v) of several."""
    tagged = materialize(_labelled(_labelled(shared.select("u", "v"), label, "u"), label, "v"), "tagged")
    pivots = tagged.where("comp_u != comp_v").select("u", "comp_u").distinct()
    members = tagged.join(dealt_again(pivots.select("u"), "u"), "u", "left_semi").select(F.col("u").alias("pivot"), F.col("v").alias("cls"), F.col("comp_v").alias("comp"))
    members = materialize(members.union(pivots.select("u", "u", "comp_u")), "members")
    comps = members.join(sets.select("cls", F.size("elements").alias("m")), "cls").groupBy("pivot", "comp").agg(F.count("*").alias("k"), F.sum("m").alias("m"))
    groups = comps.groupBy("pivot").agg(F.sum("k").alias("k"), F.sum("m").alias("m"), F.max_by(F.struct("comp", "k", "m"), F.struct("k", "comp")).alias("top"))
    chunks = lambda k, m: F.greatest(F.lit(1), F.ceil(k / block_sets), F.ceil(m / BLOCK_ELEMENTS)).cast("int")
    groups = groups.select("pivot", "k", "m", F.col("top.comp").alias("largest"), chunks(F.col("k"), F.col("m")).alias("rights"), chunks(F.col("k") - F.col("top.k"), F.col("m") - F.col("top.m")).alias("lefts"))
    groups = materialize(groups, "groups")
    one = groups.where("rights = 1")
    size = one.agg(F.sum("k"), F.sum("m")).first()
    batches = max(1, -(-(size[0] or 0) // (4 * block_sets)), -(-(size[1] or 0) // BLOCK_ELEMENTS))
    whole = members.join(one.select("pivot", "largest"), "pivot").join(sets, "cls").select("pivot", "cls", "comp", "n", "elements", (F.col("comp") != F.col("largest")).alias("is_left"))
    whole = whole.groupBy(F.pmod(F.xxhash64("pivot"), F.lit(batches)).alias("batch")).applyInArrow(_batch_links(percent), "u long, v long")
    return whole.union(_blocks(members, groups.where("rights > 1"), sets, percent, block_sets))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, part_bytes: int = PART_BYTES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Components of the documents that link: Jaccard similarity of their shingle sets at least percent / 100.

    Returns (id_col, n_shingles, set_class, component_id); component_id is the
    smallest id reachable by links, the document's own included.  Null and empty
    texts have no shingles and link with nothing.  A text with fewer words than
    ``width`` has its word sequence as its one shingle.  Repeated rows link with
    each other and stay.  Ids are integers; a row with a null id links with nothing
    and has no component.  Other columns are ignored.  ``part_bytes`` and
    ``block_sets`` size the work of a task and don't show in the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // part_bytes)
    alone = rows.where("id is null").mapInArrow(_class_batches(width), "id long, n long, cls long")
    rows = rows.where("id is not null")
    runs = rows.mapInArrow(_shingle_batches("id", "text", width, parts), _RUNS_DDL)
    runs = runs.groupBy("p").applyInArrow(_shared_shingles(parts), _RUNS_DDL)
    both = materialize(runs.groupBy("p").applyInArrow(_survivors(percent), _OUT_DDL), "sets")
    found, sets = both.where("doc_id is not null").drop("elements"), both.where("doc_id is null").drop("doc_id")

    signed = sets.mapInArrow(_signature_batches(percent), "sig long, cls long")
    pivot = signed.groupBy("sig").agg(F.min("cls").alias("u"), F.count("*").alias("m")).where("m > 1").select("sig", "u")
    shared = signed.join(dealt_again(pivot, "sig"), "sig").where("cls != u").groupBy("u", F.col("cls").alias("v")).agg(F.count("*").alias("c"))
    shared = materialize(shared, "shared")
    closest = _plausible(shared, sets.select("cls", "n", F.size("elements").alias("m")), percent).groupBy("v").agg(F.max_by("u", F.struct("c", "u")).alias("u"))
    label = components(_linked(closest.select("u", "v"), sets, percent))
    links = label.select(F.col("node").alias("u"), F.col("component").alias("v"))
    label = components(links.union(_open_links(shared, label, sets, percent, block_sets)))

    first = _labelled(found.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first")), label, "cls")
    low = first.groupBy("comp_cls").agg(F.min("first").alias("low"))
    of_class = first.join(dealt_again(low, "comp_cls"), "comp_cls").select("cls", "low")
    out = found.join(of_class, "cls", "left").select("doc_id", "n", "cls", "low")
    out = out.union(alone.select("id", "n", "cls", F.lit(None).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("set_class"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))
