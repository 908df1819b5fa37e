"""How five document filters interact: what each removes at each place of every order.

Texts are scanned in the buffers that Arrow hands over.  A table gives each byte its
classes (white space, capital, symbol, inner byte of a code point), prefix sums of
the classes give the counts of each document, and words are the runs between white
space.  A word of up to 8 bytes is its own 64-bit number; longer ones are hashed.
Sorted by document and hash, equal words stand side by side; their bytes are compared,
so a clash of hashes is seen and that document counted anew.  Each document is then a
mask of the filters that it fails, and all 120 orders follow from the counts by mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import dealt_again, materialize, slices, small_batches

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Texts beyond these bytes are scanned by parts, cut at white space.
LONG_TEXT = 4 << 20

_SPACE, _CAPITAL, _SYMBOL, _INNER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[list(SYMBOLS)] |= _SYMBOL
_CLASS[0x80:0xC0] |= _INNER
#: The bytes of a 64-bit number that a word of so many bytes fills.
_FILLED = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
_MIX, _HASH_BITS, _CHUNKS = np.uint64(0x9E3779B97F4A7C15), 52, 8


def _words(data: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; a document's end ends its last word."""
    solid = (kind & _SPACE) == 0
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = bounds[:-1] < bounds[1:]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    begin[first], end[last] = solid[first], solid[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Distinct words of each document: sorted hashes, equal ones verified by their bytes."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place
    chunk = lambda at, k: load[begin[at] + 8 * k] & _FILLED[np.minimum(size[at] - 8 * k, 8)]
    everything = np.arange(len(size))
    hashed = chunk(everything, 0) * _MIX + size.astype(np.uint64)
    for k in range(1, _CHUNKS):
        at = np.flatnonzero(size > 8 * k)
        if not len(at):
            break
        mixed = hashed[at]
        hashed[at] = (mixed ^ mixed >> np.uint64(29) ^ chunk(at, k)) * _MIX
    raw = data.tobytes() if (size > 8 * _CHUNKS).any() else b""
    for i in np.flatnonzero(size > 8 * _CHUNKS):  # such words are few a megabyte
        hashed[i] = np.frombuffer(hashlib.blake2b(raw[begin[i] : end[i]], digest_size=8).digest(), np.uint64)[0]
    hashed = (hashed ^ hashed >> np.uint64(32)) * _MIX
    key = owner.astype(np.uint64) << np.uint64(_HASH_BITS) | hashed >> np.uint64(64 - _HASH_BITS)
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    same = key[a] == key[b]
    a, b = a[same], b[same]
    clash = size[a] != size[b]
    for k in range(_CHUNKS):
        at = np.flatnonzero((size[a] > 8 * k) & ~clash)
        if not len(at):
            break
        clash[at] |= chunk(a[at], k) != chunk(b[at], k)
    for i in np.flatnonzero((size[a] > 8 * _CHUNKS) & ~clash):
        clash[i] = raw[begin[a[i]] : end[a[i]]] != raw[begin[b[i]] : end[b[i]]]
    found = np.bincount(owner, minlength=n_docs) - np.bincount(owner[a], minlength=n_docs)
    for d in np.unique(owner[a[clash]]):
        found[d] = len({padded[begin[i] : end[i]].tobytes() for i in np.flatnonzero(owner == d)})
    return found


def _counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of the documents between bounds of a buffer."""
    kind = _CLASS[data]

    def of(flags: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=upto[1:])
        return np.diff(upto[bounds])

    begin, end = _words(data, kind, bounds)
    owner = np.searchsorted(bounds, begin, side="right") - 1
    n_docs = len(bounds) - 1
    return {
        "words": np.bincount(owner, minlength=n_docs), "distinct": _distinct(data, begin, end, owner, n_docs) if len(begin) else np.zeros(n_docs, np.int64),
        "capitals": of(kind & _CAPITAL != 0), "symbols": of(kind & _SYMBOL != 0), "points": of(kind & _INNER == 0),
    }


def _long_counts(data: np.ndarray, part: int) -> dict[str, int]:
    """The counts of one long text, part by part, each cut behind white space; its distinct words are kept as a set."""
    sums, seen, at = dict.fromkeys(("words", "capitals", "symbols", "points"), 0), set(), 0
    space = lambda lo, hi: np.flatnonzero(_CLASS[data[lo:hi]] & _SPACE)
    while at < len(data):
        end = min(at + part, len(data))
        while end < len(data) and not len(cut := space(at, end)):
            end = min(end + part, len(data))
        end = at + int(cut[-1]) + 1 if end < len(data) else end
        one = data[at:end]
        found = _counts(one, np.array([0, len(one)]))
        for k in sums:
            sums[k] += int(found[k][0])
        begin, stop = _words(one, _CLASS[one], np.array([0, len(one)]))
        raw = one.tobytes()
        seen.update(raw[i:j] for i, j in zip(begin.tolist(), stop.tolist(), strict=True))
        at = end
    return {**sums, "distinct": len(seen)}


def text_counts(texts: pa.Array, long_text: int = LONG_TEXT) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each text of an Arrow array without nulls, and its SHA-256."""
    n = len(texts)
    _, ends, raw = texts.buffers()
    bounds = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32, n + 1, texts.offset * (8 if pa.types.is_large_string(texts.type) else 4)).astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    view = memoryview(np.ascontiguousarray(data))
    out = {"digest": [hashlib.sha256(view[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]}
    long = np.flatnonzero(np.diff(bounds) > long_text)
    if not len(long):
        return out | _counts(data, bounds)
    short = np.ones(n, bool)
    short[long] = False
    sizes = np.where(short, np.diff(bounds), 0)
    rest = data[np.repeat(short, np.diff(bounds))]
    found = _counts(rest, np.concatenate([[0], np.cumsum(sizes)]))
    for i in long:
        for k, v in _long_counts(data[bounds[i] : bounds[i + 1]], long_text).items():
            found[k][i] = v
    return out | found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        if batch.num_rows:
            c = text_counts(batch.column("text").fill_null(""))
            fails = (c["words"] < MIN_WORDS, 100 * c["distinct"] < MIN_DISTINCT * c["words"], 100 * c["capitals"] > MAX_CAPITALS * c["points"], c["symbols"] > 0)
            mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(c["digest"], pa.binary())], names=["id", "part", "mask", "digest"])


def _orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of all 120 orders, and by column which masks count there: rows x 32."""
    steps, removed, kept, redundant, only = [], [], [], [], []
    masks = np.arange(32)
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append((order, k + 1))
            removed.append((masks & bit != 0) & (masks & before == 0))
            redundant.append((masks & bit != 0) & (masks & before != 0))
            kept.append(masks & (before | bit) == 0)
            only.append(masks == bit)
            before |= bit
    return steps, {k: np.array(v, np.int64) for k, v in (("kept", kept), ("removed", removed), ("redundant", redundant), ("unique_fails", only))}


_OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _reduce(key: tuple[pa.Scalar, ...], counts: pa.Table) -> pa.Table:
    """The rows of one part from its counts by mask and label, at most 128."""
    steps, hit = _orders()
    n, good, toxic = (np.zeros(32, np.int64) for _ in range(3))
    mask, size = counts.column("mask").to_numpy(), counts.column("n").to_numpy()
    for out, label in ((n, None), (good, "good"), (toxic, "toxic")):
        np.add.at(out, mask, size if label is None else size * counts.column(label).to_numpy(zero_copy_only=False).astype(np.int64))
    found = {k: v @ n for k, v in hit.items()}
    found |= {"good_lost": hit["removed"] @ good, "toxic_lost": hit["removed"] @ toxic}
    letter = np.array([FILTERS.index(order[step - 1]) for order, step in steps])
    total = np.zeros(len(FILTERS), np.int64)
    np.add.at(total, letter, found["removed"])
    found["shapley"] = total[letter]
    part = pa.array([key[0].as_py()] * len(steps), pa.string())
    return pa.table({"part": part, "filter_order": pa.array([o for o, _ in steps]), "step": pa.array([s for _, s in steps], pa.int32()), **{k: pa.array(found[k], pa.int64()) for k in _OUT}})


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of each row; bit k of mask is set if filter k of FILTERS fails the text.

    Null text is empty, null part the empty string.  E fails a text if an equal one
    has a smaller id; rows of one id and text don't fail each other, and a null id is
    neither smaller nor larger than any.  Repeated rows stay; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_scan, f"id {kind}, part string, mask int, digest binary").withColumn("h", F.xxhash64("digest"))
    rows = materialize(rows, "masks")
    first = rows.groupBy("h", "digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("h", "digest", "least")
    repeated = F.coalesce(F.col("least") < F.col("id"), F.lit(False)).cast("int")
    rows = rows.join(dealt_again(first, "h"), ["h", "digest"], "left")
    return rows.select("id", "part", F.col("mask").bitwiseOR(F.shiftleft(repeated, FILTERS.index("E"))).alias("mask"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    labels: id_col, quality, toxic; an id counts as good or toxic if any of its rows
    says so, null labels and ids say nothing.  Null texts, ids and parts as in
    ``failure_masks``.  A part has its 600 rows even where no filter fails; an empty
    table gives none.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"))
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = failure_masks(docs, id_col, text_col, part_col).withColumn("h", F.xxhash64("id")).join(dealt_again(said, "h"), ["h", "id"], "left")
    counts = rows.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))
    return counts.groupBy("part").applyInArrow(_reduce, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _OUT))
