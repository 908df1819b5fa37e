"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A document is its token ids and an end id; longer ones are cut into full pieces,
of which the first may be shorter.  Full pieces are sequences of their own.  The
others are dealt into blocks of a bounded size.  Best fit in decreasing order is a
block's first grouping; its sequences that are full stay as they are, but for some of
the last ones.  The rest is evolved by several islands, each a population of
groupings.  Crossover injects well-filled bins of one parent into another, removes
the bins that hold duplicates, and best-fits the displaced documents, after trading
them for smaller ones where that fills a bin better.  After each epoch the islands'
elites migrate to the next island.  The bins that stay badly filled are dissolved,
and their documents meet in fewer blocks at the next level.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import materialize, slices, small_batches

BLOCK = 16_384
ISLANDS, EPOCHS, POPULATION, CROSSINGS = 4, 3, 10, 150
#: Full sequences that evolve with the others; items times crossings of an island's epoch.
MIXED, WORK = 64, 150_000
LEVELS = 3
_tokenizers: dict[str, tiktoken.Encoding] = {}


def _tokenizer(ranks: str, pattern: str) -> tiktoken.Encoding:
    if ranks not in _tokenizers:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _tokenizers[ranks] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
    return _tokenizers[ranks]


def token_pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) of each document's pieces.

    ranks, pattern: a byte-level BPE as tiktoken's ranks and its splitting pattern;
    the literal <|endoftext|> is its special token, as in the tokenizers library.
    Null text counts as empty: one piece that holds the end id alone.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokenizer(ranks, pattern)
        for batch in slices(batches, "text"):
            rows = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = t or ""
                ids = enc.encode(t, allowed_special="all") if "<|endoftext|>" in t else enc.encode_ordinary(t)
                ids = np.array([*ids, end_id], "<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    rows.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int32)] if with_ids else [])))
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def best_fit(items: np.ndarray, size: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put items into the fullest bins that hold them, in the given order; new bins go to the end of fill."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fill):
        if 0 < f < capacity:
            free[capacity - f].append(b)
            mask |= 1 << (capacity - f)
    empty = [b for b, f in enumerate(fill) if f == 0]
    length = size[items].tolist()
    for i, s in zip(items.tolist(), length, strict=True):
        above = mask >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room = capacity
            if empty:
                b = empty.pop()
            else:
                b = len(fill)
                fill.append(0)
        bins[i] = b
        fill[b] += s
        if room > s:
            free[room - s].append(b)
            mask |= 1 << (room - s)


def _fitness(fill: np.ndarray, capacity: int) -> float:
    """Fewer bins first; then some of them full rather than all of them half full."""
    used = fill[fill > 0]
    return float(((used / capacity) ** 2).mean() / 2) - len(used) if len(used) else 0.0


def decreasing(size: np.ndarray, capacity: int) -> np.ndarray:
    """The bins of best fit in decreasing order."""
    bins = np.full(len(size), -1)
    best_fit(np.argsort(-size, kind="stable"), size, bins, [], capacity)
    return bins


def _trade(loose: np.ndarray, size: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Puts loose items where smaller ones are if that fills a bin better; returns what is loose then."""
    placed = bins >= 0
    fill = np.bincount(bins[placed], size[placed]).astype(int)
    room = np.where(placed, capacity - fill[bins], -1)
    out = []
    for i in loose.tolist():
        more = size[i] - size
        more[(more > room) | (room < 0)] = 0
        j = int(more.argmax())
        if more[j] <= 0:
            out.append(i)
            continue
        b = bins[j]
        bins[i], bins[j] = b, -1
        left = room[j] - more[j]
        room[bins == b], room[j] = left, -1
        out.append(j)
    return np.array(out, int)


def _settle(child: np.ndarray, loose: np.ndarray, size: np.ndarray, capacity: int, bins: int) -> np.ndarray:
    """Trades the loose items, best-fits what is left and numbers the bins anew."""
    loose = _trade(loose[np.argsort(-size[loose], kind="stable")], size, child, capacity)
    kept = child >= 0
    have = np.bincount(child[kept], size[kept], minlength=bins).astype(int).tolist()
    best_fit(loose[np.argsort(-size[loose], kind="stable")], size, child, have, capacity)
    return np.unique(child, return_inverse=True)[1]


def crossover(one: np.ndarray, two: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Bins of ``one`` with well-filled bins of ``two`` injected; bins that hold duplicates go, and their other items are settled."""
    fill = np.bincount(two, size)
    well = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    take = np.zeros(len(fill), bool)
    take[rng.choice(well, max(1, int(len(well) * rng.uniform(0.05, 0.4))), replace=False)] = True
    moved = take[two]
    hit = np.zeros(int(one.max()) + 1, bool)
    hit[one[moved]] = True
    loose = np.flatnonzero(hit[one] & ~moved)
    child = one.copy()
    at = np.cumsum(take) - 1 + len(hit)
    child[moved] = at[two[moved]]
    child[loose] = -1
    return _settle(child, loose, size, capacity, len(hit) + int(take.sum()))


def mutate(one: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``one`` with its worst-filled bin and a few others dissolved and settled."""
    fill = np.bincount(one, size)
    go = np.zeros(len(fill), bool)
    go[fill.argmin()] = True
    go[rng.choice(len(fill), min(len(fill), int(rng.integers(1, 4))), replace=False)] = True
    child, loose = one.copy(), np.flatnonzero(go[one])
    child[loose] = -1
    return _settle(child, loose, size, capacity, len(fill))


def evolve(size: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, crossings: int = CROSSINGS) -> np.ndarray:
    """One epoch of an island from its own elite and those that came to it; ends when no bin more can be saved."""
    rng = np.random.default_rng(seed)
    people = [np.unique(e, return_inverse=True)[1] for e in elites]
    floor = -(-int(size.sum()) // capacity)
    if min(int(p.max()) + 1 for p in people) <= floor:
        return max(people, key=lambda p: _fitness(np.bincount(p, size), capacity))
    while len(people) < POPULATION:
        noise = rng.uniform(0.02, 0.5)
        bins = np.full(len(size), -1)
        best_fit(np.argsort(-(size * (1 + noise * rng.standard_normal(len(size)))), kind="stable"), size, bins, [], capacity)
        people.append(bins)
    score = [_fitness(np.bincount(p, size), capacity) for p in people]
    for _ in range(max(8, min(crossings, WORK // len(size)))):
        if -max(score) <= floor:  # a fitness of n bins lies between -n and -n + 1/2
            break
        a, b = (max(rng.choice(len(people), 2, replace=False).tolist(), key=score.__getitem__) for _ in range(2))
        child = crossover(people[a], people[b], size, capacity, rng) if a != b else mutate(people[a], size, capacity, rng)
        s, worst = _fitness(np.bincount(child, size), capacity), int(np.argmin(score))
        if s > score[worst] and s not in score:
            people[worst], score[worst] = child, s
    return people[int(np.argmax(score))]


_STATE = "block int, island int, rows array<long>, sizes array<int>, bins array<int>, fitness double"


def _first(capacity: int):
    """Best fit of a block; open: rows of bins that evolve."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        size = table.column("size").to_numpy().astype(np.int64)
        bins = decreasing(size, capacity)
        full = np.bincount(bins, size) == capacity
        full[np.flatnonzero(full)[-MIXED:]] = False
        return pa.table({"block": table.column("block"), "bin": pa.array(bins.astype(np.int32)), "row": table.column("row"), "size": pa.array(size.astype(np.int32)), "open": pa.array(~full[bins])})

    return run


def _epoch(capacity: int, epoch: int):
    def run(table: pa.Table) -> pa.Table:
        block, island = int(table.column("block")[0].as_py()), int(table.column("island")[0].as_py())
        size = np.array(table.column("sizes")[0].as_py(), np.int64)
        elites = sorted((np.array(b.as_py(), np.int64) for b in table.column("bins")), key=lambda e: e.tobytes())
        best = evolve(size, elites, capacity, (block * 31 + epoch) * ISLANDS + island)
        return pa.table({"block": pa.array([block], pa.int32()), "island": pa.array([island], pa.int32()), "rows": table.column("rows")[:1], "sizes": table.column("sizes")[:1], "bins": pa.array([best.astype(np.int32)]), "fitness": [_fitness(np.bincount(best, size), capacity)]})

    return run


def _pack_level(items: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """(block, bin, row, size, fill) of one level; items: (row, size)."""
    dealt = items.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", F.col("size").cast("int").alias("size"))
    tasks = lambda n: min(n, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # noqa: E731  a number that Spark keeps: these rows are few bytes and much work
    first = materialize(dealt.repartition(tasks(blocks), "block").groupBy("block").applyInArrow(_first(capacity), "block int, bin int, row long, size int, open boolean"), "first")
    state = first.where("open").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "size", "bin"))).alias("x"))  # of a block's rows at most
    state = state.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.row").alias("rows"), F.col("x.size").alias("sizes"), F.col("x.bin").alias("bins"), F.lit(0.0).alias("fitness"))
    for epoch in range(EPOCHS):
        if epoch:
            state = state.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
        state = state.repartition(tasks(blocks * ISLANDS), "block", "island").groupBy("block", "island").applyInArrow(_epoch(capacity, epoch), _STATE)
    best = state.groupBy("block").agg(F.max_by(F.struct("rows", "sizes", "bins"), F.struct("fitness", -F.col("island"))).alias("s"))
    rows = best.select("block", F.explode(F.arrays_zip("s.rows", "s.sizes", "s.bins")).alias("x"))
    rows = rows.select("block", (F.col("x.bins") + BLOCK).alias("bin"), F.col("x.rows").alias("row"), F.col("x.sizes").alias("size"))
    rows = rows.unionByName(first.where("not open").drop("open"))
    fill = rows.groupBy("block", "bin").agg(F.sum("size").alias("fill"))
    return rows.join(fill, ["block", "bin"])


def pack_sequences(pieces: DataFrame, capacity: int = 1024, length_col: str = "length") -> DataFrame:
    """The rows of pieces with (sequence_id, offset): few sequences of at most ``capacity``, gapless from 0.

    Lengths are 1 to capacity; rows of other lengths and of null length raise an
    error in the job.  Ties are settled by row number.  An empty table gives none.
    Input columns named sequence_id and offset give way to the results.
    """
    spark = pieces.sparkSession
    small_batches(spark)
    length = F.when(F.col(length_col).between(1, capacity), F.col(length_col)).otherwise(F.raise_error(F.lit(f"a piece's length must be 1 to {capacity}")))
    names = [f"c{k}" for k in range(len(pieces.columns))]
    rows = pieces.select("*", length.alias("_size"), F.monotonically_increasing_id().alias("_row")).toDF(*names, "_size", "_row")
    rows = materialize(rows, "pieces")
    whole = rows.where(F.col("_size") == capacity).select("_row", F.col("_row").alias("_s"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("_level"))
    items, placed = rows.where(F.col("_size") < capacity).select(F.col("_row").alias("row"), F.col("_size").alias("size")), []
    count = items.count()
    for level in range(1, LEVELS + 1):
        blocks = max(1, -(-count // BLOCK))
        packed = materialize(_pack_level(items, blocks, capacity), "packed")
        last = blocks == 1 or level == LEVELS
        placed.append(packed.where(F.lit(last) | (F.col("fill") >= capacity - capacity // 256)).withColumn("level", F.lit(level)))
        if last:
            break
        items = packed.where(F.col("fill") < capacity - capacity // 256).select("row", "size")
        count = items.count()
    packed = placed[0]
    for more in placed[1:]:
        packed = packed.unionByName(more)
    bins = packed.groupBy("level", "block", "bin").agg(F.sort_array(F.collect_list(F.struct("row", "size"))).alias("x"))
    starts = F.expr("transform(x, (e, i) -> struct(e.row as row, aggregate(slice(x, 1, i), 0L, (s, y) -> s + y.size) as at))")
    bins = bins.select("level", F.col("x")[0]["row"].alias("_s"), F.explode(starts).alias("y"))
    bins = bins.select(F.col("y.row").alias("_row"), "_s", F.col("y.at").alias("offset"), F.col("level").alias("_level"))
    places = whole.union(bins).select("_row", F.col("_s").alias("sequence_id"), "offset")
    kept = [(n, c) for n, c in zip(names, pieces.columns, strict=True) if c not in ("sequence_id", "offset")]
    return rows.join(places, "_row").select(*(F.col(n).alias(c) for n, c in kept), "sequence_id", "offset")
