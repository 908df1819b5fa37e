"""BPE encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import slices, small_batches

CACHE_WORDS = 200_000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable, else from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in keep)}
    return [chr(other.get(b, b)) for b in range(256)]


def merge_word(sym: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge symbol ids.  ranks: left << 20 | right to the pair's rank; made: rank to the id of both together.

    A queue entry is rank << 32 | place of the left symbol.  It is stale, and
    skipped, if the pair now at that place has another rank or none.
    """
    n = len(sym)
    if n < 2:
        return sym
    get = ranks.get
    at = [get(a << 20 | b, -1) for a, b in zip(sym, sym[1:])]
    queue = [r << 32 | i for i, r in enumerate(at) if r >= 0]
    if not queue:
        return sym
    heapify(queue)
    at.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        i = entry & 0xFFFFFFFF
        if at[i] != entry >> 32:
            continue
        j = after[i]
        s = sym[i] = made[entry >> 32]
        sym[j] = at[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = at[i] = get(s << 20 | sym[k], -1)
            if r >= 0:
                heappush(queue, r << 32 | i)
        else:
            at[i] = -1
        h = before[i]
        if h >= 0:
            r = at[h] = get(sym[h] << 20 | s, -1)
            if r >= 0:
                heappush(queue, r << 32 | h)
    return [s for s in sym if s >= 0]


class WordBpe:
    """The vocabulary of a tokenizers file with word ends: normalises, splits, encodes and decodes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in merges]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: r for r, (a, b) in reversed([*enumerate(merges)])}
        symbols = byte_symbols()
        self.inner = [self.vocab.get(c, -1) for c in symbols]
        self.last = [self.vocab.get(c + self.end, -1) for c in symbols]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.spaces, self.separators = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.caches: list[dict[str, tuple[bytes, str]]] = [{}, {}, {}, {}]

    def word(self, word: str) -> tuple[bytes, str]:
        """A word's ids as little-endian 32-bit integers, and its tokens joined by spaces."""
        raw = word.encode("utf-8", "replace")
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        ids = merge_word(sym if min(sym) >= 0 else [i for i in sym if i >= 0], self.ranks, self.made)
        return pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])

    def _kept(self, kind: int, key: str, make) -> tuple[bytes, str]:
        """From the two generations of a cache, or made; a full generation replaces the older one."""
        known = self.caches[kind + 1].get(key) or make(key)
        if len(self.caches[kind]) >= CACHE_WORDS:
            self.caches[kind], self.caches[kind + 1] = {}, self.caches[kind]
        self.caches[kind][key] = known
        return known

    def _run(self, chars: str) -> tuple[bytes, str]:
        """What a run of characters without white space gives."""
        words = self.words.findall(chars)
        found = [self.caches[0].get(w) or self._kept(0, w, self.word) for w in words]
        return found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]]))

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """Ids and strings of each run between white space, and of each special token."""
        out: list[tuple[bytes, str]] = []
        marked = "<" in text and self.marks is not None
        for i, part in enumerate(self.marks.split(text) if marked else [text]):
            if i % 2:
                out.append((pack("<I", self.special[part]), part))
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()
            for run in part.split() if not self.separators.search(part) else self.spaces.split(part):
                if run:
                    out.append(self.caches[2].get(run) or self._kept(2, run, self._run))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([p[0] for p in self.pieces(text)]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings; this vocabulary's file names no decoder, so a space stands between them."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


_loaded: dict[str, WordBpe] = {}


def bpe_encode(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    vocabulary: path of the tokenizers file, there on each executor.  outputs, of:
    n_tokens, ids (array of int), decoded, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of UTF-8), both lowercase hex.
    Null text counts as empty and has no ids.  Repeated rows stay; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    make = {
        "n_tokens": lambda raw, dec: len(raw) // 4,
        "ids": lambda raw, dec: np.frombuffer(raw, "<u4").astype(np.int32),
        "decoded": lambda raw, dec: dec,
        "ids_sha256": lambda raw, dec: hashlib.sha256(raw).hexdigest(),
        "decoded_sha256": lambda raw, dec: hashlib.sha256(dec.encode("utf-8", "replace")).hexdigest(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = WordBpe(vocabulary)
        bpe = _loaded[vocabulary]
        for batch in slices(batches, "text"):
            rows: list[list] = [[] for _ in outputs]
            for t in batch.column("text").to_pylist():
                pieces = bpe.pieces(t) if t else []
                raw = b"".join([p[0] for p in pieces])
                dec = " ".join([p[1] for p in pieces if p[0]])
                for out, name in zip(rows, outputs, strict=True):
                    out.append(make[name](raw, dec))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, kinds[name]) for x, name in zip(rows, outputs, strict=True))], names=["id", *outputs])

    sql = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {sql[n]}" for n in outputs)).withColumnRenamed("id", id_col)
