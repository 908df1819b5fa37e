"""Personal data: base patterns, and terms that the corpus shows to reveal protected entities.

Information-theoretic sanitisation.  Protected are the values that the base
patterns find, the kind of each value, and personal data as such.  A term is a
word, or the shape (hexadecimal or not, and length) of a string with digits, since
such strings hardly come twice; what a base span covers is no term.  All counts are
of different whole texts, so copies of a document count once.  The corpus gives, for
each protected c and term t, the number of texts that hold both and the number that
hold t.  t discloses c to the degree p(c | t), so that its pointwise mutual
information with c is log p(c | t) - log p(c), of the -log p(c) that c holds.  Terms
that reach ``disclosure`` are generalised, those that reach ``removal`` are removed,
wherever they stand.  Evidence on one value needs ``min_texts`` different texts.
Evidence on a kind, which many documents hold, needs ``min_class_texts`` and
``min_class_share`` of the texts that hold the kind: so the terms that can be
evidence stay as few as a hundred documents' terms, however large the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import materialize, slices, small_batches

# The base patterns.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "term", "hint")

CLASSES = (*KINDS, "any")  # protected as such: ids 0 to 4 among the entities

TERM = re.compile(r"\w{3,}")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGIT = re.compile(r"\d")
DISCLOSURE, REMOVAL = 0.5, 0.7
MIN_TEXTS, MIN_CLASS_TEXTS, MIN_CLASS_SHARE = 3, 8, 0.01
BROADCAST_TERMS = 1_000_000
FLUSH = 300_000


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; code points, end exclusive."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def term_hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


def _distinct_texts(texts: DataFrame, broadcast_terms: int) -> DataFrame:
    """Each different text once; only texts whose hash comes again are dealt out."""
    keyed = texts.where("text is not null").withColumn("key", F.xxhash64("text"))
    again = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    if again.count() <= broadcast_terms:
        again = F.broadcast(again)
    copies = materialize(keyed.join(again, "key", "left_semi").select("text").distinct(), "copies")
    return keyed.join(again, "key", "left_anti").select("text").unionByName(copies)


def term_of(word: str) -> str:
    """A word in lower case; a string with digits as its shape."""
    if not DIGIT.search(word):
        return word.lower()
    return f"#{'d' if word.isdecimal() else 'x' if HEX.fullmatch(word) else 'w'}{len(word)}"


def _value(text: str, span: tuple[int, int, str]) -> str:
    return f"{span[2]}:{text[span[0] : span[1]].lower()}"


def _terms(text: str, spans: list[tuple[int, int, str]]) -> set[str]:
    """The different terms outside the base spans."""
    for a, b, _ in spans:
        text = text[:a] + " " * (b - a) + text[b:]
    return {term_of(w) for w in {*TERM.findall(text)}}


def _with_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that hold a base span."""
    for batch in slices(batches, "text"):
        yield batch.filter(pa.array([bool(base_spans(t)) for t in batch.column("text").to_pylist()], pa.bool_()))


def _sums(total: dict, names: list[str]) -> pa.RecordBatch:
    """A dict of counts by key (a number or a tuple of them) as a batch, and the dict emptied."""
    keys = [k if isinstance(k, tuple) else (k,) for k in total]
    columns = [[k[i] for k in keys] for i in range(len(names) - 1)]
    out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, [*total.values()])], names=names)
    total.clear()
    return out


def _entity_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts by protected class and value, in parts to be summed."""
    total: dict[int, int] = {}
    for batch in batches:
        for t in batch.column("text").to_pylist():
            spans = base_spans(t)
            for e in {*(term_hash(_value(t, s)) for s in spans), *(CLASSES.index(k) for _, _, k in spans), CLASSES.index("any")}:
                total[e] = total.get(e, 0) + 1
        if len(total) > FLUSH:
            yield _sums(total, ["entity", "n"])
    yield _sums(total, ["entity", "n"])


def _pair_counts(wanted: np.ndarray | None):
    """Number of texts by protected class or value (of the wanted, if given) and term, in parts to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else {int(x) for x in wanted}
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for t in batch.column("text").to_pylist():
                spans = base_spans(t)
                values = {term_hash(_value(t, s)) for s in spans}
                found = [*(values if known is None else values & known), *{CLASSES.index(k) for _, _, k in spans}, CLASSES.index("any")]
                for w in [term_hash(w) for w in _terms(t, spans)]:
                    for e in found:
                        total[e, w] = total.get((e, w), 0) + 1
                if len(total) > FLUSH:
                    yield _sums(total, ["entity", "term", "n"])
        yield _sums(total, ["entity", "term", "n"])

    return run


class _Known:
    """Whether words are among known terms, by hash; remembers words of a bounded number."""

    def __init__(self, terms: dict[int, float]):
        self.terms, self.names = terms, {}

    def get(self, word: str) -> int:
        """The term's hash, or 0."""
        if (h := self.names.get(word)) is None:
            if len(self.names) > 300_000:
                self.names.clear()
            h = term_hash(term_of(word))
            h = self.names[word] = h if h in self.terms else 0
        return h


def _document_counts(wanted: np.ndarray):
    """Number of texts by wanted term, summed over each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Known(dict.fromkeys(wanted.tolist(), 0.0)), {}
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                found = {h for w in {*TERM.findall(t)} if (h := known.get(w))}
                if found and (spans := base_spans(t)):  # what base spans cover is no term
                    found &= {term_hash(w) for w in _terms(t, spans)}
                for h in found:
                    total[h] = total.get(h, 0) + 1
        yield _sums(total, ["term", "docs"])

    return run


def _all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, term) of each document's different terms: the way without a broadcast."""
    for batch in slices(batches, "text"):
        rows = [(i, term_hash(w)) for i, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for w in _terms(t, base_spans(t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["row", "term"])


def revealing_terms(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, min_texts: int = MIN_TEXTS, min_class_texts: int = MIN_CLASS_TEXTS, min_class_share: float = MIN_CLASS_SHARE, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term hash, reveals): the terms over the disclosure threshold, over all documents."""
    small_batches(docs.sparkSession)
    texts = _distinct_texts(docs.select(F.col(text_col).alias("text")), broadcast_terms)
    held = materialize(texts.mapInArrow(_with_entities, "text string"), "held")
    often = held.mapInArrow(_entity_counts, "entity long, n long").groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") >= min_texts)
    often = materialize(often, "entities")
    of_class = F.col("entity").between(0, len(CLASSES) - 1)
    least = F.lit(min_texts)
    for r in often.where(of_class).collect():
        least = F.when(F.col("entity") == r.entity, max(min_class_texts, min_class_share * r.n)).otherwise(least)
    often = often.where(~of_class).select("entity")
    wanted = often.toArrow().column("entity").to_numpy() if often.count() <= broadcast_terms else None
    near = held.mapInArrow(_pair_counts(wanted), "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("both"))
    near = near.where(F.col("both") >= F.when(of_class, F.greatest(least, F.lit(min_class_texts))).otherwise(min_texts))
    near = materialize(near.groupBy("term").agg(F.max("both").alias("both")), "near")  # one term has one count of documents: the largest decides
    if near.count() <= broadcast_terms:
        counts = texts.mapInArrow(_document_counts(near.select("term").toArrow().column("term").to_numpy()), "term long, docs long")
        counts = counts.groupBy("term").agg(F.sum("docs").alias("docs"))
    else:
        rows = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "text")
        counts = rows.mapInArrow(_all_terms, "row long, term long").join(near.select("term"), "term").groupBy("term").agg(F.count("*").alias("docs"))
    return near.join(counts, "term").select("term", (F.col("both") / F.col("docs")).alias("reveals")).where(F.col("reveals") >= disclosure)


def _span_rows(protected: dict[int, float] | None, removal: float):
    """The span columns for batches of (id, text[, terms]); terms: the row's own revealing terms, if ``protected`` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(protected or {})
        for batch in slices(batches, "text"):
            counts, digest, spans, clean = [], [], [], []
            own = batch.column("terms").to_pylist() if protected is None else [None] * batch.num_rows
            for t, mine in zip(batch.column("text").to_pylist(), own, strict=True):
                t = t or ""
                base = base_spans(t)
                every = [*base]
                if protected is None:
                    known = _Known({x["term"]: x["reveals"] for x in mine or ()})
                if known.terms:
                    for m in TERM.finditer(t):
                        if (h := known.get(m[0])) and not any(a < m.end() and m.start() < b for a, b, _ in base):
                            every.append((m.start(), m.end(), "term" if known.terms[h] >= removal else "hint"))
                every.sort(key=lambda s: (s[0], ALL_KINDS.index(s[2])))
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                clean.append(sanitise(t, every))
            arrays = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, pa.array(digest), pa.array(spans), pa.array(clean)], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "clean_text"])

    return run


def generalised(word: str) -> str:
    """What kind of string a term is: a name if it begins in upper case, a word, a number or a code."""
    if DIGIT.search(word):
        return "[NUMBER]" if word.isdecimal() else "[CODE]"
    return "[NAME]" if word[0].isupper() else "[WORD]"


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def sanitise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span as its kind in brackets, a ``hint`` as what it generalises to; of overlapping spans the union, as the first one's kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += (text[at:a], generalised(text[a:b]) if kind == "hint" else f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, removal: float = REMOVAL, min_texts: int = MIN_TEXTS, min_class_texts: int = MIN_CLASS_TEXTS, min_class_share: float = MIN_CLASS_SHARE, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_text) of every whole text.

    spans: the base kinds, ``term`` (removed) and ``hint`` (generalised), neither of
    which overlaps a base span, as kind:start:end in code points, by start, then kind.
    clean_text has each span replaced.  Null text counts as empty.  Repeated rows and
    other copies of a text stay and count once as evidence; other columns are ignored.
    Revealing terms are broadcast only up to ``broadcast_terms``; beyond, they are joined.
    """
    small_batches(docs.sparkSession)
    terms = materialize(revealing_terms(docs, text_col, disclosure, min_texts, min_class_texts, min_class_share, broadcast_terms), "terms")
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, clean_text string"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if terms.count() <= broadcast_terms:
        known = terms.toArrow()
        found = rows.mapInArrow(_span_rows(dict(zip(known.column("term").to_pylist(), known.column("reveals").to_pylist(), strict=True)), removal), out)
    else:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        hits = rows.select("row", "text").mapInArrow(_all_terms, "row long, term long").join(terms, "term").groupBy("row").agg(F.collect_set(F.struct("term", "reveals")).alias("terms"))
        found = rows.join(hits, "row", "left").select("id", "text", "terms").mapInArrow(_span_rows(None, removal), out)
    return found.withColumnRenamed("id", id_col)


def mask(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """docs with each text's personal data replaced; null text stays null.  Rows, columns and their order stay, whatever the columns' names."""
    text = docs.schema[text_col].name
    names = [f"_{k}" for k in range(len(docs.columns))]
    rows = materialize(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "mask")
    at = names[docs.columns.index(text)]
    clean = personal_data(rows, "row", at, **thresholds).where("spans != ''").select("row", "clean_text")
    out = rows.join(clean, "row", "left").withColumn(at, F.coalesce("clean_text", at))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
