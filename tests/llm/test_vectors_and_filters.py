"""Near copies of vectors, the audit of filters and whitening, against plain versions on whole tables and odd rows."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from upkeep.llm import embedding_dedup, filter_audit, queries, whitening

VECTORS = "vec_id long, embedding array<double>, label int, cls long, n long, digest string, h string"


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, lab, 1, 1, "x", "y") for i, v, lab in rows], VECTORS.replace("array<double>", f"array<{kind}>"))


# 11. Near copies of embeddings


def plain_copies(rows, cosine=0.98):
    """[(id, n_links, component, kept)] by all pairs, in the order of the rows."""

    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / np.abs(np.array(v, float)).max()
        return v / np.sqrt(v @ v)

    units, links = [unit(v) for _, v, _ in rows], {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = units[i], units[j]
        if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] is not None and a @ b >= cosine:
            links[i].add(j)
            links[j].add(i)
    out, group = [], {}
    for i in links:
        if i not in group:
            todo, seen = [i], {i}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            group |= dict.fromkeys(seen, seen)
        ids = [rows[k][0] for k in group[i] if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def around(rng, centre, n, spread):
    return centre + spread * rng.standard_normal((n, len(centre))) * np.linalg.norm(centre) / math.sqrt(len(centre))


@pytest.mark.parametrize("window", [4, embedding_dedup.WINDOW])
def test_copies_of_clusters_and_noise(spark, window):
    """A cluster wider than the window, chains, pairs, equal vectors of other scale, and rows that link with nothing."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(24)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(around(rng, centre, 120, 0.12))]
    rows += [(200 + i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((80, 24)))]
    turn = [[math.cos(0.15 * k), math.sin(0.15 * k), *[0.0] * 22] for k in range(12)]
    rows += [(300 + k, v, 2) for k, v in enumerate(turn)] + [(400 + k, [3 * x for x in v], 3) for k, v in enumerate(turn[:4])]
    rows += [(500, rows[0][1], 1), (500, rows[0][1], 1), (501, rows[0][1], 2), (502, [2 * x for x in rows[0][1]], 1)]
    got = found(embedding_dedup.near_copies(vectors(spark, rows), window=window))
    assert got == plain_copies(rows)


def test_odd_vectors(spark):
    v, huge = [1.0, 2.0, 3.0], [1e300, 2e300, 3e300]
    rows = [(1, v, 1), (2, v, None), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 3.0], 1), (6, [1.0, float("nan"), 3.0], 1), (7, [1.0, float("inf"), 3.0], 1), (8, [], 1), (9, huge, 1), (10, [1e-200, 2e-200, 3e-200], 1), (11, [1.0, 2.0], 1), (12, v, 2), (None, v, 1), (None, [-1.0, 5.0, 0.0], 1), (13, [-x for x in v], 1)]
    assert found(embedding_dedup.near_copies(vectors(spark, rows))) == plain_copies(rows)
    assert embedding_dedup.near_copies(vectors(spark, [])).count() == 0
    assert found(embedding_dedup.near_copies(vectors(spark, [(1, None, 1)]))) == [(1, 0, 1, True)]


def test_copies_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    extra = [(10_000 + i, (np.array(v) + 0.004).tolist(), lab) for i, v, lab in rows[::7]]
    assert found(queries.op11_embedding_dedup(spark, sf_dir)) == plain_copies(rows)
    assert found(embedding_dedup.near_copies(vectors(spark, rows + extra))) == plain_copies(rows + extra)


def test_large_groups_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(around(rng, rng.standard_normal(8), 150, 0.16))]
    assert found(embedding_dedup.near_copies(vectors(spark, rows, "float"))) == plain_copies([(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in rows])


def test_more_vectors_need_more_passes():
    needed = [embedding_dedup.passes_for(n) for n in (10, 5_000, 10**6, 10**9)]
    assert needed == sorted(needed) and needed[0] >= 1 and needed[-1] < 200
    assert embedding_dedup.passes_for(5_000, miss=1e-9) > embedding_dedup.passes_for(5_000)


# 12. Audit of filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one two", "word " * 60, "Aa " * 3 + "b c d " * 30, "x # y", "".join(f"w{i} " for i in range(60)), "é中 \U0001f600 " * 20 + "A B", "a\x00 a \x1c a\x00", "long" * 40 + " " + "long" * 40 + " " + "long" * 39 + "lonG",
    "abcdefgh abcdefgi abcdefgh abcdefghi", "w w w w \x85", "#$%&*|", "same", "same", "UPPER CASE WORDS ONLY",
]
DOCS = "doc_id long, text string, source string, id long, part string, mask int, n long"


def plain_mask(text, repeated):
    text = text or ""
    words = WORD.findall(text)
    fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), repeated)
    return sum(f << k for k, f in enumerate(fails))


def plain_masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    return [(i, s or "", plain_mask(t, i is not None and least[t or ""] < i)) for i, t, s in rows]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 9, "p", 31, 5) for r in rows], DOCS)


def odd_rows():
    rows = [(i, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(TEXTS)]
    return [*rows, rows[3], (None, "same", "a"), (None, "same", "a"), (-5, "word " * 60, "c"), (99, "Aa " * 200_000, "a"), (98, "é" * 700_000, "b")]


@pytest.mark.parametrize("long_text", [filter_audit.LONG_TEXT, 2048])
def test_counts_of_texts(long_text):
    texts = [t or "" for _, t, _ in odd_rows()]
    for array in (pa.array(texts), pa.array(["skipped", *texts])[1:], pa.array(texts, pa.large_string())):
        got = filter_audit.text_counts(array, long_text)
        for k, t in enumerate(texts):
            words = WORD.findall(t)
            want = (len(words), len(set(words)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t))
            assert tuple(int(got[x][k]) for x in ("words", "distinct", "capitals", "symbols", "points")) == want


def test_clashing_hashes_are_seen(monkeypatch):
    """With hashes of two bits most words clash; their bytes tell them apart."""
    monkeypatch.setattr(filter_audit, "_HASH_BITS", 2)
    texts = [f"{'alpha beta gamma delta epsilon a-rather-long-word-of-its-own ' * 3}{i} {i}" for i in range(20)]
    got = filter_audit.text_counts(pa.array(texts))
    assert got["distinct"].tolist() == [len(set(WORD.findall(t))) for t in texts]


def test_masks_of_odd_rows(spark):
    rows = odd_rows()
    got = Counter((r.id, r.part, r["mask"]) for r in filter_audit.failure_masks(documents(spark, rows)).collect())
    assert got == Counter(plain_masks(rows))


def test_audit_follows_the_orders(spark):
    """Every order run filter by filter over the rows, as a pipeline would."""
    rows = odd_rows()
    labels = [(0, 1, 0), (3, 0, 1), (3, 1, 0), (4, 1, 1), (6, None, None), (None, 1, 1), (98, 1, 0)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.filter_audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    masks = plain_masks(rows)
    parts, orders = {p for _, p, _ in masks}, ["".join(o) for o in itertools.permutations("ABCDE")]
    assert len(got) == 600 * len(parts)
    total = Counter()
    for part in parts:
        for order in orders:
            alive = [(i, m) for i, p, m in masks if p == part]
            whole = list(alive)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(i, m) for i, m in alive if m & bit]
                r = got[part, order, step]
                kept = [(i, m) for i, m in alive if not m & bit]
                want = (len(kept), len(gone), sum(1 for _, m in whole if m & bit) - len(gone), sum(1 for _, m in whole if m == bit), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want
                total[part, letter] += len(gone)
                alive = kept
    assert all(r.shapley == total[p, o[s - 1]] for (p, o, s), r in got.items())


def test_audit_of_nothing(spark):
    assert filter_audit.filter_audit(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 13. Whitening


def check_whitened(rows, got, components=8):
    """rows: (id, vector) that take part, of one length."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, d = x.shape
    total = x.sum(axis=0)
    centred = (n * x - total).astype(float) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    deviation = Counter((i, sum(int(a) ** 2 for a in n * row - total)) for (i, _), row in zip(rows, x, strict=True))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    unique = [k for k, (i, _) in enumerate(rows) if sum(i == j for j, _ in rows) == 1]
    for c in range(k):
        if values[c] <= 1e-9 * values[0]:
            continue
        want, mine = centred @ axes[:, c] / math.sqrt(values[c]), np.array([by_id[rows[u][0], c + 1][0].whitened for u in unique])
        alone = min(abs(values[c] - e) for j, e in enumerate(values) if j != c) > 1e-6 * values[0] if d > 1 else True
        if alone:
            assert min(np.abs(mine - want[unique]).max(), np.abs(mine + want[unique]).max()) < 1e-6
    for r in got:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-8) and r.identity_error <= 1e-9


def test_whitening_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(rows, queries.op13_whitening(spark, sf_dir).collect())


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i if i % 9 else None, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((60, 5)) * [9, 4, 2, 1, 0.5])] + [(7, [1.0, 2.0, 3.0, 4.0, 5.0], 1)] * 2
    bad = [(100, None, 1), (101, [1.0, None, 1.0, 1.0, 1.0], 1), (102, [float("nan")] * 5, 1), (103, [1.0, float("-inf"), 1.0, 1.0, 1.0], 1), (104, [], 1)]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    check_whitened([(i, v) for i, v, _ in good], got)
    assert whitening.whiten(vectors(spark, bad)).count() == 0 and whitening.whiten(vectors(spark, [])).count() == 0


def test_each_length_is_whitened_by_itself(spark):
    rng = np.random.default_rng(4)
    short, long = [(i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((40, 2)))], [(100 + i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((50, 11)))]
    got = whitening.whiten(vectors(spark, short + long)).collect()
    check_whitened([r[:2] for r in short], [r for r in got if r.vec_id < 100])
    check_whitened([r[:2] for r in long], [r for r in got if r.vec_id >= 100])


def test_no_variance_and_large_entries(spark):
    same = whitening.whiten(vectors(spark, [(i, [1.0, 2.0], 1) for i in range(5)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(5, 0, None, None, None)] * 10
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i], 1) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.explained for r in flat if r.component == 1} == {1.0}
    large = [(i, [1e8 * (i - 2), float(i)], 1) for i in range(5)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, large)).collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in large]
    want = [sum((5 * a - sum(r[j] for r in x)) ** 2 for j, a in enumerate(row)) for row in x]
    assert got == {i: w if w < 2**63 else None for i, w in enumerate(want)}
    wide = whitening.whiten(vectors(spark, [(0, [1e300, 1.0], 1), (1, [-1e300, 2.0], 1)])).collect()
    assert all(r.deviation is None for r in wide) and all(r.whitened is None or math.isfinite(r.whitened) for r in wide)
    assert whitening.whiten(vectors(spark, large)).where(F.col("n") != 5).count() == 0
