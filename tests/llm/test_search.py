"""Exact search, lexical search and clustering against brute force and DuckDB."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ROWS
from tests.oracle import compare, connect
from tillroll.llm import clustering, exact_search, lexical
from tillroll.llm.integers import products
from tillroll.llm.queries import ORACLE_SQL, QUERIES

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_exact_search", "op12_lexical_search", "op13_clustering"])
def test_matches_duckdb(spark, sf_dir, name):
    for place in (sf_dir, f"{sf_dir}/../sf0.01"):
        rows, differences = compare(QUERIES[name](spark, place), connect(place), ORACLE_SQL[name])
        assert not differences and rows


def vectors(spark, rows):
    frame = [(i, v, "x", 1, 2, 3.0) for i, v in rows]
    return spark.createDataFrame(frame, "vec_id long, embedding array<float>, block string, rank int, dim int, score double")


def odd_vectors(dim, seed=5):
    rng = random.Random(seed)
    vec = lambda: [rng.randrange(-6, 7) / 64 for _ in range(dim)]  # noqa: E731  many ties
    rows = [(i, vec()) for i in range(260)] + [(i, vec()[:-1] + [0.5]) for i in range(260, 300)]
    rows += [(i, [0.25] * dim) for i in range(300, 460)]  # a third of them equal
    rows += [(500, None), (550, [0.0] * dim), (600, [None] + [0.1] * (dim - 1)), (650, [NAN] + [0.1] * (dim - 1)), (700, [INF] + [0.1] * (dim - 1))]
    rows += [(750, [0.25] * (dim + 1)), (751, [0.5] * (dim + 1)), (800, []), (None, [0.9] * dim), (50, [0.9] * dim), (100, None), (300, [0.25] * dim)]
    return rows + [(850, [3e38] + [0.0] * (dim - 1)), (851, [-3e38] + [0.0] * (dim - 1)), (852, [1e4] * dim)]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, factor):
    return [max(-(2**26), min(2**26, math.floor(factor * float(np.float32(x))))) for x in v]


def brute_top(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is not None and fine(v):
            w = whole(v, 256)
            ok[i] = min(ok.get(i, w), w)
    out = {}
    for q, a in ok.items():
        if q % every == 0:
            near = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(a))[:k]
            if near:
                out[q] = [(i, -s) for s, i in near]
    return out


@pytest.mark.parametrize("sizes", [None, (256, 64), (16, 32)])
def test_exact_search(spark, monkeypatch, sizes):
    if sizes:  # few cells and small blocks
        monkeypatch.setattr(exact_search, "CELLS", 8)
        monkeypatch.setattr(exact_search, "FILE_BLOCK", sizes[0])
        monkeypatch.setattr(exact_search, "QUERY_BLOCK", sizes[1])
    rows = odd_vectors(5)
    got = defaultdict(list)
    for r in sorted(exact_search.search(vectors(spark, rows)).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == brute_top(rows)
    if not sizes:
        assert exact_search.search(vectors(spark, rows).where("false")).count() == 0


def test_copies_enter_the_file_k_plus_one_times(spark):
    rows = spark.createDataFrame([(i, [1, 2]) for i in range(1000)] + [(i, [i, 0]) for i in range(1000, 1010)], "vec_id long, v array<int>")
    held = exact_search.smallest_copies(rows.repartition(4), 6)
    assert sorted(r.vec_id for r in held.collect()) == [0, 1, 2, 3, 4, 5, *range(1000, 1010)]


def test_cells_hold_their_values():
    rng = np.random.default_rng(1)
    v = rng.integers(-1000, 1000, (500, 3))
    tops = [sorted({*np.quantile(v[:, d], np.linspace(0, 1, 9)[1:-1]).astype(int).tolist(), int(v[:, d].max())}) for d in range(3)]
    cells = exact_search.Cells(v.min(0).tolist(), tops)
    ends = cells.ends(cells.of(v))
    assert (ends[:, :3] <= v).all() and (v <= ends[:, 3:]).all()
    least, most = exact_search.bounds(v[:20], ends)
    exact = v[:20] @ v.T
    assert (least <= exact).all() and (exact <= most).all()


def test_products_are_exact_at_any_size():
    big = np.array([[2**26, 2**26 - 1, 1]] * 2)
    assert products(big, big)[0, 0] == 2**52 + (2**26 - 1) ** 2 + 1
    wide = np.full((1, 600), 2**26 - 1)
    assert products(wide, wide)[0, 0] == 600 * (2**26 - 1) ** 2


def brute_clusters(rows, k, dim, rounds=3):
    kept = [(i, tuple(whole(v, 64))) for i, v in rows if fine(v) and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, near, strict=True) if at == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in near:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), names[j]) for (i, _), (d, j) in zip(kept, near, strict=True))


@pytest.mark.parametrize("k", [16, 3])
def test_clustering(spark, monkeypatch, k):
    monkeypatch.setattr(clustering, "SAMPLE", 40)
    rows = odd_vectors(6, 7) + [(7, [0.1] * 6), (7, [0.1] * 6), (None, [0.4] * 6)]
    got = clustering.cluster(vectors(spark, rows).repartition(4), k=k, dim=6).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows, k, 6)


def test_clustering_of_little(spark):
    none = vectors(spark, odd_vectors(6)).where("false")
    assert clustering.cluster(none, dim=6).count() == 0
    assert clustering.cluster(vectors(spark, [(1, None)]), dim=6).count() == 0
    few = [(i, [i / 7] * 6) for i in range(4)]
    got = clustering.cluster(vectors(spark, few), dim=6).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(few, 16, 6)


def test_pivots_spare_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (16, 8))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.1, 8)).tolist()) for i in range(4000)]
    got = clustering.cluster(vectors(spark, rows), dim=8).agg({"measured": "avg"}).first()[0]
    assert got < 3  # of 16


TERM = re.compile(lexical.TERMS)


def brute_ranks(docs, items, k=20):
    lower = str.maketrans(lexical.UPPER, lexical.LOWER)
    of = lambda t: Counter(TERM.findall((t or "").translate(lower)))
    sets = [(i, of(t)) for i, t in docs]
    n_docs, length = sum(1 for _, s in sets if s), sum(s.total() for _, s in sets)
    df = Counter(t for _, s in sets for t in s)
    texts = {}
    for i, t in items:
        if t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = {}
    for i, t in texts.items():
        found = []
        for doc, s in sets:
            if not s:
                continue
            m = 75 + 25 * s.total() * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * s[w] // (1000 * s[w] + 12 * m)) for w, q in of(t).items() if w in s)
            if score:
                found.append((-score, doc is None, doc or 0))
        if found:
            out[i] = [(None if none else doc, -s) for s, none, doc in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("sizes", [None, (4, 50, 2, (1, 2))])
def test_lexical(spark, docs, no_docs, monkeypatch, sizes):
    if sizes:  # small blocks, several passes, short waves
        for name, value in zip(("BLOCK", "PASS_TERMS", "PASS_ITEMS", "WAVES"), sizes, strict=True):
            monkeypatch.setattr(lexical, name, value)
    items = [(1, "Released under the MIT license"), (2, "alpha1 alpha2 alpha2 beta ONE one"), (3, None), (4, ""), (5, "wort5x5 wort7x7 héllo Wörld")]
    items += [(5, "one two"), (1, "Released under the MIT license"), (None, "two\tone.two"), (6, "nowhere"), (7, "alpha3")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, row int, m int")
    got = defaultdict(list)
    for r in sorted(lexical.search(docs, frame).collect(), key=lambda r: r["rank"]):
        got[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    assert got == brute_ranks([(i, t) for i, t, _, _ in ROWS], items)
    if not sizes:
        assert lexical.search(no_docs, frame).count() == 0 and lexical.search(docs, frame.where("false")).count() == 0


def test_lexical_with_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(8)
    word = lambda: f"w{int(rng.expovariate(0.15))}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(240)] + [(i, "w1 w2 w3 w3 w40") for i in range(240, 360)]
    docs += [(7, "w1 w2 w3 w3 w40"), (7, "w1 w2 w3 w3 w40"), (400, "w1 " * 20_000)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = defaultdict(list)
    for r in sorted(lexical.search(frame, spark.createDataFrame(items, "item_id long, text string")).collect(), key=lambda r: r["rank"]):
        got[r.item_id].append((r.doc_id, r.score))
    assert got == brute_ranks(docs, items)
