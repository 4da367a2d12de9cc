"""Chat collapse, Jaccard join, license scan, classifier, token counts, packing, neighbours against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.conftest import ROWS
from tests.oracle import compare
from tests.plans import records_sent
from tillroll.llm import chat, jaccard, license_texts, licenses, neighbours, packing, quality, viterbi
from tillroll.llm.graphs import components
from tillroll.llm.queries import TOKENIZER

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_chat(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "bye")]
    rows = [(1, k, *t, "x") for k, t in enumerate(turns[:2])]
    rows += [(2, k, *t, "x") for k, t in enumerate(turns)]
    rows += [(3, 10 * k, *t, "x") for k, t in enumerate(turns)]  # equal to 2, other numbers
    rows += [(4, 0, "user", "hi", "x"), (5, 0, "user", "ho", "x"), (6, 0, "user", None, "x"), (7, 0, "user", "", "x")]
    rows += [(8, None, "user", "hi", "x"), (None, 0, "tool", "call", "x"), (9, 0, "user", "ho", "x"), (9, 0, "user", "ho", "x")]
    rows += [(10, k, "user", f"{k}", "x") for k in range(3000)]  # longer than a stretch
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    got = defaultdict(list)
    for r in sorted(chat.collapse(frame).collect(), key=lambda r: r.part):
        got[r.conv_id].append(r)
    lists = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        lists[c] = [t[2:4] for t in sorted(own, key=lambda t: tuple((v is not None, v) if v is not None else (False, 0) for v in t[1:4]))]
    kept = {}
    for c, t in sorted(lists.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        longer = any(len(o) > len(t) and o[: len(t)] == t for o in lists.values())
        if not longer and t not in kept.values():
            kept[c] = t
    assert set(got) == set(kept)
    for c, t in kept.items():
        assert "".join(r.rendered for r in got[c]) == "".join(f"<|{role}|>\n{text or ''}\n<|end|>\n" for role, text in t)
        assert {(r.n_turns, r.n_copies) for r in got[c]} == {(len(t), sum(o == t for o in lists.values()))}
    assert len(got[10]) == 3
    assert chat.collapse(frame.where("false")).count() == 0


def shingles(text, k):
    words = text.encode().lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_classes(texts, k, percent):
    sets = [shingles(t, k) for _, t in texts]
    label, links = list(range(len(sets))), [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label = [label[j] if x == label[i] else x for x in label]
    least = {x: min((d for (d, _), y in zip(texts, label, strict=True) if y == x and d is not None), default=None) for x in set(label)}
    return Counter((d, len(s), least[x] if s else d, n) for (d, _), s, x, n in zip(texts, sets, label, links, strict=True))


def classes(df, k, percent):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.join_classes(df, k, percent).collect())


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, no_docs, texts, k, percent):
    assert classes(docs, k, percent) == brute_classes(texts, k, percent)
    assert jaccard.join_classes(no_docs, k, percent).count() == 0


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 16)
    monkeypatch.setattr(jaccard, "SET_BLOCK", 8)
    monkeypatch.setattr(jaccard, "HEAVY", 20)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(150)] = rng.choice(["x", "y", f"u{i}"])
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:40] + [f"v{i}_{j}" for j in range(100)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert classes(df, 3, 90) == brute_classes(rows, 3, 90)
    unnamed = [(None if i % 3 else i, t) for i, t in rows] + [(None, rows[0][1])] * 5
    df = spark.createDataFrame(unnamed, "doc_id long, text string").repartition(4)
    assert classes(df, 3, 90) == brute_classes(unnamed, 3, 90)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(300, k) for k in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: y for x, y in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_licenses(spark, docs, no_docs, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    rows, differences = compare(licenses.scan(docs), con, licenses.oracle())
    assert not differences and rows == len(ROWS)
    got = next(r for r in licenses.scan(docs).collect() if r.doc_id == 12)
    assert (got.n_base, got.base_labels, got.first_word, got.last_word) == (3, "cc-by-nc,mit", 1, 12)
    assert licenses.scan(no_docs).count() == 0


def test_diagonals_merge(spark):
    text = next(t for t, label in licenses.TEMPLATES.items() if label == "bsd").split()
    broken = text[:8] + ["surely"] + text[8:14] + text[15:]
    rows = [(1, " ".join(["x"] * 20 + broken)), (2, " ".join(text[:6]))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "bsd" and got[1].n_base == 0 and 0.6 < got[1].score < 1


def test_whole_license_texts(spark):
    body = next(t for t, label in license_texts.BODIES.items() if label == "isc")
    words = body.split()
    rows = [(1, f"x y z\n{body}\nand more"), (2, " ".join(words[:40] + ["odd"] * 3 + words[43:])), (3, " ".join(words[: len(words) // 3])), (4, " ".join(words[:3]) * 20_000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score) == ("isc", 1.0) and got[2].labels == "isc" and 0.6 < got[2].score < 1
    assert got[3].labels == got[4].labels == ""


def test_short_template_text(spark):
    rows = [(2, " ".join(next(t for t, label in licenses.TEMPLATES.items() if label == "bsd").split()[:6]))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].labels == "" and got[2].score == 0


def test_token_counts(docs, no_docs, sf_dir, spark):
    vocabulary = viterbi.zipf_vocabulary(PIECES)
    known = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    known.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.SPACE, prepend_scheme="always", split=True)
    want = lambda t: len(known.encode(t, add_special_tokens=False).ids)
    got = viterbi.count_tokens(docs, PIECES).collect()
    assert Counter((r.doc_id, r.n_chars, r.n_tokens) for r in got) == Counter((i, len(t or ""), want(t or "")) for i, t, _, _ in ROWS)
    assert viterbi.count_tokens(no_docs, PIECES).count() == 0
    counter = viterbi.PieceCounter(vocabulary)
    rng = random.Random(3)
    odd = ["a▁b", " lead", "tail ", "  two  ", "\n\t", "<0x0A>", "<unk>", "日本語 \U0001f600é", "́́"]
    odd += ["".join(rng.choice("ab eén▁日\n\U0001f600.") for _ in range(rng.randrange(30))) for _ in range(300)]
    odd += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    assert [counter.text(t)[0] for t in odd] == [want(t) for t in odd]


def test_viterbi_ties():
    counter = viterbi.PieceCounter([("<unk>", -9.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), (viterbi.SPACE, -1.0)])
    assert counter.word("aba") == (1, -3.0)  # the longest last piece is tried first and never replaced by an equal
    assert counter.word("abab") == (2, -4.0)
    assert counter.word("é") == (2, -19.0)


def check_packing(rows, texts, sequence=2048):
    known = Tokenizer.from_file(TOKENIZER[0])
    known.encode_special_tokens = True
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    want = defaultdict(list)
    for i, t in texts:
        ids = [*known.encode(t, add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % sequence or sequence, len(ids) + 1, sequence)]
        want[i] += [(k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(places)


def test_packing(docs, no_docs, texts, spark, sf_dir):
    check_packing(packing.pack(docs, TOKENIZER).collect(), texts)
    assert packing.pack(no_docs, TOKENIZER).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER).collect()
    assert check_packing(got, rows) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 2


def test_packing_of_long_runs(spark):
    rows = [(1, "x" + " " * 2_000_000 + "x"), (2, "\n" * 1_000_000), (3, "ab" * 1_000_000), (4, "a b" * 10)] + [(5, "same")] * 300
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    assert lengths[1] > 1_000_000 and lengths[2] > 100_000 and lengths[5] == 300 * 2
    check_packing([r for r in got if r.doc_id == 1], [rows[0]])


def test_local_search_empties_bins():
    counts = Counter({1000: 500, 700: 600, 400: 100, 650: 300, 300: 10})
    first = packing.best_fit(counts)
    last = packing.local_search(first)
    held = Counter()
    for bin_, n in last.items():
        assert sum(k * v for k, v in bin_) <= 2048
        for length, each in bin_:
            held[length] += each * n
    assert held == counts and sum(last.values()) < sum(first.values())


def test_classifier(spark, docs, no_docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    real = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = quality.classify(real, labels).join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (good >= 0.7).mean() > 0.95
    scored = quality.classify(docs, labels).collect()
    assert len(scored) == len(ROWS)
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    odd = spark.createDataFrame([(0, None, 1), (None, 1, 0), (99, 1, 0), (1, 1, 0), (3, 0, 1), (4, 5, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, odd).count() == len(ROWS)
    assert quality.classify(no_docs, labels).count() == 0


def test_held_out_labels_teach_nothing(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(str, quality.classify(docs, x).collect())) for x in (labels, turned))
    assert one == two


def brute_nearest(rows, k=20, every=20):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for q in ok:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_neighbours(spark):
    rng = random.Random(5)
    vec = lambda: [float(rng.randrange(-4, 5)) for _ in range(3)]  # noqa: E731  many ties
    rows = [(i, vec()) for i in range(150)] + [(i, [1.0, 2.0, 0.0]) for i in range(150, 220)]
    rows += [(300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 2.0]), (360, [float("nan"), 1.0, 1.0]), (380, [float("inf"), 0.0, 0.0]), (400, [1.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 1.0, 1.0]), (40, None), (160, [1.0, 2.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = defaultdict(list)
    for r in sorted(neighbours.search(frame).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert got == brute_nearest(rows)
    assert neighbours.search(frame.where("false")).count() == 0
    few = frame.where("vec_id in (20, 21, 22)")
    assert len(neighbours.search(few).collect()) == 2


@pytest.mark.parametrize("uneven", [False, True])
def test_recall(spark, sf_dir, uneven):
    """Unit vectors as in the test table (noisy copies of them), and vectors of very different lengths."""
    vectors = spark.read.parquet(f"{sf_dir}/../sf0.1/embeddings.parquet")
    known = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()])
    rng = np.random.default_rng(2)
    v = np.repeat(known, 10, axis=0) + rng.normal(0, 0.08, (10 * len(known), known.shape[1]))
    v /= np.sqrt((v**2).sum(1))[:, None]
    if uneven:
        v *= np.exp(rng.normal(0, 0.5, len(v)))[:, None]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found, figures = defaultdict(set), {}
    for r in neighbours.search(frame, query_every=200, figures=figures).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for at in range(0, len(v), 200):
        s = v @ v[at]
        s[at] = -np.inf
        hits.append(len(found[at] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9 and min(hits) >= 0.5 and figures["share"] < 0.34, (np.mean(hits), min(hits), figures)


def test_graph_search_holds_the_beam_only():
    rng = np.random.default_rng(4)
    c, q = rng.normal(0, 1, (500, 6)), rng.normal(0, 1, (80, 6))
    exact = ((q[:, None] - c[None]) ** 2).sum(2)
    ids, d = neighbours.CentroidGraph(c).search(q, 32)
    assert ids.shape == d.shape == (80, 32) and all(len(set(row)) == 32 for row in ids.tolist())
    assert np.allclose(d, np.take_along_axis(exact, ids, axis=1)) and (np.diff(d, axis=1) >= 0).all()
    assert (ids[:, 0] == exact.argmin(1)).mean() >= 0.9
    few, _ = neighbours.CentroidGraph(c[:5]).search(q, 32)
    assert (np.sort(few, axis=1) == np.arange(5)).all()


def test_index_is_made_in_bounded_memory():
    """All distances at once would be 128 MB for the links and 256 MB for the clusters."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (8000, 8))
    tracemalloc.start()
    try:
        c = neighbours.balanced_kmeans(x, 4000, rounds=2)
        graph = neighbours.CentroidGraph(c)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6, peak
    d = ((c[:50, None] - c[None]) ** 2).sum(2)
    assert (graph.links[:50, : neighbours.LINKS + 1] == np.argsort(d, axis=1, kind="stable")[:, : neighbours.LINKS + 1]).all()


def test_the_driver_gets_the_sample_and_a_row_for_each_list(spark, monkeypatch):
    """Every task's best rows would be the whole table; every component a row of its own."""
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(5000)], "vec_id long, v array<double>").repartition(8)
    plain = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(300).collect()
    assert neighbours.sampled(rows, 5000, 300).collect() == plain
    # Where the hashes are not spread as expected, all rows are looked at.
    assert neighbours.sampled(rows, 500_000, 300).collect() == plain
    taken = []
    monkeypatch.setattr(type(rows), "toArrow", lambda self, f=type(rows).toArrow: taken.append(f(self)) or taken[-1])
    monkeypatch.setattr(type(rows), "toPandas", None)
    v = np.random.default_rng(8).normal(0, 1, (2000, 8))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(8)
    assert neighbours.search(frame, query_every=500).count() == 4 * 20
    sample, totals = taken
    assert sample.num_rows == 300 and totals.num_rows <= 2000 / neighbours.LIST_ROWS + 10
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # tasks without a list
        assert neighbours.search(frame.where("vec_id < 3"), query_every=1).count() == 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_return_only_what_beats_the_first_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    v = np.random.default_rng(6).normal(0, 1, (4000, 8))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    figures = {}
    found = neighbours.search(frame, query_every=100, figures=figures)
    hits = [len({r.vec_id for r in found.collect() if r.query_id == at} & set(np.argsort(-np.where(np.arange(4000) == at, -np.inf, v @ v[at]))[:20].tolist())) / 20 for at in (0, 1700)]
    assert min(hits) >= 0.7
    # Probes, blocks and what was found: of 40 queries, 20 found first and few that beat them.
    assert records_sent(found) < 5000, (records_sent(found), figures)


def test_words_are_those_of_the_contract():
    text = "AİK b\x1cc\x0bd  e"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert len(words) == len(text.encode().lower().split())
    assert len(jaccard.Shingles(1).of(text)) == len(set(words))
