"""Fingerprints, sharding and mixing against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from tests.llm.conftest import ROWS
from tillroll.llm import fingerprints, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


def test_fingerprints(docs, no_docs):
    got = fingerprints.fingerprint(docs).collect()
    assert len(got) == len(ROWS)
    listed = sorted({(i is not None, i or 0, t or "") for i, t, _, _ in ROWS})
    after = {x: listed[(k + 1) % len(listed)][2] for k, x in enumerate(listed[:-1])}
    known = {}
    for r in got:
        # The two rows without an id are told apart by their lengths.
        key = next(x for x in listed if x[0] == (r.doc_id is not None) and x[1] == (r.doc_id or 0) and len(x[2]) == r.n_chars)
        if r.doc_id is None or key not in after:
            continue  # the order of those without an id is that of a hash
        text, half = key[2], len(key[2]) // 2
        edited = text[: len(text) - half] + after[key][:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if r.n_chars > 100:
            assert abs(r.near_edited - jaccard(text, edited)) < 0.22  # three standard errors
            assert abs(r.near_next - jaccard(text, after[key])) < 0.22
        known.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in known.values())
    assert fingerprints.fingerprint(no_docs).count() == 0


def test_likeness_is_generalised_jaccard(spark):
    rows = [(i, " ".join([f"w{(i * 7 + j) % 50}" for j in range(60)] + ["the"] * (5 + i))) for i in range(60)]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = [got[i].near_next - jaccard(rows[i][1], rows[(i + 1) % 60][1]) for i in range(60)]
    assert abs(sum(errors) / 60) < 0.05


def test_sharding(docs, no_docs):
    got = sharding.shard(docs, leaves=3).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 3 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(no_docs, leaves=8).count() == 0


def test_shards_are_even(spark):
    # One text and one source for a third of all rows: ties in every dimension.
    rows = [(i, "same text" if i % 3 == 0 else "x" * (i * 37 % 400), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = Counter()
    for r in sharding.shard(docs, leaves=8).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 900
    by_bytes = sharding.shard(docs, target_bytes=sum(sizes.values()) // 5 + 1)
    assert by_bytes.select("shard").distinct().count() == 5


def test_repeated_rows_are_split(spark):
    rows = [(7, "the same row again and again", "en", "hot")] * 1000 + [(i, "x" * (i * 37 % 60), "en", f"s{i % 7}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = Counter()
    for r in sharding.shard(docs, leaves=8).collect():
        sizes[r.shard] += r.size
    even = sum(sizes.values()) / 8
    assert all(abs(n - even) <= max(61, even / 100) for n in sizes.values()), sizes


def brute_targets(sizes):
    """Reshare the excess by weight until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixing(docs, no_docs):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _, _ in ROWS)
    taken = Counter()
    by_size = {v: k for k, v in sizes.items()}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (size, target), n in taken.items():
        sources = [s for s in sizes if sizes[s] == size and abs(targets[s] - target) < 1e-3]
        assert sources and n == sum(int(targets[s] + 1e-9) for s in sources), (by_size, size)
    assert mixing.mix(no_docs).count() == 0
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_without_ids(spark):
    rows = [(None if i % 2 else 7, " ".join(["w"] * (i % 11)), "ab"[i % 3 > 0]) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (sorted(map(str, mixing.mix(frame.repartition(n)).collect())) for n in (2, 7))
    assert once == again and len(once) == 200


def test_mixed_corpus(docs, no_docs):
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.select("text").collect())
    assert words == mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    texts = [t or "" for _, t, _, _ in ROWS]
    assert all(any(t.startswith(r.text or "") for t in texts) for r in mixed.select("text").collect())
    assert mixing.apply_mix(no_docs).count() == 0
