"""The stages of the pipeline, each on what the one before it kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import ROWS
from tests.llm.test_free import brute_classes, check_packing
from tillroll.llm import mixing, quality


def test_stages_on_odd_rows(spark, docs, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.count() <= 2 * len(ROWS)
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf_dir).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    want = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in want.collect())
    single = stages["n-gram Jaccard join"](spark, good, sf_dir).cache()
    classes = brute_classes([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c, _ in classes if d == c)
    mixed = stages["mixing sources to target weights"](spark, single, sf_dir).cache()
    words = lambda rows: Counter({d: sum(len(t.encode().split()) for i, t in rows if i == d) for d, _ in rows})
    got = words([(r.doc_id, r.text) for r in mixed.collect()])
    assert got == Counter({r.doc_id: r.taken for r in mixing.mix(single).collect() if r.taken})
    packed = stages["best-fit packing"](spark, mixed, sf_dir).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in mixed.collect()])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)


def test_no_document_is_lost_by_its_id(spark, sf_dir):
    base = " ".join(f"word{i}" for i in range(60))
    near, other = base.replace("word59", "changed"), " ".join(f"else{i}" for i in range(40))
    rows = [(1, base), (2, near), (2, other), (None, other + " x"), (None, "lonely text of six short words"), (3, near), (3, base + " y"), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted((r.doc_id or 0, (r.text or "")[:6]) for r in kept.collect()) == [(0, "lonely"), (1, "word0 "), (2, "else0 "), (4, ""), (5, "")]
