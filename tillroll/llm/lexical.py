"""Ranked lexical search over a length-stratified index.

A document's score for an item is the sum, over the item's terms, of the term's weight times its
impact (10^9 tf) div (1000 tf + 12 m). The impact depends on the document by tf and by m alone,
the normaliser of its length. So documents with equal m are a stratum, a stratum's postings of a
term are ordered by tf, and each impact is computed once for a tf of a stratum, not for each posting.

1. Every document is tokenized once into a forward file: its distinct terms and their numbers.
2. Items are searched some hundred at a time, bounded by their terms. The forward file gives the
   postings of these terms, dealt into strata, and strata of many documents into blocks of a
   bounded number. A block is one row: documents, and postings ordered by term and tf.
3. The highest tf of each term in a block bounds all its documents' scores; the highest bound of
   its blocks is a stratum's. Strata are visited by falling bounds, in waves. A wave's scores
   raise the bar, the k-th score found; a stratum whose bound is below an item's bar is never
   visited for it.

All scores are exact 64-bit whole numbers.

Defined results: a null or empty text has no terms and is found by nothing; repeated documents
each count and are each found; equal scores are ordered by id, rows without an id behind the others;
an item that is repeated counts once, and if an id has several texts, the first in text order
counts; items without terms find nothing; a missing item id is an id of its own; empty tables give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.integers import products
from tillroll.llm.storage import written

# The characters of terms, and what weights and normalisers are made of.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE, SLOPE, UNIT, SHARE, LENGTH = 75, 25, 1000, 1_000_000_000, 12

#: Documents of a block; terms and items of one pass (about); strata in the first waves.
BLOCK, PASS_TERMS, PASS_ITEMS, WAVES = 256, 32_768, 512, (8, 64)

#: Parts of a stratum when its size is looked up.
SALTS = 32

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, A-Z lower-cased."""
    return text.translate(_SPLIT).split()


def tokenize(docs: DataFrame, *carried: str) -> DataFrame:
    """docs (text and carried columns) as the carried ones, n, terms (distinct, joined by blanks), tfs (32-bit numbers)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = Counter(terms_of(text.as_buffer().to_pybytes()))
                n.append(found.total())
                terms.append(b" ".join(found))
                tfs.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            columns = [*(batch.column(c) for c in carried), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "n", "terms", "tfs"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in carried), "n long", "terms binary", "tfs binary"])
    return docs.select(*carried, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, schema)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (SHARE * tf.astype(np.int64)) // (UNIT * tf.astype(np.int64) + LENGTH * m)


class Pass:
    """The items of one pass: their terms, numbered, and each item's weight of every term."""

    def __init__(self, items: list[tuple[object, dict[bytes, int]]]):
        self.ids = [i for i, _ in items]
        self.terms = {t: k for k, t in enumerate(sorted({t for _, ts in items for t in ts}))}
        self.counts = np.zeros((len(items), len(self.terms)), np.int64)
        for row, (_, ts) in enumerate(items):
            for t, n in ts.items():
                self.counts[row, self.terms[t]] = n

    def weigh(self, n_docs: int, df: dict[int, int]) -> np.ndarray:
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))]
        return self.counts * np.array(w, np.int64)[None, :]


def _asked(forward: DataFrame, terms) -> DataFrame:
    """row, id, missing, n, tids, tfs: the asked terms of every document that has any."""

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = terms.value
        for frame in frames:
            tids, tfs = [], []
            for words, numbers in zip(frame["terms"], frame["tfs"], strict=True):
                at = np.array([known.get(w, -1) for w in words.split()], np.int32)
                tids.append(at[at >= 0].tobytes())
                tfs.append(np.frombuffer(numbers, np.int32)[at >= 0].tobytes())
            frame["tids"], frame["tfs"] = tids, tfs
            yield frame.loc[frame["tids"].str.len() > 0, ["row", "id", "missing", "n", "tids", "tfs"]]

    return forward.mapInPandas(look_up, "row long, id long, missing boolean, n long, tids binary, tfs binary")


def _document_counts(asked: DataFrame) -> dict[int, int]:
    """How many documents have a term: a row for each term of the pass."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tids, n = np.unique(np.frombuffer(b"".join(frame["tids"]), np.int32), return_counts=True)
            yield pd.DataFrame({"tid": tids, "n": n})

    return {r["tid"]: r["n"] for r in asked.select("tids").mapInPandas(count, "tid int, n long").groupBy("tid").agg(F.sum("n").alias("n")).collect()}


def _stratified(asked: DataFrame, n_docs: int, length: int) -> DataFrame:
    """The index: a row for each block of a stratum. Documents by id; postings by term and tf."""
    strata = asked.select(F.expr(f"{BASE} + ({SLOPE} * n * {n_docs}) div {length}").alias("m"), "row", "id", "missing", "tids", "tfs")
    blocks = strata.groupBy("m").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # Many documents may have one m: they meet its number of blocks in several places.
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = strata.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(blocks, ["m", "salt"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["missing", "id", "row"])
        tids, tfs = (np.frombuffer(b"".join(frame[c]), np.int32) for c in ("tids", "tfs"))
        at = np.repeat(np.arange(len(frame), dtype=np.int32), frame["tids"].str.len().to_numpy() // 4)
        order = np.lexsort((at, -tfs, tids))
        packed = {c: [frame[c].to_numpy().astype(kind).tobytes()] for c, kind in (("row", np.int64), ("id", np.int64), ("missing", bool))}
        return pd.DataFrame({"m": [key[0]], "block": [key[1]], **packed, "tids": [tids[order].tobytes()], "tfs": [tfs[order].tobytes()], "at": [at[order].tobytes()]})

    schema = "m long, block int, row binary, id binary, missing binary, tids binary, tfs binary, at binary"
    return dealt.select("m", "block", "row", "id", "missing", "tids", "tfs").groupBy("m", "block").applyInPandas(pack, schema)


def _bounds(index: DataFrame, weights) -> DataFrame:
    """item, m, bound: no document of the stratum scores higher."""

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m, tids, tfs in zip(frame["m"], frame["tids"], frame["tfs"], strict=True):
                terms, first = np.unique(np.frombuffer(tids, np.int32), return_index=True)
                # A term's first posting has its highest tf.
                best = products(weights.value[:, terms], impacts(np.frombuffer(tfs, np.int32)[first], m)[None, :])[:, 0]
                items = np.flatnonzero(best)
                yield pd.DataFrame({"item": items, "m": m, "bound": best[items]})

    return index.select("m", "tids", "tfs").mapInPandas(bound, "item int, m long, bound long").groupBy("item", "m").agg(F.max("bound").alias("bound"))


def _scores(index: DataFrame, visits: DataFrame, weights, k: int) -> DataFrame:
    """item, row, id, missing, score: the k best of each block visited, of those at or above the bar."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                tids, tfs, at = (np.frombuffer(x, np.int32) for x in (r.tids, r.tfs, r.at))
                docs, asking = np.frombuffer(r.row, np.int64), np.array([v["item"] for v in r.asking])
                bars = np.array([v["bar"] for v in r.asking], np.int64)
                terms, local = np.unique(tids, return_inverse=True)
                # An impact for each tf of the stratum, dealt to its postings.
                heights, of = np.unique(tfs, return_inverse=True)
                matrix = np.zeros((len(docs), len(terms)), np.int64)
                matrix[at, local] = impacts(heights, r.m)[of]
                got = products(weights.value[np.ix_(asking, terms)], matrix)
                if got.shape[1] > k:
                    bars = np.maximum(bars, np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k])
                i, j = np.nonzero((got >= bars[:, None]) & (got > 0))
                # Documents are in the order of their ids: ties beyond the k-th place go.
                order = np.lexsort((j, -got[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                yield pd.DataFrame({"item": asking[i], "row": docs[j], "id": np.frombuffer(r.id, np.int64)[j], "missing": np.frombuffer(r.missing, bool)[j], "score": got[i, j]})

    asking = visits.groupBy("m").agg(F.collect_list(F.struct("item", "bar")).alias("asking"))
    return index.drop("block").join(asking, "m").mapInPandas(score, "item int, row long, id long, missing boolean, score long")


def _search_pass(forward: DataFrame, items: Pass, n_docs: int, length: int, k: int) -> DataFrame:
    spark = forward.sparkSession
    asked = written(_asked(forward, spark.sparkContext.broadcast(items.terms)), "lexical-asked")
    # A number for each item and term of the pass, whose numbers are bounded.
    weights = spark.sparkContext.broadcast(items.weigh(n_docs, _document_counts(asked)))
    index = written(_stratified(asked, n_docs, length), "lexical-index")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    order = written(_bounds(index, weights).withColumn("turn", F.row_number().over(by_bound)), "lexical-order")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "missing", "id", "row")
    kept, since = None, 0
    for upto in (*WAVES, None):
        visits = order.where((F.col("turn") > since) & (F.lit(upto is None) | (F.col("turn") <= (upto or 0))))
        if kept is None:
            visits = visits.select("item", "m", F.lit(1).cast("long").alias("bar"))
        else:
            bars = kept.groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(1)).alias("bar"))
            visits = visits.join(bars, "item", "left").withColumn("bar", F.coalesce("bar", F.lit(1).cast("long"))).where(F.col("bound") >= F.col("bar")).select("item", "m", "bar")
        found = _scores(index, visits, weights, k)
        found = found if kept is None else found.unionByName(kept.drop("rank"))
        kept = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "lexical-best")
        since = upto
    ids = F.array(*[F.lit(i).cast("long") for i in items.ids])
    return kept.select(F.element_at(ids, F.col("item") + 1).alias("item_id"), "rank", F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) as item_id, rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), "text"
    )
    forward = written(tokenize(numbered, "row", "id", "missing").where("n > 0"), "lexical-forward")
    one = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    texts = written(tokenize(one, "item_id").where("n > 0").withColumn("asks", F.octet_length("tfs") / 4), "lexical-items")
    none = spark.range(0).selectExpr("id AS item_id", "cast(id AS int) AS rank", "id AS doc_id", "id AS score")
    n_docs, length = forward.agg(F.count("*"), F.sum("n")).first()
    n_items, asks = texts.agg(F.count("*"), F.sum("asks")).first()
    passes = max(math.ceil(n_items / PASS_ITEMS), math.ceil((asks or 0) / PASS_TERMS))
    for i in range(passes if n_docs else 0):
        # The items of one pass: about PASS_ITEMS items and PASS_TERMS terms at most.
        chosen = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).select("item_id", "terms", "tfs").collect()
        if chosen:
            items_now = [(r["item_id"], dict(zip(bytes(r["terms"]).split(), np.frombuffer(r["tfs"], np.int32).tolist(), strict=True))) for r in chosen]
            none = none.unionByName(_search_pass(forward, Pass(items_now), n_docs, length, k))
    return none


def oracle(k: int = 20) -> str:
    """The same in DuckDB's SQL, every document scored."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
    sized AS (SELECT row, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sized),
    postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY row, term),
    weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term, docs),
    asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({words}) AS term FROM benchmark) GROUP BY item_id, term),
    scored AS (SELECT item_id, row, doc_id, sum(q * w * (({SHARE} * tf) // ({UNIT} * tf + {LENGTH} * ({BASE} + ({SLOPE} * n * docs) // length))))::BIGINT AS score
               FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sized USING (row), total GROUP BY item_id, row, doc_id)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= {k}"""
