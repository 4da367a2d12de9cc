"""Exact top-k search by inner product, with a vector-approximation file.

Vectors are whole numbers. Every dimension is cut into at most 256 cells at marks that hold
about equally many values (each value its own cell, where there are few); the approximation
file keeps a byte for each component. A query's inner product with a vector lies between two
sums over the vector's cells, of which each takes the worse or the better end of a cell.

1. Queries scan the file in blocks, a bounded number of approximations and queries at a time. Of
   a block only what may be among its k best is kept: a vector goes when k others are certainly
   better, that is, have a lower bound above its upper bound (or equal to it and a smaller id).
2. Over all blocks, the k best lower bounds of a query set the bar for the upper bounds.
3. Exact vectors are read in the order of their bounds: at first the k with the highest upper
   bounds; their k-th score then decides which of the rest may still matter, and these are read.

Equal vectors have equal scores, of which the smaller ids win. So of each group of them only the
k + 1 smallest ids enter the file, chosen before the shuffle: a group of any size is a few rows.

Defined results: vectors that are null or hold null or non-finite components take no part, nor
do rows without an id. A query's candidates are the vectors with as many components as its own.
Repeated rows count once; if an id has several vectors, the first in array order counts. Components
beyond 2^26 in size are cut off there. With fewer candidates than k a query gets them all. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.integers import finite, products, scaled
from tillroll.llm.storage import written

#: Cells of a dimension; components of vectors and of queries that one block holds (about).
CELLS, FILE_BLOCK, QUERY_BLOCK = 256, 1 << 20, 1 << 18
#: Less than any score.
NOTHING = -(1 << 62)


def whole_vectors(vectors: DataFrame, factor: int) -> DataFrame:
    """One row for each id: vec_id, v (array of whole numbers), dim."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(v)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(v, factor).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def smallest_copies(rows: DataFrame, n: int) -> DataFrame:
    """Of equal vectors the n with the smallest ids; each task sends no more of a group."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= n).drop("copy")


def marks(rows: DataFrame) -> DataFrame:
    """dim, pos, marks: the highest value of every cell of a component, ascending; and the lowest of all."""
    values = rows.select("dim", F.posexplode("v").alias("pos", "x"))
    shares = [i / CELLS for i in range(1, CELLS)]
    found = values.groupBy("dim", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.approx_percentile("x", shares, 4 * CELLS).alias("inner"))
    each = F.sequence("low", "high")
    few = F.col("high") - F.col("low") < CELLS
    return found.select("dim", "pos", "low", F.when(few, each).otherwise(F.array_sort(F.array_distinct(F.concat("inner", F.array("high"))))).alias("marks"))


class Cells:
    """The cells of one number of components: ends of each, and which one a value is in."""

    def __init__(self, low: list[int], tops: list[list[int]]):
        dim = len(tops)
        self.tops = [np.array(t, np.int64) for t in tops]
        self.low, self.high = np.zeros((dim, CELLS)), np.zeros((dim, CELLS))
        for d, t in enumerate(self.tops):
            self.high[d, : len(t)] = t
            self.low[d, : len(t)] = [low[d], *(t[:-1] + 1)]

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(t, v[:, d]) for d, t in enumerate(self.tops)], axis=1).astype(np.uint8) if self.tops else v.astype(np.uint8)

    def ends(self, cells: np.ndarray) -> np.ndarray:
        """Both ends of each component's cell, the lower ones first."""
        at = np.arange(cells.shape[1])[None, :]
        return np.hstack([self.low[at, cells], self.high[at, cells]])


def bounds(q: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with each approximation."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return products(np.hstack([up, down]), ends), products(np.hstack([down, up]), ends)


def survivors(ids: np.ndarray, least: np.ndarray, most: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that k others do not certainly beat; ids ascend, own[i] is the i-th query's id."""
    least = np.where(ids[None, :] == own[:, None], NOTHING, least)
    # The k-th best lower bound, ties to the smaller id: a stable order by falling bound.
    if len(ids) > 4 * k:
        bar = -np.partition(-least, k - 1, axis=1)[:, k - 1]
    else:
        bar = np.full(len(own), NOTHING)
    i, j = np.nonzero((most >= bar[:, None]) & (ids[None, :] != own[:, None]))
    # Of those exactly at the bar, the ones behind k certain ones by id go.
    above = (least > bar[:, None]).sum(axis=1)
    at_bar = np.cumsum(least == bar[:, None], axis=1)
    beaten = (most[i, j] == bar[i]) & (least[i, j] == bar[i]) & (bar[i] > NOTHING) & (above[i] + at_bar[i, j] > k)
    return i[~beaten], j[~beaten]


def search(vectors: DataFrame, k: int = 5, query_every: int = 50, factor: int = 256) -> DataFrame:
    """vectors (vec_id, embedding): the k best of every row whose id is divisible by query_every."""
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, factor), "exact-vectors")
    none = spark.range(0).selectExpr("id AS query_id", "cast(id AS int) AS rank", "id AS vec_id", "id AS score")
    held = written(smallest_copies(rows, k + 1), "exact-distinct")
    # A row for each component, at most 256 numbers each: no data.
    known = marks(held).orderBy("dim", "pos").collect()
    dims = sorted({r["dim"] for r in known})
    cells = {d: Cells([r["low"] for r in known if r["dim"] == d], [r["marks"] for r in known if r["dim"] == d]) for d in dims}
    if held.where("dim = 0").limit(1).count():
        cells[0] = Cells([], [])
    if not cells:
        return none
    shared = spark.sparkContext.broadcast(cells)

    def packed(df: DataFrame, size: int, pack, name: str) -> DataFrame:
        """Vectors dealt by id into blocks, each of them one row: dim, block, blocks, ids, data."""
        n = df.groupBy("dim").agg(F.ceil(F.count("*") * F.greatest(F.col("dim"), F.lit(1)) / size).cast("int").alias("blocks"))
        dealt = df.join(n, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

        def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame, dim = frame.sort_values("vec_id"), int(key[0])
            v = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), dim)
            return pd.DataFrame({"dim": [dim], "block": [key[1]], "blocks": [key[2]], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "data": [pack(dim, v).tobytes()]})

        grouped = dealt.select("dim", "block", "blocks", "vec_id", "v").groupBy("dim", "block", "blocks")
        return written(grouped.applyInPandas(one, "dim int, block int, blocks int, ids binary, data binary"), name)

    queries = rows.where(F.col("vec_id") % query_every == 0)
    file = packed(held, FILE_BLOCK, lambda dim, v: shared.value[dim].of(v), "exact-file")
    asked = packed(queries, QUERY_BLOCK, lambda dim, v: v.astype(np.int32), "exact-queries")

    def scan(key: tuple, block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out, dim = [], int(key[0])
        for b, q in ((b, q) for b in block.itertuples() for q in asking.itertuples()):
            ids, own = np.frombuffer(b.ids, np.int64), np.frombuffer(q.ids, np.int64)
            ends = shared.value[dim].ends(np.frombuffer(b.data, np.uint8).reshape(len(ids), dim))
            v = np.frombuffer(q.data, np.int32).reshape(len(own), dim).astype(np.int64)
            step = max(1, (1 << 21) // len(ids))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                least, most = bounds(v[at : at + step], ends)
                i, j = survivors(ids, least, most, part, k)
                out.append(pd.DataFrame({"query_id": part[i], "vec_id": ids[j], "least": least[i, j], "most": most[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "least": [], "most": []}).astype("int64")

    def every(blocks: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
        """A block's row for each block of the other kind."""
        n = others.select("dim", F.col("blocks").alias("n")).distinct()
        return blocks.join(n, "dim").select("dim", F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(other), "ids", "data")

    pair = ["dim", "fb", "qb"]
    left, right = every(file, asked, "fb", "qb"), every(asked, file, "qb", "fb")
    scanned = left.groupBy(pair).cogroup(right.groupBy(pair)).applyInPandas(scan, "query_id long, vec_id long, least long, most long")
    found = written(scanned, "exact-found")
    by_least = Window.partitionBy("query_id").orderBy(F.desc("least"), "vec_id")
    bars = found.withColumn("place", F.row_number().over(by_least)).where(F.col("place") <= k).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("least")).alias("bar")
    )
    may = found.join(bars, "query_id").where(F.col("bar").isNull() | (F.col("most") >= F.col("bar")))
    by_most = Window.partitionBy("query_id").orderBy(F.desc("most"), "vec_id")
    may = written(may.select("query_id", "vec_id", "most", F.row_number().over(by_most).alias("turn")), "exact-order")

    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, x: s + x)

    def read(pairs: DataFrame) -> DataFrame:
        """Exact scores of pairs."""
        vectors = pairs.join(rows.select("vec_id", "v"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return vectors.select("query_id", "vec_id", dot.alias("score"))

    first = written(read(may.where(F.col("turn") <= k)), "exact-first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = may.where(F.col("turn") > k).join(kth, "query_id").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scores = first.unionByName(read(rest.select("query_id", "vec_id")))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, query_every: int = 50, factor: int = 256) -> str:
    """The same in DuckDB's SQL, by brute force."""
    return f"""
    WITH r AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({factor} * x)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM r q JOIN r c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {query_every} = 0)
    SELECT query_id, rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= {k}"""
