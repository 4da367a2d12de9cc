"""Centroid clustering with Ptolemaic pivots.

Vectors are whole numbers, and so are the centroids: the floor of each component's mean. A few
points are pivots. Every vector's distances to the pivots are stored with it, once; in a
round only the centroids' distances to the pivots are new. For a fixed pair of pivots p, q Ptolemy's
inequality gives

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

The centroid with the least bound is measured exactly; after it only those whose bounds by all
pairs do not lie above the best distance. Bounds are lowered by more than the
rounding of their terms, and survivors are measured in whole numbers, so results are exact.

The vectors never leave their tasks: a round sends the sums of its clusters (exact, whole
numbers), of which the driver sees a row for each centroid and component.

Defined results: vectors that are null, of another number of components or with null or
non-finite components are left out. Every row counts, repeated ones too. Rows without an id take
part and come last in the order that chooses the first centroids; rows with one id there are
ordered by their components. With fewer vectors than clusters each is a centroid. Components beyond
2^26 in size are cut off there; sums beyond 64 bits are null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.integers import finite, products, rows_of, scaled
from tillroll.llm.storage import written

#: Sampled vectors that the pivots are fitted on.
SAMPLE = 16_384


class Ptolemy:
    """Nearest centroids of vectors whose distances to the pivots are known."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        apart, n = self.to_pivots(pivots), len(pivots)
        # Fixed pairs: every pivot with the one behind it, and with the one half way round.
        pairs = {(p, (p + step) % n) for p in range(n) for step in (1, n // 2)}
        self.pairs = [(p, q, apart[p, q]) for p, q in sorted(pairs) if apart[p, q] > 0]

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)[:, None] - 2 * products(x, self.pivots) + (self.pivots * self.pivots).sum(1)[None, :]
        return np.sqrt(squares.astype(np.float64))

    def bounds(self, known: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squares that the vectors' squared distances to the centroids do not lie below."""
        to = self.to_pivots(centroids)
        least = np.zeros((len(known), len(centroids)))
        for p, q, apart in self.pairs:
            a, b = known[:, p, None] * to[None, :, q], known[:, q, None] * to[None, :, p]
            np.maximum(least, (np.abs(a - b) - 1e-14 * (a + b)) / apart, out=least)
        return least * least * (1 - 1e-14)

    def nearest(self, x: np.ndarray, known: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, distances that were measured)."""
        bounds = self.bounds(known, centroids)
        own = bounds.argmin(1)
        best_at, best = own.copy(), ((x - centroids[own]) ** 2).sum(1)
        measured = len(x)
        for c in range(len(centroids)):
            rows = np.flatnonzero((own != c) & (bounds[:, c] <= best))
            d = ((x[rows] - centroids[c]) ** 2).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (c < best_at[rows]))
            best[rows[better]], best_at[rows[better]] = d[better], c
            measured += len(rows)
        return best_at, best, measured


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def first_by(rows: DataFrame, order: Column, n: int, dim: int) -> np.ndarray:
    """The n first vectors of an order, equal ones by their components."""
    by = (F.col("place").asc_nulls_last(), "v")
    picked = rows.select(order.alias("place"), "v").orderBy(*by).limit(n).collect()
    return np.array([r["v"] for r in picked], np.int64).reshape(-1, dim)


def moved(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Floored means of the vectors nearest to each centroid."""
    squares = (centroids * centroids).sum(1)[None, :] - 2 * products(x, centroids)
    at = squares.argmin(1)
    return np.array([x[at == c].sum(0) // (at == c).sum() if (at == c).any() else old for c, old in enumerate(centroids)]).reshape(centroids.shape)


def cluster(vectors: DataFrame, k: int = 16, dim: int = 64, factor: int = 64, rounds: int = 3, seed: int = 1) -> DataFrame:
    """vectors (vec_id, embedding) as vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured.

    measured: how many distances the last assignment of the vector's batch needed for each
    vector, on average (k without pivots).
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(finite(v)).where(F.size("embedding") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(v, factor).alias("v"))
    centroids = first_by(rows, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), k, dim)
    # Pivots stay where they are, so they are put where centroids will be: the first centroids, and
    # what the rounds make of them on a sample. Any points would give right results.
    sample, to = first_by(rows, F.xxhash64("v"), SAMPLE, dim), centroids
    for _ in range(rounds if len(sample) else 0):
        to = moved(sample, to)
    index = Ptolemy(np.unique(np.concatenate([centroids, to]), axis=0) if len(sample) else centroids)

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), dim)
            frame["v"], frame["known"] = [r.tobytes() for r in x.astype(np.int32)], [r.tobytes() for r in index.to_pivots(x)]
            yield frame.astype({"vec_id": "Int64"})

    held = written(rows.mapInPandas(store, "vec_id long, v binary, known binary"), "cluster-vectors")
    def summed(now: np.ndarray):
        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x, known = rows_of(frame["v"], dim, np.int32).astype(np.int64), rows_of(frame["known"], len(index.pivots), np.float64)
                at, _, _ = index.nearest(x, known, now)
                for c in np.unique(at):
                    yield pd.DataFrame({"cluster": [c], "n": [(at == c).sum()], "sums": [x[at == c].sum(0)]})

        return sums

    for _ in range(rounds if len(centroids) else 0):
        parts = held.select("v", "known").mapInPandas(summed(centroids), "cluster int, n long, sums array<long>")
        # k rows for each component: exact sums, whatever the number of vectors.
        totals = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
        centroids = centroids.copy()
        for r in totals.collect():
            centroids[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]

    final = centroids

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, known = rows_of(frame["v"], dim, np.int32).astype(np.int64), rows_of(frame["known"], len(index.pivots), np.float64)
            at, d, measured = index.nearest(x, known, final)
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": at, "distance": d, "measured": measured / max(1, len(frame))})

    done = written(held.mapInPandas(last, "vec_id long, cluster int, distance long, measured double"), "cluster-assigned")
    # A row for each cluster.
    by_cluster = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    inertia = by_cluster.agg(F.sum("own")).scalar().try_cast("long")
    names = F.element_at(F.array(*[F.lit(digest(c)) for c in final]), F.col("cluster") + 1) if len(final) else F.lit(None).cast("string")
    return done.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", F.col("own").try_cast("long").alias("cluster_inertia"), inertia.alias("inertia"), names.alias("centroid_sha256"), "measured"
    )


def oracle(k: int = 16, dim: int = 64, factor: int = 64, rounds: int = 3, seed: int = 1) -> str:
    """The same in DuckDB's SQL without bounds: every distance is measured. (Without `measured`.)"""

    def nearest(centroids: str) -> str:
        apart = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        return f"""SELECT id, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
                   FROM (SELECT id, vec_id, v, cluster, {apart} AS d FROM kept, {centroids}) GROUP BY id, vec_id, v"""

    steps = [
        f"""kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({factor} * x)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim}
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1)::INT AS cluster, v AS c FROM kept
            ORDER BY cluster LIMIT {k})""",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS ({nearest(f'c{i}')})",
            f"""m{i} AS (SELECT cluster, list(x ORDER BY pos) AS c
                FROM (SELECT cluster, pos, floor(sum(x) / count(*)) AS x
                      FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS pos FROM a{i}) GROUP BY cluster, pos) GROUP BY cluster)""",
            f"c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))",
        ]
    last = f"c{rounds}"
    return f"""
    WITH {", ".join(steps)}, a AS ({nearest(last)})
    SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
           sha256(list_aggregate(list_transform(c, lambda x: x::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256
    FROM a JOIN {last} USING (cluster)"""
