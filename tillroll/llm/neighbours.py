"""Approximate nearest neighbours by inner product, with balanced posting lists.

Lengths matter for inner products, so vectors are divided into bands of nearly equal length, and
within a band into lists by direction. Centroids of directions come from a balanced k-means on a
bounded sample; every vector goes to the list of its nearest centroid, found by a proximity graph
of the centroids held in memory. A vector near the boundary of two lists is replicated to both.

A list's best inner product with a query is estimated from what the list holds: its mean m and
spread s give q.m + SPREAD |q| s. A query reads its most promising lists first, a fixed number of
rows: those of the graph's best centroids in each band. Its k-th score so far then decides which of
all lists still promise more, and these are read; the others are pruned. A block returns at most the
k best (and ties) for a query, and of them only those that reach the score it has already. Vectors close together or of very
different lengths need few lists, vectors without any structure many.

Lists are short; some hundred of them that follow each other lie in one block, and a query
visits a block once with the numbers of the lists it wants there. Blocks and their queries are
bounded on both sides. Scores are exact inner products in double precision, summed up by
dimension in order, so equal vectors have equal scores. Of equal vectors only the k + 1 with the
smallest ids are in the lists (the others can't be among the nearest), chosen before the shuffle.

Defined results: vectors that are null, zero or hold null or non-finite components take no part,
nor do rows without an id or of a dimension other than the most frequent one (of equally
frequent ones, the smallest). Repeated rows count once; if an id has several vectors, the first
in array order counts. Ties go to the smaller id. With fewer candidates than k, a query gets
them all. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.exact_search import smallest_copies
from tillroll.llm.storage import written

#: Rows a list should have; lists that are held in memory at most; sampled rows and floats for the centroids.
LIST_ROWS, MOST_LISTS, SAMPLE, SAMPLE_FLOATS = 16, 65_536, 20_000, 4_000_000
#: Lengths within a band differ by this factor at most.
BAND = 1.5
#: Links of a centroid; beam of the graph's search for a query and for a vector's own lists; centroids followed at a time.
LINKS, BEAM, OWN_BEAM, EXPANDED = 24, 96, 32, 4
#: A vector is replicated to the next list if that is within this ratio of its nearest distance.
NEAR = 1.01
#: A list promises its mean and so many spreads; so many rows for each of the k wanted are read first, at any size of the table.
SPREAD, FIRST = 3.3, 40
#: Rows of a block, and of its queries (about).
BLOCK, QUERY_BLOCK = 4096, 1024
#: Distances or promises that are held at a time (a float each).
CELLS = 2_000_000


def stretches(n: int, k: int, most: int = 4096) -> list[slice]:
    """Slices of n rows, each with at most CELLS pairs with k others."""
    step = max(1, min(most, CELLS // max(1, k)))
    return [slice(at, at + step) for at in range(0, n, step)]


def squared(x: np.ndarray, c: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, less the rows' own squares."""
    d = (2 * x) @ c.T
    return np.subtract(c2, d, out=d)


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids; a growing penalty on large clusters keeps their sizes near each other.

    Of the distances only those of some rows are held at a time.
    """
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    penalty, own, least = np.zeros(k), np.zeros(len(x), np.int64), np.zeros(len(x))
    for _ in range(rounds):
        c2 = (c**2).sum(1)
        for some in stretches(len(x), k):
            d = squared(x[some], c, c2)
            d += penalty
            own[some], least[some] = d.argmin(1), d.min(1)
        n = np.bincount(own, minlength=k)
        scale = max(1e-12, float(np.mean(least + (x**2).sum(1))))
        penalty += 0.1 * scale * (n / max(1.0, len(x) / k) - 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class CentroidGraph:
    """Centroids linked to their nearest ones; best-first search for many vectors at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.c, self.c2 = centroids, (centroids**2).sum(1)
        k = len(centroids)
        near = np.zeros((k, min(k, LINKS + 1)), np.int64)
        for some in stretches(k, k):
            d = squared(centroids[some], centroids, self.c2)
            best = np.sort(np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]], axis=1)
            order = np.argsort(np.take_along_axis(d, best, axis=1), axis=1, kind="stable")
            near[some] = np.take_along_axis(best, order, axis=1)
        far = np.random.default_rng(seed).integers(0, k, (k, 4))  # long links
        self.links = np.concatenate([near, far], axis=1)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))

    def distances(self, q: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the centroids named for each, inf for -1."""
        c = self.c[to]
        d = (q**2).sum(1)[:, None] - 2 * np.matmul(c, q[:, :, None])[:, :, 0] + self.c2[to]
        return np.where(to < 0, np.inf, np.maximum(0, d))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found and their squared distances, nearest first; -1 and inf where there are fewer.

        Only the beam is held for a vector, so neither time nor memory depends on the number of centroids.
        """
        beam = min(beam, len(self.c))
        ids, d = np.full((len(q), beam), -1), np.full((len(q), beam), np.inf)
        done, rows = np.zeros((len(q), beam), bool), np.arange(len(q))
        new = np.broadcast_to(self.entries, (len(q), len(self.entries)))
        while len(rows):
            there, far = np.concatenate([ids[rows], new], axis=1), np.concatenate([d[rows], self.distances(q[rows], new)], axis=1)
            known = np.concatenate([done[rows], np.zeros(new.shape, bool)], axis=1)
            # Of a centroid met again the one in the beam stays: it comes first among equal ids.
            order = np.argsort(there, axis=1, kind="stable")
            there, far, known = (np.take_along_axis(x, order, axis=1) for x in (there, far, known))
            far[:, 1:][there[:, 1:] == there[:, :-1]] = np.inf
            best = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids[rows], d[rows], done[rows] = (np.take_along_axis(x, best, axis=1) for x in (there, far, known))
            ids[rows] = np.where(np.isinf(d[rows]), -1, ids[rows])
            left = ~done[rows] & (ids[rows] >= 0)
            going = left.any(1)
            rows, left = rows[going], left[going]
            at = np.argsort(~left, axis=1, kind="stable")[:, :EXPANDED]  # the nearest that were not followed yet
            real = np.take_along_axis(left, at, axis=1)
            done[rows[:, None], at] |= real
            new = np.where(real[:, :, None], self.links[ids[rows[:, None], at]], -1).reshape(len(rows), at.shape[1] * self.links.shape[1])
        return ids, d


def clean(vectors: DataFrame) -> DataFrame:
    """Rows that take part, one for each id: vec_id, v (doubles)."""
    v = F.col("v")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(usable).groupBy("vec_id").agg(F.min("v").alias("v"))
    return written(rows.withColumn("dim", F.size("v")), "vectors")


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, dimension by dimension in order."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


class Index:
    """The lists' centroids by band, and what each list holds."""

    def __init__(self, sample: np.ndarray, bands: dict[int, int], dim: int):
        lengths = np.sqrt((sample**2).sum(1))
        of, unit = band_of(lengths), sample / lengths[:, None]
        self.bands, self.first, lists = {}, {}, 0
        scale = max(1.0, sum(bands.values()) / (LIST_ROWS * MOST_LISTS))
        for band, n in sorted(bands.items()):
            own = unit[of == band]
            k = max(1, min(len(own), round(n / (LIST_ROWS * scale))))
            centroids = balanced_kmeans(own, k, rounds=4) if k > 1 else np.zeros((1, dim))
            self.bands[band], self.first[band] = CentroidGraph(centroids), lists
            lists += k
        self.lists = lists
        self.means, self.spreads, self.sizes = np.zeros((lists, dim)), np.zeros(lists), np.zeros(lists)

    def hold(self, totals: pa.Table) -> None:
        """totals (list, sums), a row or more for each list: rows, sum of squares, then the sums of the components."""
        table = np.zeros((self.lists, 2 + self.means.shape[1]))
        for batch in totals.to_batches():
            np.add.at(table, batch["list"].to_numpy(), batch["sums"].flatten().to_numpy().reshape(-1, table.shape[1]))
        self.sizes = table[:, 0].copy()
        n = np.maximum(1, self.sizes)
        self.means = table[:, 2:] / n[:, None]
        self.spreads = np.sqrt(np.maximum(0, table[:, 1] / n - (self.means**2).sum(1)) / self.means.shape[1])

    def promises(self, q: np.ndarray) -> np.ndarray:
        return np.where(self.sizes > 0, q @ self.means.T + SPREAD * np.sqrt((q**2).sum(1))[:, None] * self.spreads, -np.inf)

    def first_lists(self, q: np.ndarray, promises: np.ndarray, rows: float) -> np.ndarray:
        """Which lists to read first: the best promises of those the graphs find, up to so many rows."""
        seen = np.zeros(promises.shape, bool)
        unit = q / np.sqrt((q**2).sum(1))[:, None]
        for band, graph in self.bands.items():
            found, _ = graph.search(unit, BEAM)
            r, c = np.nonzero(found >= 0)
            seen[r, self.first[band] + found[r, c]] = True
        order = np.argsort(np.where(seen, -promises, np.inf), axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        wanted = np.zeros(promises.shape, bool)
        np.put_along_axis(wanted, order, before < rows, axis=1)
        return wanted & seen


def band_of(lengths: np.ndarray) -> np.ndarray:
    return np.floor(np.log(lengths) / np.log(BAND)).astype(np.int64)


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Of n rows the ``most`` with the smallest hashes of their ids, in that order.

    Hashes below a bound are sorted only, chosen so that little more than these rows are.
    """
    order, few = F.xxhash64("vec_id"), rows
    if n > 2 * most:
        below = rows.where(order < int(2**64 * 1.2 * most / n) - 2**63)
        few = below if below.count() >= most else rows
    return few.orderBy(order, "vec_id").limit(most)


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, figures: dict | None = None) -> DataFrame:
    """vectors (vec_id, embedding): the k nearest found of every row whose id is divisible by query_every.

    figures, if given, gets `share`: rows read of all that the queries could have read.
    """
    spark = vectors.sparkSession
    rows = clean(vectors)
    kind = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    none = spark.range(0).selectExpr("id AS query_id", "cast(id AS int) AS rank", "id AS vec_id", "cast(id AS double) AS score")
    if kind is None:
        return none
    dim = kind["dim"]
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v")
    held = written(smallest_copies(rows, k + 1), "neighbour-rows")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    usable = held.where((length > 0) & (length < float("inf")))
    # A row for each factor of BAND between the shortest and the longest vector.
    bands = {r["band"]: r["n"] for r in usable.groupBy(F.floor(F.ln(length) / np.log(BAND)).alias("band")).agg(F.count("*").alias("n")).collect()}
    if not bands:
        return none
    n = sum(bands.values())
    # By Arrow, so neither as objects nor by way of a merge on the driver, which would get every task's best rows.
    sample = sampled(usable, n, min(SAMPLE, max(1000, SAMPLE_FLOATS // dim))).select("v").toArrow()
    x = np.concatenate([batch["v"].flatten().to_numpy() for batch in sample.to_batches()]).reshape(-1, dim)
    index = Index(x, bands, dim)
    graphs = spark.sparkContext.broadcast(index)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = graphs.value
        for frame in frames:
            v, lists = np.stack(frame["v"].to_numpy()), np.zeros((len(frame), 2), np.int64)
            lengths = np.sqrt((v**2).sum(1))
            of = band_of(lengths)
            # At a band's very edge the two logarithms may differ.
            of = np.where(np.isin(of, list(known.bands)), of, np.array(list(known.bands))[np.abs(of[:, None] - np.array(list(known.bands))).argmin(1)])
            for band in np.unique(of):
                graph, at = known.bands[band], np.flatnonzero(of == band)
                for some in np.array_split(at, -(-len(at) // 256)):
                    found, d = graph.search(v[some] / lengths[some, None], OWN_BEAM)
                    two = np.repeat(found[:, :1], 2, axis=1)
                    if len(graph.c) > 1:
                        two[:, 1] = np.where(d[:, 1] <= d[:, 0] * NEAR**2, found[:, 1], two[:, 1])
                    lists[some] = known.first[band] + two
            r, c = np.nonzero(np.stack([np.ones(len(v), bool), lists[:, 1] != lists[:, 0]], axis=1))
            yield pd.DataFrame({"list": lists[r, c], "vec_id": frame["vec_id"].to_numpy()[r], "v": list(v[r])})

    postings = written(usable.mapInPandas(assign, "list int, vec_id long, v array<double>"), "postings")

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((graphs.value.lists, 2 + dim))
        for frame in frames:
            v = np.stack(frame["v"].to_numpy())
            np.add.at(sums, frame["list"].to_numpy(), np.hstack([np.ones((len(v), 1)), (v**2).sum(1)[:, None], v]))
        here = np.flatnonzero(sums[:, 0])
        if len(here):
            yield pd.DataFrame({"list": here, "sums": list(sums[here])})

    # A row for each list, of lists whose number is bounded.
    gathered = postings.repartition("list").select("list", "v").mapInPandas(total, "list int, sums array<double>")
    index.hold(gathered.toArrow())
    full = spark.sparkContext.broadcast(index)
    together = max(1, BLOCK // LIST_ROWS)
    blocks = postings.withColumn("block", (F.col("list") / together).cast("int"))
    parts = blocks.groupBy("block").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["list", "vec_id"])
        data = {"lists": frame["list"].to_numpy(np.int32), "ids": frame["vec_id"].to_numpy(np.int64), "v": np.stack(frame["v"].to_numpy())}
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "parts": [key[2]]} | {c: [x.tobytes()] for c, x in data.items()})

    dealt = blocks.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    packed = written(dealt.groupBy("block", "part", "parts").applyInPandas(pack, "block int, part int, parts int, lists binary, ids binary, v binary"), "blocks")
    queries = rows.where(F.col("vec_id") % query_every == 0).withColumnRenamed("v", "q")

    def probe(again: bool):
        def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = full.value
            for frame in frames:
                for at in stretches(len(frame), known.lists, 256):
                    some = frame.iloc[at]
                    q = np.stack(some["q"].to_numpy())
                    promises, bar = known.promises(q), some["bar"].fillna(-np.inf).to_numpy()
                    wanted = known.first_lists(q, promises, FIRST * k)
                    if again:
                        wanted = ~wanted & (promises > bar[:, None])
                    i, j = np.nonzero(wanted)
                    to = i * (known.lists // together + 1) + j // together
                    edges = np.flatnonzero(np.diff(to, prepend=-1))
                    asked = np.split(j.astype(np.int32), edges[1:])
                    reads = np.add.reduceat(known.sizes[j], edges) if len(j) else []
                    yield pd.DataFrame({
                        "block": j[edges] // together, "query_id": some["vec_id"].to_numpy()[i[edges]], "q": [q[r].tobytes() for r in i[edges]],
                        "wanted": [x.tobytes() for x in asked[: len(edges)]], "reads": reads, "bar": bar[i[edges]],
                    })

        return lists

    def nearest(key: tuple, block: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})]
        for b in block.itertuples():
            lists, ids = np.frombuffer(b.lists, np.int32), np.frombuffer(b.ids, np.int64)
            v = np.frombuffer(b.v, np.float64).reshape(len(ids), dim)
            by_id = np.argsort(ids, kind="stable")
            twice = ids[by_id[1:]] == ids[by_id[:-1]]
            one_of, other = by_id[:-1][twice], by_id[1:][twice]  # a vector in two of the block's lists
            for at in range(0, len(probes), 256):
                some = probes.iloc[at : at + 256]
                q = np.frombuffer(b"".join(some["q"]), np.float64).reshape(len(some), dim)
                asked = [np.frombuffer(w, np.int32) for w in some["wanted"]]
                who, which = np.repeat(np.arange(len(some)), [len(w) for w in asked]), np.concatenate(asked)
                order = np.argsort(which, kind="stable")
                who, which = who[order], which[order]
                s = np.full((len(some), len(ids)), -np.inf)
                for one in np.unique(which):
                    a, z = np.searchsorted(lists, [one, one + 1])
                    mine = who[slice(*np.searchsorted(which, [one, one + 1]))]
                    s[mine, a:z] = q[mine] @ v[a:z].T
                own = some["query_id"].to_numpy()
                s[own[:, None] == ids[None, :]] = -np.inf
                s[:, one_of] = np.maximum(s[:, one_of], s[:, other])
                s[:, other] = -np.inf
                # Products of whole lists are rounded in another order: what is that near to the k-th place is measured exactly.
                # Below the k-th score that the query has already, nothing is wanted.
                last = -np.partition(-s, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                last = np.maximum(last, some["bar"].to_numpy())
                slack = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((v**2).sum(1).max(initial=0))
                i, j = np.nonzero((s >= (last - slack)[:, None]) & np.isfinite(s))
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": exact(q[i], v[j])}))
        return pd.concat(out)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))

    def read(probes: DataFrame) -> DataFrame:
        """The k best of what the probes find."""
        asked = probes.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("qblocks"))
        left = packed.join(asked, "block").withColumn("qb", every("qblocks")).select("block", "part", "qb", "lists", "ids", "v")
        spread = probes.join(asked, "block").join(parts, "block").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qblocks")).cast("int"))
        right = spread.withColumn("part", every("parts")).select("block", "part", "qb", "query_id", "q", "wanted", "bar")
        key = ["block", "part", "qb"]
        found = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(nearest, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    probes = "block int, query_id long, q binary, wanted binary, reads double, bar double"
    one = written(queries.withColumn("bar", F.lit(None).cast("double")).mapInPandas(probe(False), probes), "probes")
    first = written(read(one).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first")
    bars = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bar"))
    told = queries.join(bars.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    two = written(told.mapInPandas(probe(True), probes), "probes-again")
    if figures is not None:
        reads = one.unionByName(two).agg(F.sum("reads")).first()[0] or 0
        figures["share"] = reads / max(1, n * queries.count())
    scores = first.select("query_id", "vec_id", "score").unionByName(read(two)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
