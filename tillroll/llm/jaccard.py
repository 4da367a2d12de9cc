"""N-gram Jaccard join with set-relation skipping.

Exact links between documents whose sets of word n-grams overlap enough, returned as classes.

1. Equal sets become one. Every set is put into an inverted index under its prefix: its first
   tokens in one global order, as many as two sets with enough overlap must have one of in
   common. The order is by hash, with tokens last that very many prefixes hold.
2. Index lists are read in blocks sorted by size. Pairs are skipped by size, by their positions
   in the lists (which bound the overlap), and by parity bitmaps (the bits in which two differ
   bound their difference). Only a spanning forest of what remains leaves the task, so a list
   with a third of all sets yields a row for each of them, not for each pair.
3. The forest's components gather sets that may be similar; each set is sent once to its own.
   There all overlaps are derived incrementally from one set of the block: with P its tokens,
   two sets share |P| - what either lacks + what both lack + what both add. Large components
   are dealt out as pairs of blocks.
4. Components of the exact links are the classes.

Tokens and sets are known by 64-bit hashes.

Defined results: a null text is an empty one; texts without words have empty sets, link with
nothing and are their own class, also several rows of one id; rows without an id take part and
have the smallest id of their class, null if it has none; repeated rows link with each other;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.columns import text_of
from tillroll.llm.graphs import components
from tillroll.llm.storage import written
from tillroll.llm.streams import whole_groups

#: Entries of an index list, and sets of a component, that one block holds.
LIST_BLOCK, SET_BLOCK = 4096, 1024
#: A token is put last if so many prefixes hold it; at most MOST_HEAVY tokens are.
HEAVY, MOST_HEAVY = 1000, 1_000_000
LEAST_BITS, MOST_BITS = 256, 16384
#: Lists up to this length are compared by shifting the whole frame.
SHORT = 16


class Shingles:
    """Sets of word n-grams as sorted 64-bit hashes.

    Words are hashed all at once: with prefix sums of value * r^place over the bytes of a text, a
    word's hash is the difference at its ends, shifted back to place 0 (r is odd, so it has an
    inverse modulo 2^64).
    """

    def __init__(self, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.k = k
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 1 << 63)) * 2 + 1
        self.blank = np.zeros(256, bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16, 2 * len(self.powers))
            with np.errstate(over="ignore"):
                up = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64)
                self.powers, self.inverses = up(self.base), up(pow(self.base, -1, 1 << 64))

    def _mix(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def of(self, text: str) -> np.ndarray:
        # Of bytes, lower() changes A-Z alone.
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        edges = np.flatnonzero(np.diff(self.blank[data], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        h = self._mix((sums[ends] - sums[starts]) * self.inverses[starts])
        n = len(h) - self.k + 1
        if n < 1:  # the whole sequence as one
            return self._mix((h * self.factors[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
        total = h[:n] * self.factors[0]
        for i in range(1, self.k):
            total = total + h[i : i + n] * self.factors[i]
        return np.unique(self._mix(total))

    def name(self, s: np.ndarray) -> int:
        """The set's own hash, signed."""
        import xxhash

        return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def bitmap(s: np.ndarray, percent: int) -> bytes:
    """Parity of the number of tokens at each bit; five bits at least for each token two may differ in."""
    differ = 2 * len(s) * (100 - percent) // (100 + percent)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (5 * differ).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a link: 100 I >= percent (na + nb - I)."""
    return -(-percent * (na + nb) // (100 + percent))


class Lists:
    """What the index knows of the entries of a frame; finds pairs that may link."""

    def __init__(self, frame: pd.DataFrame, percent: int):
        self.n, self.pos = frame["n"].to_numpy(np.int64), frame["pos"].to_numpy(np.int64)
        self.sid, self.block, self.single = frame["sid"].to_numpy(), frame["block"].to_numpy(), frame["single"].to_numpy()
        self.percent = percent
        self.width = np.array([len(b) // 8 for b in frame["bits"]])
        self.at = np.zeros(len(frame), np.int64)
        self.words = {}
        for w in np.unique(self.width):
            rows = np.flatnonzero(self.width == w)
            self.at[rows] = np.arange(len(rows))
            self.words[w] = np.frombuffer(b"".join(frame["bits"].iloc[rows]), np.uint64).reshape(len(rows), w)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows i, j pass all filters."""
        na, nb = self.n[i], self.n[j]
        need = needed(na, nb, self.percent)
        pa, pb = self.pos[i], self.pos[j]
        ok = (np.minimum(na, nb) >= need) & (self.sid[i] != self.sid[j]) & (self.single[i] | (self.block[i] != self.block[j]))
        ok &= np.minimum(pa, pb) + np.minimum(na - pa, nb - pb) >= need
        rows = np.flatnonzero(ok)
        i, j, most = i[rows], j[rows], (na + nb - 2 * need)[rows]
        both = self.width[i] * MOST_BITS + self.width[j]
        for code in np.unique(both):
            wi, wj = divmod(int(code), MOST_BITS)
            sel = np.flatnonzero(both == code)
            for part in np.array_split(sel, -(-len(sel) * max(wi, wj) // 4_000_000)):
                a, b = self.words[wi][self.at[i[part]]], self.words[wj][self.at[j[part]]]
                while a.shape[1] > b.shape[1]:
                    a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
                while b.shape[1] > a.shape[1]:
                    b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                ok[rows[part]] = np.bitwise_count(a ^ b).sum(axis=1) <= most[part]
        return ok


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph with edges a-b, by label contraction."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new[label]


def candidate_edges(percent: int):
    """A task over index entries sorted by (token, cell, n): a forest of the pairs that may link."""

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, ["token", "cell"]):
            lists = Lists(frame, percent)
            sizes = np.diff(starts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            found = []
            brief = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
            for d in range(1, SHORT):
                i = brief[brief + d < len(frame)]
                i = i[group[i] == group[i + d]]
                if not len(i):
                    break
                ok = lists.likely(i, i + d)
                found.append((i[ok], i[ok] + d))
            for g in np.flatnonzero(sizes > SHORT):
                lo, hi = starts[g], starts[g + 1]
                # Sorted by size: a row's partners end where they get too large for it.
                ends = lo + np.searchsorted(lists.n[lo:hi], 100 * lists.n[lo:hi] // percent, side="right")
                for at in range(lo, hi, 256):
                    own = np.arange(at, min(hi, at + 256))
                    i = np.repeat(own, np.maximum(0, ends[own - lo] - own - 1))
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(np.maximum(0, ends[own - lo] - own - 1)) - np.maximum(0, ends[own - lo] - own - 1), np.maximum(0, ends[own - lo] - own - 1))
                    ok = lists.likely(i, j)
                    found.append((i[ok], j[ok]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                node, root = forest(lists.sid[i], lists.sid[j])
                yield pd.DataFrame({"a": node[node != root], "b": root[node != root]})

    return pairs


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections, derived from the first set's: see the module's step 3."""
    first, n = sets[0], np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    tokens = np.concatenate(sets)
    in_first = np.isin(tokens, first, assume_unique=False)
    same = np.bincount(owner[in_first], minlength=len(sets))
    lacks = len(first) - same
    out = (len(first) - lacks[:, None] - lacks[None, :]).astype(np.float64)

    def add(rows: np.ndarray, ids: np.ndarray, n_ids: int) -> None:
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        for lo in range(0, n_ids, chunk):
            a, b = np.searchsorted(ids, [lo, lo + chunk])
            x = np.zeros((len(sets), min(chunk, n_ids - lo)), np.float32)
            x[rows[a:b], ids[a:b] - lo] = 1
            out[:] += x @ x.T

    # What sets add to the first one's tokens; an addition of one set alone is in no overlap of two.
    extra, count = np.unique(tokens[~in_first], return_counts=True)
    shared = extra[count > 1]
    rows, values = owner[~in_first], tokens[~in_first]
    if len(shared):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        keep = shared[at] == values
        add(rows[keep], at[keep], len(shared))
    # What sets lack of the first one's tokens.
    missing = [np.flatnonzero(~np.isin(first, s, assume_unique=True)) for s in sets]
    add(np.repeat(np.arange(len(sets)), lacks), np.concatenate(missing).astype(np.int64), len(first))
    return np.rint(out).astype(np.int64)


def exact_links(percent: int):
    """A task over sets sorted by (root, cell): their links' forest and numbers of linked documents."""

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, ["root", "cell"]):
            out = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo < 2:
                    continue
                part = frame.iloc[lo:hi]
                sets = [np.frombuffer(b, np.uint64) for b in part["tokens"]]
                n, sid = np.array([len(s) for s in sets]), part["sid"].to_numpy()
                linked = overlaps(sets) >= needed(n[:, None], n[None, :], percent)
                block = part["block"].to_numpy()
                linked &= part["single"].to_numpy()[:, None] | (block[:, None] != block[None, :])
                linked &= ~np.eye(len(sid), dtype=bool)
                i, j = np.nonzero(linked)
                if len(i):
                    node, root = forest(sid[i], sid[j])
                    copies = part["copies"].to_numpy()
                    total = pd.Series(linked @ copies, index=sid)
                    out.append(pd.DataFrame({"sid": node, "parent": root, "links": total.loc[node].to_numpy()}))
            if out:
                yield pd.concat(out)

    return links


def _cells(df: DataFrame, size: str, block: int, by: str = "sid") -> DataFrame:
    """Deals rows of large groups out as pairs of blocks: cell, block, and whether both blocks are one."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(by), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    return (
        df.withColumn("block", own).withColumn("other", other)
        .withColumn("cell", F.least("block", "other") * n + F.greatest("block", "other"))
        .withColumn("single", F.col("block") == F.col("other")).drop("other")
    )


def join_classes(docs: DataFrame, k: int = 3, percent: int = 90, keyed: bool = False) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_shingles, component_id, n_links, and with `keyed` text_hash, class_id.

    n_links: how many other documents the document links to. text_hash tells rows of one id, or
    of none, apart; class_id is the same for all rows of a class, null for those without words.
    """
    spark = docs.sparkSession
    # The text's own hash tells rows without an id apart.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(k)
        for frame in frames:
            sets = [shingles.of(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "hash": frame["hash"], "sid": [shingles.name(s) for s in sets],
                "n": [len(s) for s in sets], "bits": [bitmap(s, percent) if len(s) else b"" for s in sets],
            })

    def prefix(heavy):
        def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingles, seen, last = Shingles(k), set(), heavy.value
            for frame in frames:
                tokens, sids, ns, poss = [], [], [], []
                for t in frame["text"]:
                    s = shingles.of(t)
                    sid = shingles.name(s)
                    if not len(s) or sid in seen:  # a copy's set is in the index once a task
                        continue
                    seen.add(sid)
                    if len(last):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        late = last[at] == s
                        s = np.concatenate([s[~late], s[late]])
                    p = len(s) - -(-percent * len(s) // 100) + 1
                    tokens.append(s[:p])
                    sids += [sid] * p
                    ns += [len(s)] * p
                    poss.append(np.arange(p))
                if tokens:
                    yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "sid": sids, "n": ns, "pos": np.concatenate(poss)})

        return rows.select("text").mapInPandas(entries, "token long, sid long, n int, pos int")

    meta = written(rows.mapInPandas(measure, "doc_id long, hash long, sid long, n int, bits binary"), "jaccard-meta")
    # `row` leads to one of the set's texts: the one with the smallest id.
    sets = meta.where("n > 0").groupBy("sid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("row"), F.first("bits").alias("bits"),
    )
    none = spark.sparkContext.broadcast(np.empty(0, np.uint64))
    held = prefix(none).groupBy("token").count()
    # Not more than MOST_HEAVY tokens can have so many entries.
    entries = meta.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    many = held.where(F.col("count") >= max(HEAVY, int(entries // MOST_HEAVY))).select("token").toPandas()["token"].to_numpy(np.int64)
    heavy = spark.sparkContext.broadcast(np.sort(many.view(np.uint64)))
    index = prefix(heavy).repartition("token").groupBy("token", "sid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    # Lists of two and more, with their lengths.
    listed = index.withColumn("length", F.count("*").over(Window.partitionBy("token"))).where("length > 1")
    entries = listed.join(sets.select("sid", "bits"), "sid")
    dealt = _cells(entries, "length", LIST_BLOCK).repartition("token", "cell").sortWithinPartitions("token", "cell", "n")
    likely = dealt.select("token", "cell", "block", "single", "sid", "n", "pos", "bits").mapInPandas(candidate_edges(percent), "a long, b long")
    groups = written(components(likely, "jaccard-likely"), "jaccard-groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    wanted = groups.join(sizes, "root").join(sets.select("sid", "copies", "row"), groups["node"] == F.col("sid")).select("row.doc_id", "row.hash", "sid", "root", "members", "copies")

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen = Shingles(k), set()
        for frame in frames:
            got = [shingles.of(t) for t in frame["text"]]
            frame["tokens"] = [s.tobytes() for s in got]
            # The wanted row may be there several times.
            fits = np.array([shingles.name(s) == w and not (w in seen or seen.add(w)) for s, w in zip(got, frame["sid"], strict=True)], dtype=bool)
            yield frame.loc[fits, ["sid", "root", "members", "copies", "tokens"]]

    payload = (
        rows.join(wanted, (rows["hash"] == wanted["hash"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "sid", "root", "members", "copies")
        .mapInPandas(tokens, "sid long, root long, members long, copies long, tokens binary")
    )
    dealt = _cells(payload, "members", SET_BLOCK).repartition("root", "cell").dropDuplicates(["root", "cell", "sid"]).sortWithinPartitions("root", "cell", "sid")
    links = written(
        dealt.select("root", "cell", "block", "single", "sid", "copies", "tokens").mapInPandas(exact_links(percent), "sid long, parent long, links long"), "jaccard-links"
    )
    classes = components(links.select(F.col("sid").alias("a"), F.col("parent").alias("b")), "jaccard-classes")
    degrees = links.groupBy("sid").agg(F.sum("links").alias("links"))
    known = sets.select("sid", "copies", "doc_id").join(classes.withColumnRenamed("node", "sid"), "sid", "left").join(degrees, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = known.join(smallest, "root").select("sid", "root", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    full = meta.where("n > 0").select("doc_id", "hash", "sid", "n").join(by_set, "sid").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", F.col("hash").alias("text_hash"), F.col("root").alias("class_id")
    )
    nothing = F.lit(0).cast("long")
    empty = meta.where("n = 0").select(
        "doc_id", nothing.alias("n_shingles"), F.col("doc_id").alias("component_id"), nothing.alias("n_links"), F.col("hash").alias("text_hash"), F.lit(None).cast("long").alias("class_id")
    )
    classes_ = full.unionByName(empty)
    return classes_ if keyed else classes_.drop("text_hash", "class_id")
