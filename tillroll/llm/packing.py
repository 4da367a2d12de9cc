"""Best-fit packing with a swap-based local search.

Documents are tokenized where they lie and cut into pieces of at most one sequence. Pieces of
one length are interchangeable, so the packing itself needs only how many there are of each
length: at most 2048 numbers, however large the corpus. On these, best-fit decreasing makes
classes of equal bins (contents, how many bins). The local search then exchanges one-for-one,
two-for-one or moves single pieces between underfull classes whenever this increases the sum
of squared fills, until bins empty or nothing improves. At last every piece learns its place
from its rank within its length; ranks are counted in ranges of a hash, so a length that a
third of all pieces share is never sorted in one task.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.columns import hash_bucket, text_of
from tillroll.llm.storage import written
from tillroll.llm.tokens import ByteLevelIds

SEQUENCE, END = 2048, 0

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], sequence: int = SEQUENCE) -> DataFrame:
    """docs (doc_id, text) as pieces: row (a number of the document), doc_id, piece, start, length, ids_crc32.

    tokenizer: the tokenizer's file, the rank file of its vocabulary, and the splitting pattern.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = ByteLevelIds(*tokenizer), array("I", [END]).tobytes()
        assert sys.byteorder == "little"
        for frame in frames:
            rows = []
            for row, doc, text in zip(frame["row"], frame["doc_id"], frame["text"], strict=True):
                data = encoder.of(text) + end
                n = len(data) // 4
                edges = [0, *range(n % sequence or sequence, n + 1, sequence)]
                rows += [(row, doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return numbered.mapInPandas(cut, PIECES)


Bin = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> Counter[Bin]:
    """Best-fit decreasing over numbers of equal pieces: classes of equal bins."""
    open_: dict[int, Counter[Bin]] = {}
    rests: list[int] = []
    closed: Counter[Bin] = Counter()

    def put(bin_: Bin, rest: int, n: int) -> None:
        if rest == 0:
            closed[bin_] += n
        elif n:
            if rest not in open_:
                open_[rest] = Counter()
                bisect.insort(rests, rest)
            open_[rest][bin_] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rests, length)
            if i < len(rests):
                rest = rests[i]
                bin_, n = next(iter(open_[rest].items()))
                each = rest // length
            else:
                rest, bin_, n, each = size, (), left, size // length
            used = min(n, left // each) or 1
            each = min(each, left)
            if i < len(rests):
                open_[rest][bin_] -= used
                if not open_[rest][bin_]:
                    del open_[rest][bin_]
                if not open_[rest]:
                    del open_[rest]
                    del rests[i]
            put((*bin_, (length, each)), rest - each * length, used)
            left -= used * each
    for bins in open_.values():
        closed.update(bins)
    return closed


def _without(bin_: Bin, lengths: tuple[int, ...], added: tuple[int, ...]) -> Bin:
    left = Counter(dict(bin_))
    left.subtract(lengths)
    left.update(added)
    return tuple(sorted(((k, v) for k, v in left.items() if v), reverse=True))


def _exchange(a: Bin, b: Bin, size: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What to take from a and from b so that b (the fuller one) gets fuller: best gain or None."""
    fill_a, fill_b = (sum(k * v for k, v in x) for x in (a, b))
    room = size - fill_b
    best, what = 0, None
    here, there = dict(a), dict(b)
    singles = sorted(here)
    pairs = {x + y: (x, y) for i, x in enumerate(singles) for y in singles[i:] if x != y or here[x] > 1}
    for gives in ((), *((y,) for y in there)):
        most = room + sum(gives)
        i = bisect.bisect_right(singles, most)
        if i and singles[i - 1] - sum(gives) > best:
            best, what = singles[i - 1] - sum(gives), ((singles[i - 1],), gives)
        if gives:
            two = max((s for s in pairs if s <= most), default=0)
            if two - sum(gives) > best:
                best, what = two - sum(gives), (pairs[two], gives)
    # With d more in b and d less in a the squares grow by 2d(fill_b - fill_a + d) > 0.
    return what if what and fill_b + best > fill_a else None


def local_search(bins: Counter[Bin], size: int = SEQUENCE) -> Counter[Bin]:
    """Empties underfull bins by exchanges that increase the sum of squared fills.

    The emptiest class gives to the fullest underfull one that can take something, whole
    classes at a time; a class that nothing can be taken from is left. Every step increases
    the squares, so the search ends; it stops early when no packing can have fewer bins.
    """
    fill = lambda b: sum(k * v for k, v in b)
    bins = Counter({b: n for b, n in bins.items() if n})
    least, number = -(-sum(fill(b) * n for b, n in bins.items()) // size), sum(bins.values())
    by_fill: dict[int, dict[Bin, None]] = defaultdict(dict)
    for b in sorted(bins, reverse=True):
        by_fill[fill(b)][b] = None
    todo = [(filled, b) for filled, some in by_fill.items() for b in some if filled < size]
    heapq.heapify(todo)
    while todo and number > least:
        filled, a = heapq.heappop(todo)
        if a not in bins:
            continue
        for b in (b for f in range(size - 1, filled - 1, -1) for b in list(by_fill.get(f, ()))):
            n = bins[a] // 2 if a == b else min(bins[a], bins[b])
            if not n or not (what := _exchange(a, b, size)):
                continue
            taken, given = what
            for old, new in ((a, _without(a, taken, given)), (b, _without(b, given, taken))):
                bins[old] -= n
                if not bins[old]:
                    del bins[old], by_fill[fill(old)][old]
                if not new:
                    number -= n
                    continue
                bins[new] += n
                by_fill[fill(new)][new] = None
                if fill(new) < size:
                    heapq.heappush(todo, (fill(new), new))
            if a in bins:
                heapq.heappush(todo, (filled, a))
            break
    return bins


def _places(bins: Counter[Bin]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, offset, pieces in each bin), by first rank."""
    rank: Counter[int] = Counter()
    out = defaultdict(list)
    first = 0
    for bin_, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in bin_:
            out[length].append((rank[length], first, offset, each))
            rank[length] += n * each
            offset += length * each
        first += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of docs (doc_id, text) with sequence_id and offset."""
    cut = pieces(docs, tokenizer, sequence)
    # By the document's number, so that repeated rows are dealt out too; written, it stays the same.
    key = F.md5(F.concat_ws(":", "row", "piece").cast("binary"))
    cut = written(cut.withColumn("key", key).withColumn("range", hash_bucket(F.col("key"))), "pieces")
    ranges = written(cut.groupBy("length", "range").count(), "piece-ranges")
    counts = {r["length"]: r["n"] for r in ranges.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = _places(local_search(best_fit(counts, sequence), sequence))
    ahead = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("length", "range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "range").orderBy("key", "start")
    ranked = cut.withColumn("i", F.row_number().over(inside) - 1).join(before, ["length", "range"]).withColumn("rank", F.col("before") + F.col("i"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequences, offsets = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length, rows in frame.groupby("length").indices.items():
                known, rank = places[length], frame["rank"].to_numpy()[rows]
                at = known[np.searchsorted(known[:, 0], rank, side="right") - 1]
                inside_bin = rank - at[:, 0]
                sequences[rows] = at[:, 1] + inside_bin // at[:, 3]
                offsets[rows] = at[:, 2] + inside_bin % at[:, 3] * length
            frame["sequence_id"], frame["offset"] = sequences, offsets
            yield frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(columns).mapInPandas(place, placed)
