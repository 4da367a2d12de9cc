"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a fixed set of numbers (shares of character kinds, word and line statistics).
Cyclic boosting fits shallow trees, one feature at a time in turn, to the residuals of a
logistic model; a feature's trees add up to a lookup table over its bins. Then the pairs with
the strongest remaining signal get tables of their own over coarser bins. Scoring is vectorised:
bin each feature, add table entries.

The model is fitted on a bounded sample of the labelled rows, those with the smallest hashes
(`sample` rows at most, a parameter); everything else reads all rows and whole texts.

Defined results: a null text is scored as an empty one; labelled rows without a quality or
without a document teach nothing; a document labelled twice counts once for each label; without
any labels, or with one class only, every score is the share of label 1 (0.5 without labels);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.columns import text_of

SAMPLE, THRESHOLD, FOLDS, HELD_OUT = 20_000, 0.7, 4, 2

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "upper", "digits", "non_ascii",
    "sentence_ends", "commas", "symbols", "exclamations", "pipes", "hashes_stars", "percent_and", "at_signs", "newlines",
    "mean_line", "repeated_lines", "repeated_bytes", "short_lines", "entropy",
)

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "sentence_ends": b".?", "commas": b",;:",
    "symbols": b"!\"#$%&'()*+-/<=>@[\\]^_`{|}~", "exclamations": b"!", "pipes": b"|", "hashes_stars": b"#*",
    "percent_and": b"%&$", "at_signs": b"@", "newlines": b"\n",
}


def features(text: str) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES."""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    share = {k: counts[list(v)].sum() / n for k, v in _KINDS.items()}
    words = data.split()
    by_word = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    by_line = Counter(lines)
    m, k = max(1, len(words)), max(1, len(lines))
    p = counts[counts > 0] / n
    got = {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)), "mean_word": sum(map(len, words)) / m,
        "long_words": sum(len(w) > 20 for w in words) / m, "distinct_words": len(by_word) / m, "top_word": max(by_word.values(), default=0) / m,
        "non_ascii": counts[128:].sum() / n, "mean_line": len(data) / k, "repeated_lines": 1 - len(by_line) / k,
        "repeated_bytes": sum(len(x) * c for x, c in by_line.items() if c > 1) / n, "short_lines": sum(len(x) < 20 for x in lines) / k,
        "entropy": float(-(p * np.log2(p)).sum()),
    } | share
    return [float(got[f]) for f in FEATURES]


@dataclass
class Additive:
    """Lookup tables over bins: base + sum of one table a feature + one a pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _leaf(g, h, ridge: float = 1.0):
    return g / (h + ridge)


def _stump(g: np.ndarray, h: np.ndarray, axis: int | None = None, depth: int = 2) -> np.ndarray:
    """A shallow tree over the bins of a table of gradients and curvatures: its leaf values by bin."""
    if depth == 0 or h.sum() < 2 or g.size < 2:
        return np.full(g.shape, _leaf(g.sum(), h.sum()))
    best, where = 1e-9, None
    for ax in range(g.ndim):
        other = tuple(a for a in range(g.ndim) if a != ax)
        cg, ch = np.cumsum(g.sum(axis=other))[:-1], np.cumsum(h.sum(axis=other))[:-1]
        if not len(cg):
            continue
        rg, rh = g.sum() - cg, h.sum() - ch
        gain = np.where((ch >= 1) & (rh >= 1), cg * _leaf(cg, ch) + rg * _leaf(rg, rh) - g.sum() * _leaf(g.sum(), h.sum()), 0)
        if gain.max() > best:
            best, where = gain.max(), (ax, int(gain.argmax()) + 1)
    if where is None:
        return np.full(g.shape, _leaf(g.sum(), h.sum()))
    ax, at = where
    parts = [_stump(*(np.take(t, r, axis=ax) for t in (g, h)), depth=depth - 1) for r in (range(at), range(at, g.shape[ax]))]
    return np.concatenate(parts, axis=ax)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, bins: int = 32, coarse: int = 8) -> Additive:
    """Cyclic boosting of shallow trees: first all single features, then the best pairs."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Additive(base=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    cut = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]
    model = Additive(base=float(np.log(share / (1 - share))), edges=cut(bins), coarse=cut(coarse))
    place = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = residuals()
            step = rate * _stump(*(np.bincount(place[j], w, len(table)) for w in (g, h)))
            table += step
            f += step[place[j]]

    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
    cell = lambda i, j: wide[i] * shape(i, j)[1] + wide[j]
    both = lambda i, j, ws: [np.bincount(cell(i, j), w, np.prod(shape(i, j))).reshape(shape(i, j)) for w in ws]
    g, h = residuals()
    gains = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            pg, ph = both(i, j, (g, h))
            gains[i, j] = float((_stump(pg, ph) * pg).sum())
    for i, j in sorted(gains, key=gains.get, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros(shape(i, j))))
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _stump(*both(i, j, residuals()))
            table += step
            f += step[wide[i], wide[j]]
    return model


def held_out(doc_id):
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


_FEATURES_SCHEMA = "y double, " + ", ".join(f"{f} double" for f in FEATURES)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fits on the labelled rows outside the held-out fold, at most `sample` of them."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([[y, *features(t)] for y, t in zip(frame["y"], frame["text"], strict=True)], columns=["y", *FEATURES])

    # One row for each labelled id and label, the least text of it: as many as the sample, however often an id is repeated.
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = texts.select("y", "text").mapInPandas(extract, _FEATURES_SCHEMA)
    # Sorted, so that the fit doesn't depend on the order in which tasks end.
    data = np.array(sorted(tuple(r) for r in rows.collect())).reshape(-1, 1 + len(FEATURES))
    return fit(data[:, 1:], data[:, 0])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) as doc_id, held_out, score, predicted, with the columns `keep`."""
    # The tables: some hundred numbers.
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

    scored = docs.select(*{c: None for c in ("doc_id", *keep)}, score(text_of()).alias("score"), held_out(F.col("doc_id")).alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
