"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined to the positions they have in license
templates. A hit at word i of a text and word j of a template votes for the diagonal i - j;
votes are gathered by diagonal, neighbouring diagonals (words put in or left out) are merged,
and the merged spans are verified: enough of the template's k-grams, in a span not much longer
than the template. The base phrases are templates whose every k-gram must be on one diagonal.

Texts are read once. Words that no template has are 0, the others are numbered, so the number
that rolls along a text, of k words each, stands for exactly one k-gram of known words: a hash
without collisions. Of a text only the places of templates' k-grams leave the task.

Defined results: a null text is an empty one; a text without hits has no labels, null places
and the score 0; repeated rows have equal results; an empty table gives an empty result; extra
columns are ignored. Templates may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.columns import text_of
from tillroll.llm.lexical import terms_of
from tillroll.llm.license_texts import BODIES, HEADS
from tillroll.llm.storage import written

# Words, and the base phrases with their labels.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = HEADS | BODIES
#: Words in a k-gram; diagonals this near merge; share of a template to find; span per template word.
K, BAND, COVER, STRETCH = 3, 4, 0.6, 1.5


def template_grams() -> list[tuple[str, int, int, bool, str, int]]:
    """(k-gram, position, number of the template, is base, label, different places of k-grams in it)."""
    rows = []
    for number, (text, label) in enumerate([*BASE.items(), *TEMPLATES.items()]):
        words = [w.decode() for w in terms_of(text.encode())]
        n = len(words) - K + 1
        rows += [(" ".join(words[j : j + K]), j, number, number < len(BASE), label, n) for j in range(n)]
    return rows


@cache
def vocabulary() -> dict[bytes, int]:
    """Numbers from 1 for the templates' words."""
    return {w.encode(): i for i, w in enumerate(sorted({w for gram, *_ in template_grams() for w in gram.split()}), 1)}


def rolled(numbers: np.ndarray) -> np.ndarray:
    """The number of each k-gram of numbered words."""
    base, n = len(vocabulary()) + 1, len(numbers) - K + 1
    total = np.zeros(max(0, n), np.int64)
    for d in range(K):
        total = total * base + numbers[d : d + len(total)]
    return total


def _places(rows: DataFrame) -> DataFrame:
    """row, doc_id, n_words, hits: (word, number of the k-gram) of each k-gram that a template has."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary()
        grams = np.unique([rolled(np.array([known[w.encode()] for w in gram.split()])) for gram, *_ in template_grams()])
        get = known.get
        for frame in frames:
            sizes, places, numbers = [], [], []
            for text in frame["text"]:
                words = terms_of(text.encode("utf-8", "surrogatepass"))
                sizes.append(len(words))
                codes = rolled(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
                at = np.flatnonzero(np.isin(codes, grams))
                places.append(at.astype(np.int32))
                numbers.append(codes[at])
            yield pd.DataFrame({"row": frame["row"], "doc_id": frame["doc_id"].astype("Int64"), "n_words": sizes, "places": places, "grams": numbers})

    return rows.mapInPandas(find, "row long, doc_id long, n_words long, places array<int>, grams array<long>")


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    scanned = written(_places(rows), "license-places")
    number = lambda gram: int(rolled(np.array([vocabulary()[w.encode()] for w in gram.split()]))[0])
    known = [(number(gram), *rest) for gram, *rest in template_grams()]
    # Broadcast: the k-grams of a fixed list of templates.
    known = F.broadcast(docs.sparkSession.createDataFrame(known, "gram long, j int, template int, base boolean, label string, n int"))
    every = scanned.where(F.size("places") > 0).select("row", F.inline(F.arrays_zip(F.col("places").alias("i"), F.col("grams").alias("gram"))))
    diagonals = every.join(known, "gram").groupBy("row", "template", "base", "label", "n", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.collect_set("j").alias("found"), F.min("i").alias("low"), (F.max("i") + K).alias("high")
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > BAND) | F.col("base")
    spans = (
        diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .groupBy("row", "template", "base", "label", "n", "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("score", F.col("found") / F.col("n"))
        .where(
            F.when(F.col("base"), F.col("found") == F.col("n"))
            .otherwise((F.col("score") >= COVER) & (F.col("high") - F.col("low") <= (F.col("n") + K - 1) * STRETCH))
        )
    )
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    place = F.when(F.col("base"), F.col("low"))
    found = spans.groupBy("row").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max("score").alias("score"),
    )
    return scanned.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"('{g}', {j}, {t}, {str(b).lower()}, '{label}', {n})" for g, j, t, b, label, n in template_grams())
    return rf"""
    WITH known(gram, j, template, base, label, n) AS (VALUES {values}),
    d AS (SELECT row_number() OVER () AS key, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM documents),
    g AS (SELECT key, i - 1 AS i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
          FROM (SELECT key, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= {K})),
    hits AS (SELECT *, i - j AS diagonal FROM g JOIN known USING (gram)),
    marked AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > CASE WHEN base THEN 0 ELSE {BAND} END, true)::INT AS new
               FROM hits WINDOW w AS (PARTITION BY key, template ORDER BY diagonal)),
    spanned AS (SELECT *, sum(new) OVER (PARTITION BY key, template ORDER BY diagonal) AS span FROM marked),
    spans AS (SELECT key, template, base, label, n, span, count(DISTINCT j) / n AS score, min(i) AS low, max(i) + {K} AS high
              FROM spanned GROUP BY key, template, base, label, n, span
              HAVING CASE WHEN base THEN count(DISTINCT j) = n
                     ELSE count(DISTINCT j) / n >= {COVER} AND max(i) + {K} - min(i) <= (n + {K} - 1) * {STRETCH} END),
    per AS (SELECT key, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
            FROM spans GROUP BY key)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN per USING (key)"""
