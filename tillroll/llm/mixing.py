"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted by
that key: ranges of the key are dealt out as partitions, the word totals of the ranges are
summed up first, and each range then sums up its own rows, so a source of any size is never
sorted in one task. The prefix sums tell for every document how much of it the source's
budget takes in the last, incomplete epoch; full epochs take everything.

Defined results: a null text has size 0 and takes nothing; null sources are a source of their
own, last in order; repeated rows each count; a table without words has targets of 0; an empty
table gives an empty result. Extra columns are ignored. The targets' table has one row for each
source and is the only thing that passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.columns import WORD, hash_bucket, text_of, word_count
from tillroll.llm.storage import written

#: Weights by the sources' order, repeating; the share of all words to take; the most epochs.
WEIGHTS, SHARE, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0


def targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """totals (src, source, source_size) with `target`: words to take from each source.

    A target stops at `epochs` times its source's size. Whoever is capped leaves its excess
    to the others by weight. With the sources sorted by cap per weight, that is one level:
    target = weight * level, where level is the first that the next source's cap allows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    capped = totals.select("*", w.alias("w"), (F.col("source_size") * epochs).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("w").over(after)
    levels = capped.withColumn("level", level)
    fits = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)
    return levels.select(
        "src", "source_size",
        F.least("cap", F.coalesce(fits["level"] * F.col("w"), F.col("cap"))).alias("target"),
    )


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, keep=()) -> DataFrame:
    """docs (doc_id, text, source) as doc_id, size, source_size, target, taken.

    taken: words the mix takes of the document, repeats counted. Each source's sum of it is
    its target without the fraction. `keep` names more columns to carry along.
    """
    text = text_of()
    # With the text's hash, as an id may be missing or repeated.
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(text).cast("string")).cast("binary"))
    sized = written(
        docs.select(
            "doc_id", "source", *keep, word_count(text).alias("size"), key.alias("key"),
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("src"),
        ).withColumn("range", hash_bucket(F.col("key"))),
        "mix",
    )
    ranges = sized.groupBy("src", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    totals = ranges.groupBy("src").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    ahead = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    budget = targets(totals, weights, share, epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    )
    offsets = (
        ranges.select("src", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
        .join(budget, "src")
        .withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    )
    inside = Window.partitionBy("src", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("ahead") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return (
        sized.withColumn("upto", F.sum("size").over(inside))
        .join(offsets, ["src", "range"])
        .select(
            "doc_id", *keep, "size", "source_size", "target",
            (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus, with the columns of docs.

    A document that the mix takes 1.4 times is there once whole and once with the first 0.4
    of its words (at most one document of a source is cut).
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    rest = F.col("taken") - whole * F.col("size")
    mixed = mix(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("doc")), keep=("doc",), **how)
    copies = mixed.select("doc", whole.cast("int").alias("times"), rest.cast("int").alias("rest"))
    full = copies.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    text = F.col("doc.text")
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    leading = F.when(text.rlike(f"^{WORD}"), 0).otherwise(1)
    cut = copies.where("rest > 0").withColumn("head", F.array_join(F.slice(pieces, 1, F.col("rest") + leading), ""))
    changed = {"text": F.col("head"), "n_chars": F.char_length("head").cast("long")}
    columns = [changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]
    return full.select("doc.*").unionByName(cut.select(columns))
