"""Chat formatting: collapse of cumulative snapshots.

A chat log often stores the same conversation again after every turn. Rolling hashes of the
turn prefixes find such snapshots: the hash of the first n turns is the exclusive-or of n
hashes, each of a turn with its position (128 bits), so it rolls along a window and can be
carried over from one stretch of a long conversation to the next. A conversation whose last
prefix hash is an inner prefix hash of another one is a snapshot; an anti-join leaves the
maximal conversations, which are then rendered.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated rows are
turns like any other; a null role or text differs from an empty one while hashing and is
rendered empty; a null conv_id is one conversation; of equal conversations the one with the
smallest conv_id stays; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.storage import written

#: Turn numbers in one stretch: what a task sorts and a rendered part holds.
STRETCH = 1024


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with position, prefix hash (h1, h2) and stretch."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumns({
        "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("-")),
        "stretch": F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))).cast("long"),
    })
    ahead = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv", "stretch").agg(F.count("*").alias("n")).select(
        "conv", "stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.row_number().over(Window.partitionBy("conv").orderBy("stretch")).alias("part")
    )
    inside = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text")
    placed = rows.withColumn("i", F.row_number().over(inside)).join(before, ["conv", "stretch"]).withColumn("position", F.col("before") + F.col("i"))
    digest = F.sha2(F.concat_ws("|", F.col("position").cast("string"), F.length("role").cast("string"), part("role"), part("text")).cast("binary"), 256)
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    hashed = written(placed.withColumn("digest", digest).withColumns({"x1": half(1), "x2": half(16)}).drop("digest", "before"), "chat-turns")
    sums = hashed.groupBy("conv", "stretch").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2")).select(
        "conv", "stretch", *[F.coalesce(F.bit_xor(s).over(ahead), F.lit(0)).alias(f"before_{s}") for s in ("s1", "s2")]
    )
    rolling = Window.partitionBy("conv", "stretch").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumns({"r1": F.bit_xor("x1").over(rolling), "r2": F.bit_xor("x2").over(rolling)})
        .join(sums, ["conv", "stretch"])
        .select(
            "conv", "conv_id", "stretch", "part", "position", "role", "text",
            F.col("r1").bitwiseXOR(F.col("before_s1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("before_s2")).alias("h2"),
        )
    )


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, part, n_turns, n_copies, rendered.

    A conversation has one row for every stretch of 1024 turn numbers (part 1, 2, ...; nearly
    always one); its parts in order are its rendering. n_turns: turns of the whole
    conversation; n_copies: equal conversations that the row stands for, itself included.
    """
    hashes = written(prefixes(turns), "chat-prefixes")
    key = ["position", "h1", "h2"]
    lengths = hashes.groupBy("conv").agg(F.max_by(F.struct(*key), "position").alias("last"), F.first("conv_id").alias("conv_id"))
    ends = lengths.groupBy(*[F.col(f"last.{k}").alias(k) for k in key]).agg(
        F.min(F.struct("conv_id", "conv")).alias("first"), F.count("*").alias("n_copies")
    )
    # Inner prefixes: those that are not their own conversation's end. Distinct, so that a
    # first turn that a third of all conversations share is one row.
    inner = hashes.select("conv", *key).join(lengths.select("conv", F.col("last.position").alias("n")), "conv").where("position < n").select(*key).distinct()
    maximal = ends.join(inner, key, "left_anti").select(F.col("first.conv").alias("conv"), F.col("position").alias("n_turns"), "n_copies")
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", turn.alias("turn")))), lambda t: t["turn"]), "")
    return (
        hashes.join(maximal, "conv")
        .groupBy("conv", "part", "n_turns", "n_copies")
        .agg(F.first("conv_id").alias("conv_id"), rendered.alias("rendered"))
        .select("conv_id", F.col("part").cast("int").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")
    )
