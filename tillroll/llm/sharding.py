"""Sharding by a k-d tree over document metadata.

Every node of the tree splits along its widest metadata dimension at the weighted median, the
weights being bytes, until a leaf is at its share of the bytes. A median is found by radix
search: documents are ordered by a 40-bit number (the dimension on a scale of 2^20 steps, then
20 bits of hash), and each of four rounds sums the bytes of 1024 cells and goes on in the cell
that holds the middle. A round moves one row for each cell, never the documents, and equal
values of a dimension, even of all documents, are still split by their hash.

Defined results: a null text has no bytes and the size 1; null metadata sorts first; repeated
rows are split like any others, by a number that is fixed when the sizes are written; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.storage import written

#: Steps of a scaled dimension and of the hash behind it, and of one round of the search.
STEPS, ROUND = 1 << 20, 1 << 10
DIMENSIONS = ("d_size", "d_lang", "d_source")


def _measured(docs: DataFrame) -> DataFrame:
    """Sizes and metadata, each dimension from 0 to 1."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")) / F.lit(float(1 << 32)), F.lit(0.0))
    size, crc = (F.octet_length(data) + 1).cast("long"), F.crc32(data)
    return docs.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"),
        (F.log2(size.cast("double")) / 32).alias("d_size"), place("lang").alias("d_lang"), place("source").alias("d_source"),
        F.xxhash64("doc_id", size, crc, F.monotonically_increasing_id()).alias("hash"),
    )


def _few(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Some rows known to the driver (of nodes), as a literal: no file, no Python worker."""
    columns = [c.split() for c in schema.split(", ")]
    kinds = ", ".join(f"{name}: {kind}" for name, kind in columns)
    values = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*values).cast(f"array<struct<{kinds}>>")))


def _medians(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node the number below which documents go left: (node, cut)."""
    found = nodes.select("node", "goal", F.lit(0).cast("long").alias("cut"))
    width = STEPS * STEPS
    while width > 1:
        step = width // ROUND
        cells = (
            rows.join(F.broadcast(found), "node")
            .where((F.col("place") >= F.col("cut")) & (F.col("place") < F.col("cut") + width))
            .groupBy("node", F.floor((F.col("place") - F.col("cut")) / step).alias("cell"))
            .agg(F.sum("size").alias("cell_size"), F.first("goal").alias("goal"), F.first("cut").alias("cut"))
        )
        upto = F.sum("cell_size").over(Window.partitionBy("node").orderBy("cell"))
        # The first cell in which the sum reaches the goal holds the cut.
        at = cells.withColumn("upto", upto).where("upto >= goal").groupBy("node").agg(
            F.min_by(F.struct(F.col("goal") - (F.col("upto") - F.col("cell_size")), F.col("cut") + F.col("cell") * step, F.col("cell_size")), "cell").alias("at")
        )
        # One row for each node: the tree, not the documents.
        cut = F.col("at.col2")
        if step == 1:  # the last cell goes to the side that gets nearer to its goal with it
            cut = cut + (F.col("at.col1") * 2 > F.col("at.cell_size")).cast("long")
        kept = at.select("node", F.col("at.col1").alias("goal"), cut.alias("cut")).collect()
        found = _few(rows.sparkSession, kept, "node long, goal double, cut long")
        width = step
    return found.select("node", F.col("cut"))


def shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """docs (doc_id, text, lang, source) as doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Either the number of leaves is given or their target size. `slot` counts the documents of a
    shard without gaps. The law is `bytes`: sizes are near equal; `grown_shard` is null. The
    tree (a row for each node) is held by the driver, the documents never are.
    """
    rows = written(_measured(docs), "shard-rows").withColumn("node", F.lit(0).cast("long"))
    if leaves is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, -(-total // target_bytes))
    schema = "node long, shards int"
    split, done, level = [(0, leaves)], [], 0
    while any(n > 1 for _, n in split):
        parts = _few(rows.sparkSession, split, schema)
        spread = rows.groupBy("node").agg(
            F.sum("size").alias("node_size"),
            *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))],
        )
        widest = F.array_max(F.array(*[F.struct((F.col(f"high_{d}") - F.col(f"low_{d}")).alias("w"), F.lit(d).alias("d"), F.col(f"low_{d}").alias("low")) for d in DIMENSIONS]))
        nodes = spread.join(parts, "node").where("shards > 1").select(
            "node", "shards", (F.col("node_size") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("goal"), widest.alias("widest"),
        )
        # One row for each node, read again in every round.
        nodes = rows.sparkSession.createDataFrame(nodes.collect(), nodes.schema)
        value = F.coalesce(*[F.when(F.col("widest.d") == d, F.col(d)) for d in DIMENSIONS])
        scaled = F.when(F.col("widest.w") > 0, F.least(F.lit(STEPS - 1), F.floor((value - F.col("widest.low")) / F.col("widest.w") * STEPS))).otherwise(F.lit(0))
        placed = rows.join(F.broadcast(nodes.select("node", "shards", "widest")), "node", "left").withColumn(
            "place", scaled.cast("long") * STEPS + F.pmod("hash", F.lit(STEPS))
        )
        placed = written(placed.select(rows.columns + ["shards", "place"]), f"shard-level{level}")
        cuts = _medians(placed.where("shards is not null"), nodes)
        side = F.when(F.col("cut").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + (F.col("place") >= F.col("cut")).cast("long"))
        rows = placed.join(F.broadcast(cuts), "node", "left").select(*[c for c in rows.columns if c != "node"], side.alias("node"))
        split = [x for node, n in split for x in ([(2 * node, n // 2), (2 * node + 1, n - n // 2)] if n > 1 else [(2 * node, 1)])]
        level += 1
    numbers = _few(rows.sparkSession, [(node, i) for i, (node, _) in enumerate(sorted(split))], "node long, shard int")
    rows = rows.join(F.broadcast(numbers), "node").withColumn("range", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(4096)))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "range").orderBy("hash", "doc_id", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(ranges, ["shard", "range"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("ahead") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
