"""A training corpus in four stages, each over all that its predecessor kept.

Quality: documents that the classifier rejects go. Near duplicates: of each class of documents
linked by five-word shingles (Jaccard 0.8 or more) the one with the smallest id stays. Mixing:
sources are brought to their target weights, documents repeated by epochs. Packing: best-fit
sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import jaccard, mixing, packing, quality
from tillroll.llm.columns import text_of
from tillroll.llm.queries import TOKENIZER
from tillroll.llm.storage import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.7; the labels are those of the scale factor."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc"))
    return quality.classify(whole, labels, keep=("doc",)).where("predicted = 1").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id (rows without an id last).

    A row is known by its id and its text's hash: rows of one id with different texts are
    different documents. Documents without words are no class; rows repeated in full stay once.
    """
    row = lambda doc_id, text_hash: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_hash.cast("string"))
    classes = jaccard.join_classes(docs, k=5, percent=80, keyed=True)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    linked = classes.where("class_id is not null").groupBy("class_id").agg(F.min(order).alias("least")).select(row(F.col("least.doc_id"), F.col("least.text_hash")).alias("_row"))
    alone = classes.where("class_id is null").select(row(F.col("doc_id"), F.col("text_hash")).alias("_row")).distinct()
    named = docs.select(F.struct(*docs.columns).alias("doc"), row(F.col("doc_id"), F.xxhash64(text_of())).alias("_row"))
    return named.join(linked.unionByName(alone), "_row").groupBy("_row").agg(F.first("doc").alias("doc")).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last one of a source as far, as the targets take them."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
