"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its words with their numbers of occurrences. Each of the
samples draws for every term from hashes of the term and the sample's number: r and c of
Gamma(2, 1), b of [0, 1). With t = floor(ln w / r + b) the term bids ln c - r (t - b + 1); the
least bid's (term, t) is the sample. Two documents have a sample in common with a probability
that is their generalised Jaccard similarity, sum of minima by sum of maxima of the weights.

Only DataFrame functions are used. Samples are folded where the terms are made: a bid and its
sample are one number, so that what is shuffled of a document is one minimum for each sample.

Defined results: a null text is an empty one; texts without words have a fingerprint of their
own, alike to each other (1.0) and to nothing else; rows with equal id and text are one document
that is listed several times; null ids come first; a single document is its own next one; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.columns import WORD, row_key, text_of
from tillroll.llm.storage import written

#: Samples of a fingerprint. The likeness of two has a standard error of 0.5 / sqrt(SAMPLES) at most.
SAMPLES = 48
#: Bits of a uniform number, of a sample's name; steps of a bid per unit.
UNIFORM, NAME, STEPS = 30, 31, 1 << 23
#: Bits of a term's hash and of its number of occurrences, which stops at the highest one.
TERM, WEIGHT = 40, 24


def words(text: Column) -> Column:
    """The words of a text, and empty texts between blanks that follow each other."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def terms(text: Column) -> Column:
    """Sorted numbers of the distinct words: TERM bits of hash, then WEIGHT bits of how often they occur."""
    name = lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - TERM)
    hashes = F.array_remove(F.sort_array(F.transform(words(text), name)), name(F.lit("")))

    def runs(h: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == 1) | (F.get(h, i - 1) != F.get(h, i - 2)))
        ends = F.slice(F.concat(at, F.array(F.size(h) + 1)), 2, F.size(at))
        most = F.lit((1 << WEIGHT) - 1)
        return F.zip_with(at, ends, lambda a, b: F.shiftleft(F.get(h, a - 1), WEIGHT) + F.least((b - a).cast("long"), most))

    # A one-element array holds the hashes, so that they are computed once.
    return F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(F.array(F.lit(1).cast("long")))), 1)


def bid(sample: int) -> Column:
    """Bid and name of columns term and ln_w in one number, the smaller the better."""
    one = F.xxhash64("term", F.lit(sample))
    two = F.xxhash64(one)
    three = F.xxhash64(two)
    uniform = lambda h: (h.bitwiseAND(F.lit((1 << UNIFORM) - 1)) + F.lit(0.5)) * F.lit(2.0**-UNIFORM)
    high = lambda h: F.shiftrightunsigned(h, 64 - UNIFORM)
    r = -F.ln(uniform(one) * uniform(high(one)))
    c = -F.ln(uniform(two) * uniform(high(two)))
    b = uniform(three)
    t = F.floor(F.col("ln_w") / r + b)
    value = F.ln(c) - r * (t - b + 1)
    name = F.xxhash64("term", t, F.lit(sample)).bitwiseAND(F.lit((1 << NAME) - 1))
    return F.shiftleft(((value + 128) * STEPS).cast("long"), NAME) + name


def signatures(rows: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """rows (by, left, right: terms of two texts) as by, sig, other_sig: the names of the samples.

    A term that both texts have equally often draws once for both. Rows that are dealt out by one
    of the columns ``by`` are folded where they are.
    """
    parts = [F.array_except(left, right), F.array_except(right, left), F.array_intersect(left, right)]
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), p.alias("terms")) for i, p in enumerate(parts)])).alias("part"))
    each = each.select(*by, "part.side", F.explode("part.terms").alias("number")).select(
        *by, "side", F.shiftrightunsigned("number", WEIGHT).alias("term"), F.ln(F.col("number").bitwiseAND(F.lit((1 << WEIGHT) - 1)).cast("double")).alias("ln_w")
    )
    least = each.groupBy(*by, "side").agg(*[F.min(bid(i)).alias(f"s{i}") for i in range(SAMPLES)])
    of = lambda side, i: F.min(F.when(F.col("side") != 1 - side, F.col(f"s{i}")))
    both = least.groupBy(*by).agg(*[of(side, i).alias(f"s{side}_{i}") for side in (0, 1) for i in range(SAMPLES)])
    sig = lambda side: F.array(*[F.col(f"s{side}_{i}").bitwiseAND(F.lit((1 << NAME) - 1)).cast("int") for i in range(SAMPLES)])
    return both.select(*by, sig(0).alias("sig"), sig(1).alias("other_sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(SAMPLES))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _in_order(ids: DataFrame) -> DataFrame:
    """ids (key, doc_id, ...) with next_key, by ascending doc_id; the last one's next is the first."""
    ranged = written(ids.repartitionByRange("doc_id", "key").withColumn("part", F.spark_partition_id()), "cws-order")
    # One row for each partition.
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    along = Window.orderBy("part")
    follows = firsts.select("part", F.coalesce(F.lead("first.key").over(along), F.first("first.key").over(along)).alias("follows"))
    inside = Window.partitionBy("part").orderBy("doc_id", "key")
    return (
        ranged.withColumn("next_key", F.lead("key").over(inside)).join(F.broadcast(follows), "part")
        .withColumn("next_key", F.coalesce("next_key", "follows")).drop("part", "follows")
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the document replaced by the first part of the next one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = rows.select("doc_id", "text", row_key(F.col("text"), F.col("doc_id")).alias("key"))
    ids = keyed.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars")).groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies")
    )
    order = written(_in_order(ids), "cws-next")
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # What each document gets of its next one travels to it; the texts themselves move once.
    heads = texts.withColumnRenamed("key", "next_key").join(order.select("key", "next_key", half.alias("half")), "next_key").select(
        "key", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head")
    )
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), "head")
    pairs = texts.join(heads, "key").join(order, "key").select("key", "text", edited.alias("edited"))
    drawn = pairs.select("key", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), terms(F.col("text")).alias("terms"), terms(F.col("edited")).alias("edited_terms"))
    signed = signatures(drawn, ["key", "sha"], "terms", "edited_terms")
    held = written(signed.select("key", F.col("sha").alias("edited_sha256"), "sig", F.col("other_sig").alias("edited_sig")), "cws-signatures")
    following = order.select("key", "next_key").join(held.select(F.col("key").alias("next_key"), F.col("sig").alias("next_sig")), "next_key").select("key", "next_sig")
    return (
        held.join(order, "key").join(following, "key")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
            likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
        )
    )
