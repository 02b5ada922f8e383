"""Document fingerprints by SpotSigs, in DataFrame and SQL functions only.

An anchor is a frequent word. Its signature is the anchor and the chain of the next `CHAIN` words that
are not anchors. Anchors lie all over running text and rarely in the same chains, so the set of
signatures of a text changes with its content, not with its layout. A fingerprint is the set of the
signatures' 64-bit hashes; two texts are as alike as the Jaccard similarity of their sets.

For near-duplicate search the sets are dealt out by size: sets of sizes a < b can't be more alike than
a / b, so a set meets its own size class and the next one only, where a class spans a factor of
1 / threshold. Inside, sets that share a signature among their rarest ones are compared, which loses no
pair at the threshold. Copies of a set are one set with members.

Words are lower-cased runs of letters and digits. Defined results: a text without an anchor takes every
word as one; a text without a word, and a null text, has one signature of its text, so equal texts have
equal fingerprints and likeness 1. Chains at the end of a text are shorter. Rows of equal doc_id are
separate documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalmap.llm.shards import shard_count
from shoalmap.session import cut

CHAIN = 2
THRESHOLD = 0.8
# Text per range of ids, and the most ranges whose floors are sent to the tasks.
RANGE_BYTES, MAX_RANGES = 16 << 20, 100_000
# Frequent words of four languages.
ANCHORS = (
    "the of and to in a is that for it on was be with as by this are at from not or an have but "
    "der die das und den von zu mit ist ein eine im dem nicht auf für sich als auch "
    "le la les de des et un une du que est dans pour qui sur pas au "
    "el en los las y se del por con para una su lo no al"
).split()


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str = "text", out: str = "signatures", chain: int = CHAIN) -> DataFrame:
    """Add the sorted set of signature hashes of a text column.

    An anchor that is word i of the text and the j-th anchor has i - j other words before it, so its chain
    starts at place i - j of the words that are not anchors: one pass, no search.
    """
    known = sorted(set(ANCHORS))
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_words", words_of(plain))
    # Words as (word, is it an anchor), looked up once per word.
    anchored = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(known), i)), lambda i: i.isNotNull())
    df = df.withColumn("_anchors", anchored).withColumn("_others", F.filter("_words", lambda w: ~w.isin(known)))
    none = F.size("_anchors") == 0
    places = F.when(none, F.transform("_words", lambda w, i: i)).otherwise(F.col("_anchors"))
    df = df.withColumn("_places", places).withColumn("_chained", F.when(none, F.col("_words")).otherwise(F.col("_others")))

    def signature(i: Column, j: Column) -> Column:
        first = F.when(none, i + 1).otherwise(i - j)
        return F.xxhash64(F.get("_words", i), *[F.get("_chained", first + k) for k in range(chain)])

    made = F.sort_array(F.array_distinct(F.transform("_places", signature)))
    lone = F.array(F.xxhash64(F.lit("no words"), plain))
    return df.withColumn(out, F.when(F.size("_words") == 0, lone).otherwise(made)).drop("_words", "_anchors", "_others", "_places", "_chained")


def digest(signatures: Column) -> Column:
    """A short name of a set: equal sets have equal names."""
    return F.sha2(F.array_join(F.transform(signatures, lambda h: F.hex(h)), ",").cast("binary"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id with the digest of its set; pairs of digests at the threshold or above.

    Members may be many per set and are never paired with each other.
    """
    sets = with_signatures(docs).select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("signatures")).alias("set"), "signatures")
    members = cut(sets, "signatures")
    distinct = members.dropDuplicates(["set"]).select("set", "signatures", F.size("signatures").alias("n"))
    one = distinct.select("set", "n", F.explode("signatures").alias("h"))
    rare = one.join(one.groupBy("h").agg(F.count("*").alias("df")), "h")
    # Sets at the threshold share one of their n - ceil(t n) + 1 rarest signatures (all in one order).
    place = F.row_number().over(Window.partitionBy("set").orderBy("df", "h"))
    rare = rare.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    step = -math.log(threshold) if threshold < 1 else 1.0
    of_size = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9)
    left = rare.select("h", "set", "n", F.explode(F.array(of_size, of_size + 1)).alias("size_class"))
    right = rare.select("h", F.col("set").alias("other"), F.col("n").alias("m"), of_size.alias("size_class"))
    met = left.join(right, ["h", "size_class"]).filter("n <= m AND set <> other")
    met = met.filter((F.col("n") < F.col("m")) | (F.col("set") < F.col("other"))).filter(F.col("n") >= F.col("m") * threshold)
    met = met.select("set", "other").distinct()
    a, b = distinct.select("set", F.col("signatures").alias("a")), distinct.select(F.col("set").alias("other"), F.col("signatures").alias("b"))
    pairs = met.join(a, "set").join(b, "other").withColumn("likeness", likeness(F.col("a"), F.col("b"))).filter(F.col("likeness") >= threshold)
    return members.select("doc_id", "set"), pairs.select("set", "other", "likeness")


def _range_of(doc_id: Column, floors: list[int]) -> Column:
    """Number of the range of an id: how many floors (falling) are above it, found by bisection."""
    table = F.split(F.lit(",".join(map(str, floors))), ",").cast("array<bigint>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(floors)).alias("high"))

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        above = F.coalesce(F.get(table, middle) > doc_id, F.lit(False))
        return F.struct(F.when(above, middle + 1).otherwise(a["low"]).alias("low"), F.when(above, a["high"]).otherwise(middle).alias("high"))

    rounds = F.sequence(F.lit(1), F.lit(len(floors).bit_length()))
    return F.aggregate(rounds, start, step, lambda a: a["low"])


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, signatures and next, the (text, signatures) of the next document in descending order
    of doc_id.

    After the last comes the first. A range partitioning of the ids alone cuts them into ranges of about
    `range_bytes` of text (at most `MAX_RANGES`, larger ones beyond); bare texts are shuffled once by
    range, signatures are made after that. A copy of each range's first document follows the last one
    of the range above, so a window inside the ranges sees every next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(MAX_RANGES, shard_count(rows, size=range_bytes))
    parts = rows.select("doc_id").repartitionByRange(n, F.desc_nulls_last("doc_id")).groupBy(F.spark_partition_id().alias("part"))
    ranges = parts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.isnull("doc_id")).alias("none")).collect()
    floors = sorted({r["low"] for r in ranges if r["low"] is not None}, reverse=True)
    highs = [r["high"] for r in ranges if r["low"] is not None]
    total = len(floors) + any(r["none"] for r in ranges)
    part = F.when(F.col("doc_id").isNull(), len(floors)).otherwise(_range_of(F.col("doc_id"), floors)) if floors else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    # Only documents with the largest id of a range, or none, can be its first.
    first = rows.filter(F.col("doc_id").isNull() | F.col("doc_id").isin(highs))
    falling = F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0))).alias("at"), "text")
    first = first.groupBy("part").agg(F.min(falling).alias("x"))
    heads = first.select(F.lit(None).cast("long").alias("doc_id"), "x.text", F.pmod(F.col("part") - 1, F.lit(max(1, total))).cast("int").alias("part"))
    both = rows.withColumn("copied", F.lit(False)).unionByName(heads.withColumn("copied", F.lit(True)))
    both = with_signatures(both.repartition(max(1, total), "part"))
    order = Window.partitionBy("part").orderBy("copied", F.desc_nulls_last("doc_id"), "text")
    linked = both.withColumn("next", F.lead(F.struct("text", "signatures")).over(order))
    return linked.filter(~F.col("copied")).select("doc_id", "text", "signatures", "next")


def edited_digest(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of the checked query."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    df = with_next(docs, range_bytes).withColumn("n_chars", n.cast("long"))
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third)))
    df = with_signatures(df, "edited", "edited_signatures")
    own, edited, after = F.col("signatures"), F.col("edited_signatures"), F.col("next.signatures")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(own).alias("fingerprint"),
        digest(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, after).alias("near_next"),
    )
