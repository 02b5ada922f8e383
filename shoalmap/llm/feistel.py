"""Sharding by a keyed permutation of the global row numbers, in DataFrame functions only.

Rows are numbered in the order of doc_id. A Feistel network over pairs (left, right) of two numbers
a * b >= n, the fewest that hold all n row numbers, permutes them: each step adds a hash of one half to
the other. Numbers that fall on n or above walk on along their cycle until they are below n, so the
result is a permutation of 0..n-1. Place p goes to shard p mod shards, slot p div shards: counts differ
by one at most and slots have no gaps. `place_of` and `row_at` compute a row's place and a place's row from
the number of rows and the seed alone, so a reader finds any row of the shuffled order without a table.

At most a places lie above n, and one is walked onto with a chance of at most 1 / b per step. `WALK`
steps are laid out, which is all there can be below 64 * 64 rows; a walk that would take more (a chance
under 64 ** -64) raises an error instead of giving a wrong place.

Defined results: null texts have no bytes and take part like others. Equal rows have numbers of their own,
in any order among themselves, as they can't be told apart; rows of one doc_id are ordered by size,
CRC and hash of their texts. Null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.llm.numbers import numbered

SHARDS = 8
SEED = 2024
ROUNDS = 8
WALK = 64


def halves(n: int) -> tuple[int, int]:
    """The two factors whose product holds n numbers with the fewest to spare."""
    a = max(1, math.isqrt(max(1, n) - 1) + 1)
    return a, max(1, -(-n // a))


def _network(at: Column, n: int, seed: int, back: bool = False) -> Column:
    """All steps, or their inverse, over a number below a * b, which is left + a * right."""
    a, b = halves(n)
    left = F.pmod(at, F.lit(a).cast("long"))
    # An exact multiple, so the division of doubles is exact.
    start = F.struct(left.alias("left"), ((at - left) / a).cast("long").alias("right"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        own, other = F.when(even, s["left"]).otherwise(s["right"]), F.when(even, s["right"]).otherwise(s["left"])
        size = F.when(even, a).otherwise(b).cast("long")
        moved = F.pmod(F.xxhash64(F.lit(seed).cast("long"), k, other), size)
        own = F.pmod(own - moved if back else own + moved, size)
        return F.struct(F.when(even, own).otherwise(other).alias("left"), F.when(even, other).otherwise(own).alias("right"))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    steps = F.array(*[F.lit(k).cast("long") for k in order])
    return F.aggregate(steps, start, step, lambda s: s["left"] + a * s["right"])


def _walked(at: Column, n: int, seed: int, back: bool) -> Column:
    top = F.lit(n).cast("long")
    first = _network(at, n, seed, back)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < top, x).otherwise(_network(x, n, seed, back)))
    walk = F.when(walk < top, walk).otherwise(F.raise_error(F.lit(f"a walk of more than {WALK} steps")).cast("long"))
    return F.when(first < top, first).otherwise(walk)


def place_of(row: Column, n: int, seed: int = SEED) -> Column:
    """Place of a row number in the shuffled order of n rows."""
    return _walked(row.cast("long"), n, seed, False)


def row_at(place: Column, n: int, seed: int = SEED) -> Column:
    """Row number at a place of the shuffled order: the inverse of `place_of`."""
    return _walked(place.cast("long"), n, seed, True)


def shuffled(df: DataFrame, order: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rest (a struct of all columns of `df`), row, shard and slot; one shuffle by the range of `order`."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rest"), *[c.alias(f"_by{k}") for k, c in enumerate(order)])
    rows = numbered(held, [F.col(f"_by{k}").asc_nulls_first() for k in range(len(order))])
    n = rows.count()
    place = rows.select("rest", "row", place_of(F.col("row"), n, seed).alias("place")) if n else rows.select("rest", "row", F.lit(0).cast("long").alias("place"))
    count = F.lit(shards).cast("long")
    shard = F.pmod("place", count)
    return place.select("rest", "row", shard.cast("int").alias("shard"), ((F.col("place") - shard) / count).cast("long").alias("slot"))


def _measures(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return {
        "doc_id": F.col(doc_id).cast("long"),
        "size": (F.octet_length(plain) + 1).cast("long"),
        "text_crc32": F.crc32(plain.cast("binary")),
        "mark": F.xxhash64(plain),
    }


def shard_digest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The columns of the checked query, and row; only numbers are shuffled, texts stay where they are."""
    narrow = docs.select(*[c.alias(k) for k, c in _measures().items()])
    rows = shuffled(narrow, [F.col(k) for k in narrow.columns], shards, seed)
    fixed = F.lit("rows").alias("law"), F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("rest.doc_id", "rest.size", "rest.text_crc32", *fixed, "row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """All columns of `docs` as a table partitioned by shard; files hold ranges of slots in order."""
    rows = shuffled(docs, list(_measures().values()), shards, seed)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
