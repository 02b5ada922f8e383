"""Positions, running totals and exact quantiles that never hold a whole group in one task.

A window over a key that owns a third of the rows would sort them in a single task. Here the rows
are range-partitioned first, each (key, partition) piece is worked on its own, and a small table of
piece totals carries the running value from one piece to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoalmap.session import cut

PIECE = "_piece"


def running(df: DataFrame, keys: list[str], order: list[Column | str], **measures: tuple[str, str | None]) -> DataFrame:
    """Add running values inside `keys` along `order`, which must be unique inside the keys.

    Each measure is (kind, column): `row` 1-based position, `sum` inclusive running sum,
    `before` running sum of the earlier rows, `total` sum over the whole key, `min` running minimum,
    `prev` value of the row before. `df` is computed once: what follows reads the written pieces.
    """
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    # The piece number must not change between its two uses, so the ranged rows are written once.
    pieces = cut(
        df.repartitionByRange(*[F.col(k) for k in keys], *sort).withColumn(PIECE, F.spark_partition_id())
    )
    local = Window.partitionBy(*keys, PIECE).orderBy(*sort)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(PIECE)

    totals, carries, finals = [], [], []
    last = pieces.withColumn("_at", F.row_number().over(local)) if any(k == "prev" for k, _ in measures.values()) else pieces
    for name, (kind, col) in measures.items():
        carry = f"_carry_{name}"
        if kind == "row":
            totals.append(F.count(F.lit(1)).alias(carry))
            carries.append(F.coalesce(F.sum(carry).over(earlier), F.lit(0)).alias(carry))
            finals.append((F.row_number().over(local) + F.col(carry)).alias(name))
        elif kind in ("sum", "before"):
            totals.append(F.sum(col).alias(carry))
            carries.append(F.coalesce(F.sum(carry).over(earlier), F.lit(0)).alias(carry))
            total = F.sum(col).over(upto) + F.col(carry)
            finals.append((total - F.col(col) if kind == "before" else total).alias(name))
        elif kind == "total":
            totals.append(F.sum(col).alias(carry))
            carries.append(F.sum(carry).over(Window.partitionBy(*keys)).alias(carry))
            finals.append(F.col(carry).alias(name))
        elif kind == "min":
            totals.append(F.min(col).alias(carry))
            carries.append(F.min(carry).over(earlier).alias(carry))
            finals.append(F.least(F.min(col).over(upto), F.col(carry)).alias(name))
        elif kind == "prev":
            totals.append(F.max_by(F.struct(col), "_at").alias(carry))
            carries.append(F.lag(carry).over(before).alias(carry))
            finals.append(
                F.coalesce(F.lag(F.struct(col)).over(local), F.col(carry)).getField(col).alias(name)
            )
        else:
            raise ValueError(kind)
    offsets = last.groupBy(*keys, PIECE).agg(*totals).select(*keys, PIECE, *carries)
    return pieces.join(offsets, [*keys, PIECE]).select(*df.columns, *finals)


def number_hashed(df: DataFrame, keys: list[str], ids: list[str], seed: int, name: str = "row_number", bits: int = 12) -> DataFrame:
    """1-based position inside `keys` in the order of a seeded hash of `ids`, which are unique there.

    The high bits of the hash cut each key into pieces in hash order, so a count per piece gives
    every piece its offset. Lazy: no sampling and no extra job.
    """
    hashed = df.withColumn("_h", F.xxhash64(*ids, F.lit(seed))).withColumn(PIECE, F.shiftright("_h", 64 - bits))
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*keys, PIECE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, PIECE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(*keys, PIECE).orderBy("_h", *ids)
    return hashed.join(offsets, [*keys, PIECE]).select(
        *df.columns, (F.row_number().over(local) + F.col("_offset")).alias(name)
    )


def value_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Distinct values with their counts: copies shrink to one row before anything is ordered."""
    return df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))


def picked(counts: DataFrame, keys: list[str], col: str, places: dict[str, Column]) -> DataFrame:
    """Values at 0-based places of each sorted group, from `value_counts`. A place may use `_total`,
    the size of the group, which comes along in the result."""
    run = running(counts, keys, [col], _upto=("sum", "_n"), _total=("total", "_n"))
    inside = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
    return run.groupBy(*keys).agg(
        F.max("_total").alias("_total"), *[F.max(F.when(inside(place), F.col(col))).alias(name) for name, place in places.items()]
    )


def quantiles_of_counts(counts: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group from `value_counts`; NULLs do not count."""
    at = F.col("_total").cast("double") - 1
    places = {}
    for name, p in probs.items():
        places[f"_lo_{name}"] = F.floor(at * p)
        places[f"_hi_{name}"] = F.ceil(at * p)
    values = picked(counts.filter(F.col(col).isNotNull()), keys, col, places)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at * p - F.floor(at * p))).alias(name))
    return values.select(*keys, *out)


def quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    return quantiles_of_counts(value_counts(df, keys, col), keys, col, probs)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], split_by: list[str], rows: int = 1_000_000) -> DataFrame:
    """Inner equi-join in which a key with more than `rows` left rows is cut into several keys.

    Left rows of a hot key spread by a hash of `split_by`; the right rows of that key are repeated
    once per cut. At most count(left) / rows keys can be hot; the engine broadcasts their table if it is small.
    """
    hot = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows)
        .select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_cuts"))
    )
    cuts = F.coalesce(F.col("_cuts"), F.lit(1))
    spread = left.join(hot, on, "left").withColumn("_cut", F.pmod(F.hash(*split_by), cuts)).drop("_cuts")
    repeated = right.join(hot, on, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("_cuts")
    return spread.join(repeated, [*on, "_cut"]).drop("_cut")


def beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join of tables whose rows already lie in the same tasks, dealt by a part of `on`.

    A join asks for tables dealt by all of its keys and would send both; a union of tables that are dealt alike
    stays where it is, and so does a group by keys that include what they are dealt by. Tables that are not dealt
    alike are shuffled once, as by a join. Rows of one key meet in one row, so few of them should share it.
    """
    mine, theirs = [c for c in left.columns if c not in on], [c for c in right.columns if c not in on]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    # A table without further columns counts by its rows.
    packed = lambda df, names: df.filter(known).select(*on, F.struct(*(names or [F.lit(1).alias("_one")])).alias("_cells"))
    a, b = packed(left, mine), packed(right, theirs)
    empty = lambda df: F.lit(None).cast(df.schema["_cells"].dataType)
    rows = a.select(*on, F.col("_cells").alias("_a"), empty(b).alias("_b")).unionByName(b.select(*on, empty(a).alias("_a"), F.col("_cells").alias("_b")))
    met = rows.groupBy(*on).agg(F.collect_list("_a").alias("_a"), F.collect_list("_b").alias("_b")).filter((F.size("_a") > 0) & (F.size("_b") > 0))
    one = met.select(*on, "_b", F.explode("_a").alias("_a")).select(*on, "_a", F.explode("_b").alias("_b"))
    return one.select(*on, *[F.col("_a")[c].alias(c) for c in mine], *[F.col("_b")[c].alias(c) for c in theirs])
