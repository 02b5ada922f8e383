"""Work on pairs without emitting pairs.

Every query row has to meet every donor row of its key. Both sides are cut into blocks of bounded
size; one task sees one query block and one donor block and returns one partial result per query,
never a row per pair. Partial results of a query are then merged by an ordinary aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def _cut(df: DataFrame, keys: list[str], ids: list[str], rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their block number, and the number of blocks of keys that need more than one.

    At most count / rows keys need more than one block; the engine broadcasts their table if it is small.
    """
    big = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows)
        .select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias(f"{name}_blocks"))
    )
    blocks: Column = F.coalesce(F.col(f"{name}_blocks"), F.lit(1))
    cut = df.join(big, keys, "left").withColumn(name, F.pmod(F.hash(*ids), blocks)).drop(f"{name}_blocks")
    return cut, big


def paired_blocks(
    queries: DataFrame,
    donors: DataFrame,
    keys: list[str],
    query_ids: list[str],
    donor_ids: list[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    rows: int | None = None,
) -> DataFrame:
    """Partial results of `fn(query block, donor block)` for all pairs of blocks of a key."""
    rows = rows or BLOCK_ROWS
    if not keys:
        keys = ["_all"]
        queries, donors = queries.withColumn("_all", F.lit(0)), donors.withColumn("_all", F.lit(0))
    q, q_big = _cut(queries, keys, query_ids, rows, "_qb")
    d, d_big = _cut(donors, keys, donor_ids, rows, "_db")

    def repeat(df: DataFrame, big: DataFrame, name: str) -> DataFrame:
        last = F.coalesce(F.col(f"{name}_blocks"), F.lit(1)) - 1
        return df.join(big, keys, "left").withColumn(name, F.explode(F.sequence(F.lit(0), last))).drop(f"{name}_blocks")

    on = [*keys, "_qb", "_db"]
    left = repeat(q, d_big, "_db").groupBy(*on)
    far = repeat(d, q_big, "_qb")
    # Both sides may come from one table; new column ids keep a cogroup from mixing them up.
    right = far.select(*[F.col(c).alias(c) for c in far.columns]).groupBy(*on)

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame(columns=names)
        return fn(a, b)

    names = [part.split()[0] for part in schema.split(",")]
    return left.cogroup(right).applyInPandas(work, schema)
