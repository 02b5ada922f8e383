"""Top features, votes, ranks, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoalmap.functions.ids import huc_prefix
from shoalmap.operators.numbering import running
from shoalmap.session import cut, tasks_for

# Means are compared at nine decimals, so that equal values tie whatever the order of their sums.
TIE_DECIMALS = 9


def _tie(c: Column) -> Column:
    return F.round(c, TIE_DECIMALS)


def top_features(coef: DataFrame, n: int) -> DataFrame:
    """The n lowest and n highest variables by mean over all HUC12s."""
    means = coef.groupBy("var").agg(_tie(F.avg("coef")).alias("mean"))
    low = means.orderBy("mean", "var").limit(n).withColumn("side", F.lit("low"))
    high = means.orderBy(F.desc("mean"), F.desc("var")).limit(n).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def _extreme(coef: DataFrame, side: str) -> DataFrame:
    """Variable with the lowest or highest value per HUC12; the first name on ties."""
    value = _tie(F.col("coef"))
    pick = F.min(F.struct((value if side == "low" else -value).alias("v"), "var")).alias("m")
    return coef.groupBy("huc12").agg(pick).select("huc12", F.col("m.var").alias("var"), F.lit(side).alias("side"))


def vote_features(coef: DataFrame, n: int) -> DataFrame:
    """The n variables that most HUC12s name as lowest, and as highest."""
    out = None
    for side in ("low", "high"):
        votes = _extreme(coef, side).groupBy("side", "var").agg(F.count(F.lit(1)).alias("votes"))
        top = votes.orderBy(F.desc("votes"), "var").limit(n)
        out = top if out is None else out.unionByName(top)
    return out


def best_feature_per_huc(coef: DataFrame, top: DataFrame) -> DataFrame:
    """Per HUC12 the best of the top set: the highest of the high side, the lowest of the low side."""
    parts = [
        _extreme(coef.join(top.filter(F.col("side") == side).select("var"), "var", "left_semi"), side)
        for side in ("low", "high")
    ]
    return parts[0].unionByName(parts[1])


def feature_rank(coef: DataFrame, level: int) -> DataFrame:
    """Ascending rank of each variable in its HUC unit; a unit has one row per variable by then."""
    unit = f"huc{level}"
    means = coef.groupBy(huc_prefix(F.col("huc12"), level).alias(unit), "var").agg(_tie(F.avg("coef")).alias("mean"))
    order = Window.partitionBy(unit).orderBy("mean", "var")
    return means.withColumn("rank", F.row_number().over(order))


def order_species(best: DataFrame) -> DataFrame:
    """Species of each scorer from the lowest to the highest best score."""
    tied = best.withColumn("score", _tie(F.col("score")))
    return running(tied, ["scorer_id"], ["score", "species"], place=("row", None))


def id_blocks(universe: DataFrame, size: int = 100_000) -> DataFrame:
    """Every species' catchments in blocks of `size` by ascending id.

    The ids of a species are unique whole numbers, so a range of `size` ids holds at most `size`
    rows: rows are numbered inside such ranges and the ranges' counts give the offsets. There are as many
    tasks as keep each at about `TASK_ROWS` rows.
    """
    ids = universe.select("species", "comid").distinct().withColumn("_id", F.col("comid").cast("bigint"))
    ranged = ids.withColumn("_range", F.floor(F.col("_id") / size))
    earlier = Window.partitionBy("species").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(ranged.groupBy("species", "_range").agg(F.count(F.lit(1)).alias("_n")), "ranges")
    offsets = counts.select("species", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    n = tasks_for(ids.sparkSession, counts.agg(F.sum("_n")).first()[0] or 0)
    local = Window.partitionBy("species", "_range").orderBy("_id")
    place = F.row_number().over(local) + F.col("_offset")
    dealt = ranged.repartition(n, "species", "_range").join(offsets.repartition(n, "species", "_range").hint("shuffle_hash"), ["species", "_range"])
    return dealt.select(
        "species", "comid", F.floor((place - 1) / size).alias("block")
    )


def block_ids(blocks: DataFrame) -> DataFrame:
    """Count and content hash of each block's ids in ascending order. The blocks are written once, so that their
    number of rows says how many tasks hash them."""
    blocks = cut(blocks, "blocks")
    blocks = blocks.repartition(tasks_for(blocks.sparkSession, blocks.count()), "species", "block")
    ids = F.array_sort(F.collect_list(F.col("comid").cast("bigint")))
    text = F.concat_ws(",", F.transform(ids, lambda i: i.cast("string")))
    return blocks.groupBy("species", "block").agg(F.count(F.lit(1)).alias("n"), F.sha2(text, 256).alias("block_id"))


def key_chunks(df: DataFrame, key: str, n: int) -> DataFrame:
    """Distinct keys with `near_equal` (sizes differ by at most one) and `ceil_sized` chunk numbers."""
    keys = df.select(key).distinct()
    total = keys.agg(F.count(F.lit(1))).scalar()
    numbered = running(keys, [], [key], _at=("row", None)).withColumn("_total", total)
    small = F.floor(F.col("_total") / n)
    extra = F.col("_total") % n
    at = F.col("_at") - 1
    wide = extra * (small + 1)
    near = F.when(at < wide, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - wide) / F.greatest(small, F.lit(1))))
    return numbered.select(key, near.alias("near_equal"), F.floor(at / F.ceil(F.col("_total") / n)).alias("ceil_sized"))


def sort_results(df: DataFrame, keys: list[str]) -> DataFrame:
    """Globally sorted by range partitions; use for output files, not before another shuffle."""
    return df.orderBy(*keys)


def largest_species(meta: DataFrame, n: int) -> DataFrame:
    return meta.orderBy(F.desc("n"), "species").limit(n)
