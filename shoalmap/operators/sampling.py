"""Folds, batches and samples from seeded hashes: the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoalmap.operators.numbering import number_hashed, running


def _repeat(df: DataFrame, reps: int, name: str = "rep_idx") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def repeated_kfold(df: DataFrame, keys: list[str], ids: list[str], k: int, reps: int, seed: int) -> DataFrame:
    """Every row once per repeat with its test fold `split_idx`; fold sizes differ by at most one."""
    numbered = number_hashed(_repeat(df, reps), [*keys, "rep_idx"], [*ids, "rep_idx"], seed)
    return numbered.withColumn("split_idx", ((F.col("row_number") - 1) % k).cast("int")).drop("row_number")


def planned_kfold(df: DataFrame, plan: DataFrame, keys: list[str], ids: list[str], seed: int) -> DataFrame:
    """As `repeated_kfold`, with the splits and repeats a plan sets per key."""
    joined = df.join(plan.select(*keys, "n_splits", "n_repeats"), keys)
    repeated = joined.withColumn("rep_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_repeats") - 1)))
    numbered = number_hashed(repeated, [*keys, "rep_idx"], [*ids, "rep_idx"], seed)
    return numbered.withColumn("split_idx", (F.col("row_number") - 1) % F.col("n_splits")).drop("row_number", "n_splits", "n_repeats")


def fold_plan(df: DataFrame, keys: list[str], k: int, reps: int) -> DataFrame:
    """Splits and repeats per key. With fewer ones than splits there is a split per four ones, at
    least two, and as many more repeats as keep the number of fits."""
    ones = df.groupBy(*keys).agg(F.sum("y").alias("ones"))
    fewer = F.greatest(F.floor(F.col("ones") / 4), F.lit(2))
    short = F.col("ones") < k
    return ones.select(
        *keys,
        "ones",
        F.when(short, fewer).otherwise(F.lit(k)).alias("n_splits"),
        F.when(short, F.ceil(F.lit(k * reps) / fewer)).otherwise(F.lit(reps)).alias("n_repeats"),
    )


def stratified_kfold(df: DataFrame, keys: list[str], y: str, ids: list[str], k: int, reps: int, seed: int) -> DataFrame:
    """Folds within each value of y, so every fold has its share of each class."""
    numbered = number_hashed(_repeat(df, reps), [*keys, y, "rep_idx"], [*ids, "rep_idx"], seed)
    return numbered.withColumn("split_idx", ((F.col("row_number") - 1) % k).cast("int")).drop("row_number")


def quantile_folds(df: DataFrame, y: str, ids: list[str], groups: int, k: int, reps: int, seed: int) -> DataFrame:
    """Rows are cut into `groups` of equal size by a continuous y, then folded within each group."""
    total = df.agg(F.count(F.lit(1))).scalar()
    numbered = running(df, [], [y, *ids], _at=("row", None))
    grouped = numbered.withColumn("y_group", F.floor((F.col("_at") - 1) * groups / total).cast("int")).drop("_at")
    return stratified_kfold(grouped, [], "y_group", ids, k, reps, seed)


def balanced_batches(
    df: DataFrame, keys: list[str], ids: list[str], batch_n: int, batches: int, min_y: float, draws: int, seed: int
) -> DataFrame:
    """Batches of `batch_n` rows with a fixed number of the rarer class in each, in several draws.

    A `min_y` below 1 is a share of the batch. The number of batches is limited by both classes, so
    no row is in two batches of a draw.
    """
    rare_n = int(batch_n * min_y) if min_y < 1 else int(min_y)
    sizes = df.groupBy(*keys).agg(F.sum("y").alias("_ones"), F.sum(1 - F.col("y")).alias("_zeros"))
    rare = F.when(F.col("_ones") < F.col("_zeros"), 1).otherwise(0)
    fits = F.least(
        F.floor(F.least("_ones", "_zeros") / rare_n), F.floor(F.greatest("_ones", "_zeros") / (batch_n - rare_n)), F.lit(batches)
    )
    plan = sizes.select(*keys, rare.alias("_rare"), fits.alias("_batches"))
    numbered = number_hashed(_repeat(df, draws, "draw"), [*keys, "y", "draw"], [*ids, "draw"], seed).join(plan, keys)
    per_batch = F.when(F.col("y") == F.col("_rare"), rare_n).otherwise(batch_n - rare_n)
    batch = F.floor((F.col("row_number") - 1) / per_batch)
    return numbered.withColumn("batch", batch).filter(F.col("batch") < F.col("_batches")).drop("row_number", "_rare", "_batches")


def sample_huc8(crosswalk: DataFrame, n8: int, seed: int, even: bool = True) -> DataFrame:
    """Random HUC8s, the same number from every HUC2 (at least one), or from all together."""
    units = crosswalk.select(F.substring("huc12", 1, 2).alias("huc2"), F.substring("huc12", 1, 8).alias("huc8")).distinct()
    if not even:
        return units.orderBy(F.xxhash64("huc8", F.lit(seed)), "huc8").limit(n8)
    regions = units.agg(F.count_distinct("huc2")).scalar()
    quota = F.greatest(F.lit(1), F.floor(F.lit(n8) / regions))
    # A HUC2 has a few hundred HUC8s at most.
    order = Window.partitionBy("huc2").orderBy(F.xxhash64("huc8", F.lit(seed)), "huc8")
    return units.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= quota).drop("_at")


def sample_by_huc(crosswalk: DataFrame, n: int, n8: int, seed: int) -> DataFrame:
    """About n catchments, evenly over the HUC2s and over the HUC8s drawn in each."""
    drawn = sample_huc8(crosswalk, n8, seed)
    regions = drawn.agg(F.count_distinct("huc2")).scalar()
    per_region = drawn.groupBy("huc2").agg(F.count(F.lit(1)).alias("_units"))
    quota = per_region.withColumn("_quota", F.greatest(F.lit(1), F.floor(F.lit(n) / (regions * F.col("_units")))))
    rows = crosswalk.select("comid", "huc12", F.substring("huc12", 1, 8).alias("huc8")).join(drawn, "huc8")
    numbered = number_hashed(rows, ["huc8"], ["comid"], seed).join(quota.select("huc2", "_quota"), "huc2")
    return numbered.filter(F.col("row_number") <= F.col("_quota")).select("comid", "huc12", "huc8", "huc2")


def shuffle(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids)


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without NULL or NaN in any column."""
    return df.dropna()
