"""Sinks, keyed result tables and reuse of written results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalmap.session import list_names, path_exists


def write_by_huc8(df: DataFrame, path: str) -> None:
    """One folder per HUC8. The rebalance hint gathers small HUC8s and splits large ones, so a hot
    HUC8 becomes several files and a cold one does not become many."""
    df.hint("rebalance", F.col("huc8")).write.mode("overwrite").partitionBy("huc8").parquet(path)


def read_huc8(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Only the folders of the wanted HUC8s (dynamic partition pruning by the semi join)."""
    stored = spark.read.option("inferSchema", "false").parquet(path).withColumn("huc8", F.col("huc8").cast("string"))
    stored = stored.withColumn("huc8", F.lpad("huc8", 8, "0"))
    return stored.join(ids.select("huc8").distinct(), "huc8", "left_semi")


def verify_sink(df: DataFrame, path: str) -> DataFrame:
    """Write, read back and compare counts. The expected count is taken from the source rows; an
    `Observation` would save that pass, but leaves the session unfit for later ML closures."""
    written = df.count()
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("read_back")).select(
        F.lit(written).cast("bigint").alias("written"), "read_back", (F.col("read_back") == written).alias("ok")
    )


class ResultStore:
    """Tables below one folder, each split by a text key; a write replaces only its own keys."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/table={name}"

    def tables(self) -> list[str]:
        names = list_names(self.spark, self.root)
        return [n.split("=", 1)[1] for n in names if n.startswith("table=")]

    def write(self, name: str, df: DataFrame, key: str = "key") -> None:
        (
            df.hint("rebalance", F.col(key))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(key)
            .parquet(self._path(name))
        )

    def read(self, name: str, key: str | None = None, value: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self._path(name))
        return df if key is None else df.filter(F.col(key) == value)

    def counts(self) -> DataFrame:
        """Rows per table; Parquet footers answer the counts."""
        out = None
        for name in self.tables():
            one = self.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "table string, n bigint")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], policy: str = "overwrite", order: str | None = None) -> DataFrame:
    """`overwrite`: updates win; `gen`: rows present stay; `append`: as overwrite, for nested keys
    such as (run, block), where a run gains blocks and keeps its others.

    `order` names the column by which one of several updates of a key counts: the last, with `gen` the
    first. Without it `updates` must have one row per key.
    """
    if order is not None:
        updates = latest_update(updates, keys, order, first=policy == "gen")
    if policy in ("overwrite", "append"):
        kept = target.join(updates.select(*keys).distinct(), keys, "left_anti")
        return kept.select(*target.columns).unionByName(updates.select(*target.columns))
    if policy == "gen":
        new = updates.join(target.select(*keys).distinct(), keys, "left_anti")
        return target.unionByName(new.select(*target.columns))
    raise ValueError(policy)


def latest_update(updates: DataFrame, keys: list[str], order: str, first: bool = False) -> DataFrame:
    """One row per key, the last by `order`, or the first."""
    best = (F.min if first else F.max)(F.struct(order, *[c for c in updates.columns if c not in keys and c != order])).alias("_r")
    return updates.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in updates.columns])


def split_errors(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and dead-letter rows; a NULL test counts as good."""
    is_bad = F.coalesce(bad, F.lit(False))
    return df.filter(~is_bad), df.filter(is_bad)


def cached(spark: SparkSession, path: str, build: Callable[[int], DataFrame], rebuild: int = 0) -> DataFrame:
    """Read `path` if it is there and no rebuild is asked for; else build with one level less."""
    if rebuild <= 0 and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    build(max(rebuild - 1, 0)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rekey_by_species(pred: DataFrame, runs: DataFrame) -> DataFrame:
    """Results keyed by run get the species of their run."""
    return pred.join(runs.select("run_id", "species").distinct(), "run_id")
