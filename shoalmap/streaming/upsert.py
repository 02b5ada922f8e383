"""Partial results arriving as a stream, upserted into a keyed table.

The table is a folder of numbered versions. A batch reads the newest finished version, applies its
rows and writes the next one, so no version is read and overwritten at once. The version number is
the batch number plus one: a batch that Spark replays after a lost executor writes the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shoalmap.session import list_names, path_exists
from shoalmap.sources.store import latest_update, upsert


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    at = f"{path}/v={version:09d}"
    return spark.read.parquet(at) if path_exists(spark, f"{at}/_SUCCESS") else None


def stream_upsert(
    updates: DataFrame, path: str, keys: list[str], order: str, policy: str, checkpoint: str
) -> StreamingQuery:
    """Upsert every micro-batch; within a batch the last row per key counts, with `gen` the first."""

    def apply(batch: DataFrame, number: int) -> None:
        once = latest_update(batch, keys, order, first=policy == "gen")
        before = read_version(batch.sparkSession, path, number)
        after = once if before is None else upsert(before, once, keys, policy)
        after.write.mode("overwrite").parquet(f"{path}/v={number + 1:09d}")

    return (
        updates.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest(spark: SparkSession, path: str, query: StreamingQuery) -> DataFrame:
    """The newest finished version of the table; a query that had nothing to do changes nothing."""
    done = [n for n in list_names(spark, path) if path_exists(spark, f"{path}/{n}/_SUCCESS")]
    return spark.read.parquet(f"{path}/{max(done)}")
