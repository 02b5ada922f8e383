"""A keyed table in buckets of its keys' hash, of which an update rewrites only those it touches.

Folder layout: `data/v=<version>/bucket=<b>` and, per version, a manifest that names the version each
bucket was last written in. A reader takes the newest finished manifest, so it never sees half an update,
and a replayed update writes the same folders again. Manifests before the last `KEEP` are dropped, with
the buckets that no kept manifest names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoalmap.session import cut, delete_path, list_names, path_exists
from shoalmap.sources.store import latest_update, upsert

BUCKETS = 64
KEEP = 2
_MANIFEST = "bucket int, written long, buckets int"


def _at(path: str, what: str, version: int) -> str:
    return f"{path}/{what}/v={version:09d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first."""
    named = [n for n in list_names(spark, f"{path}/manifest") if path_exists(spark, f"{path}/manifest/{n}/_SUCCESS")]
    return sorted(int(n.removeprefix("v=")) for n in named)


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Version each bucket was written in: at most as many entries as there are buckets."""
    return {r["bucket"]: r["written"] for r in spark.read.schema(_MANIFEST).parquet(_at(path, "manifest", version)).collect()}


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, written: dict[int, int], schema) -> DataFrame:
    folders = [f"{_at(path, 'data', v)}/bucket={b}" for b, v in sorted(written.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table of the newest finished version, or of an older one that is kept."""
    known = versions(spark, path)
    version = known[-1] if version is None else version
    written = manifest(spark, path, version)
    schema = spark.read.parquet(f"{_at(path, 'data', max(written.values()))}/bucket={max(written, key=written.get)}").schema
    return _read(spark, path, written, schema)


def upsert_buckets(updates: DataFrame, path: str, keys: list[str], order: str, policy: str = "overwrite", version: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Apply an update table as a new version and return the buckets it rewrote.

    Of several rows of one key the last by `order` counts (with `gen` the first). The table keeps the
    number of buckets it was begun with.
    """
    spark = updates.sparkSession
    known = versions(spark, path)
    version = (known[-1] + 1 if known else 1) if version is None else version
    past = [v for v in known if v < version]
    before = manifest(spark, path, past[-1]) if past else {}
    if past:
        buckets = spark.read.schema(_MANIFEST).parquet(_at(path, "manifest", past[-1])).first()["buckets"]
    once = cut(latest_update(updates, keys, order, first=policy == "gen").withColumn("bucket", bucket_of(keys, buckets)), "update")
    touched = sorted(r["bucket"] for r in once.select("bucket").distinct().collect())
    if not touched and not before:
        return []
    if touched:
        columns = [c for c in once.columns if c != "bucket"]
        old = _read(spark, path, {b: v for b, v in before.items() if b in touched}, once.select(*columns).schema)
        after = upsert(old, once.select(*columns), keys, policy).withColumn("bucket", bucket_of(keys, buckets))
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_at(path, "data", version))
    now = before | dict.fromkeys(touched, version)
    rows = spark.createDataFrame([(b, v, buckets) for b, v in now.items()], _MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(_at(path, "manifest", version))
    _drop_old(spark, path)
    return touched


def _drop_old(spark: SparkSession, path: str) -> None:
    known = versions(spark, path)
    kept = {(v, b) for version in known[-KEEP:] for b, v in manifest(spark, path, version).items()}
    for version in known[:-KEEP]:
        delete_path(spark, _at(path, "manifest", version))
    for folder in list_names(spark, f"{path}/data"):
        version = int(folder.removeprefix("v="))
        if version > known[-1]:
            continue
        names = [n for n in list_names(spark, f"{path}/data/{folder}") if n.startswith("bucket=")]
        stay = [n for n in names if (version, int(n.removeprefix("bucket="))) in kept]
        for name in set(names) - set(stay):
            delete_path(spark, f"{path}/data/{folder}/{name}")
        if not stay:
            delete_path(spark, f"{path}/data/{folder}")


def stream_buckets(updates: DataFrame, path: str, keys: list[str], order: str, policy: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert every micro-batch; a replayed batch has the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        upsert_buckets(batch, path, keys, order, policy, number + 1, buckets)

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
