"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_FOLDERS: dict[str, str] = {}
TASK_ROWS = 200_000


def local_session(cpus: int | str = "*", name: str = "shoalmap", shuffle: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder of this session that every executor can reach.

    It is below the folder in `spark.checkpoint.dir`, or below the warehouse where that is unset. Spark
    deletes it, with all tables written by `cut`, when the application ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        named = spark.conf.get(CHECKPOINT_KEY, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        folder = f"{named.rstrip('/')}/shoalmap-{uuid.uuid4().hex}"
        at, fs = _folder(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        _FOLDERS[context.applicationId] = folder
    return _FOLDERS[context.applicationId]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a result once to the shared folder and go on from the written table.

    This fixes the rows and ends the lineage. A Parquet table is computed in one pass, keeps column
    pruning and exact sizes for the planner, and outlives any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_floor(spark: SparkSession) -> int:
    """The fewest tasks that use the session: work that is heavy for its bytes would be merged into less."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as keep each at about `TASK_ROWS` rows, so that the memory of one does not grow with the rows."""
    return max(-(-rows // TASK_ROWS), task_floor(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, path)
    return fs.exists(at)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it is not there."""
    at, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder; one that is not there is no error."""
    at, fs = _folder(spark, path)
    fs.delete(at, True)
