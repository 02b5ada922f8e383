"""Readers for the input files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalmap.functions.metric_names import is_meta

# Fixed patterns: the species in a saved run's path and the region in a zip file's name.
SPECIES_IN_PATH = r"species-([(a-z)]+(\s[\-\.a-z]+)+)_"
REGION_IN_PATH = r"Region(..)"
LONG_SCHEMA = "region string, comid string, metric string, value string"
CHUNK_ROWS = 50_000
QUOTED = {"quote": '"', "escape": '"'}


def read_csv_strings(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """CSV with a header; every value stays text, empty ones too.

    Quoted values may hold commas, doubled quotes and, with `line_breaks`, line ends; then a file is read by
    one task. Without, large files are split.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=line_breaks, **QUOTED)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def read_crosswalk(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The five crosswalk columns, ids as text; other columns are never read. Its CSV has ids and
    numbers only, no line ends inside quotes, so large files are split."""
    raw = spark.read.csv(path, header=True, **QUOTED) if form == "csv" else spark.read.parquet(path)
    ids = [F.col(c).cast("string").alias(c.lower()) for c in ("COMID", "HUC12", "REACHCODE", "TOHUC")]
    return raw.select(*ids, F.col("Length").cast("double").alias("length"))


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for region, content in zip(batch["region"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.namelist():
                    if not member.lower().endswith(".csv"):
                        continue
                    with archive.open(member) as text:
                        for rows in pd.read_csv(text, dtype=str, keep_default_na=False, chunksize=CHUNK_ROWS):
                            rows = rows.rename(columns={rows.columns[0]: "comid"})
                            long = rows.melt(id_vars="comid", var_name="metric", value_name="value")
                            long.insert(0, "region", region)
                            yield long


def parse_zip_csv(files: DataFrame) -> DataFrame:
    """Long metric rows of zipped CSV files given as (path, content); a file is read in chunks."""
    keyed = files.select(F.regexp_extract("path", REGION_IN_PATH, 1).alias("region"), "content")
    return keyed.mapInPandas(_unzip, LONG_SCHEMA)


def read_zip_csv(spark: SparkSession, glob: str) -> DataFrame:
    """One task per group of files; the region comes from the file name."""
    return parse_zip_csv(spark.read.format("binaryFile").load(glob).select("path", "content"))


def merge_metric_files(dfs: list[DataFrame], key: str = "comid") -> DataFrame:
    """Long (key, metric, value) of several wide files; the later file wins."""
    longs = []
    for at, df in enumerate(dfs):
        names = [c for c in df.columns if c != key]
        wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in names])
        longs.append(wide.unpivot([key], names, "metric", "value").withColumn("_file", F.lit(at)))
    stacked = longs[0]
    for more in longs[1:]:
        stacked = stacked.unionByName(more)
    best = F.max(F.struct("_file", "value"))
    return stacked.groupBy(key, "metric").agg(best.getField("value").alias("value"))


def split_meta(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data rows and meta rows (areas and percent full, whatever their case)."""
    meta = is_meta(F.col("metric"))
    return long.filter(~meta), long.filter(meta)


def species_from_path(c: Column) -> Column:
    return F.regexp_extract(c, SPECIES_IN_PATH, 1)


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Saved run files below a folder with the species named in their path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "modificationTime", "length", species_from_path(F.col("path")).alias("species"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boundary boxes: the id columns and the four sides, without the geometry."""
    raw = spark.read.parquet(path)
    sides = ("minx", "miny", "maxx", "maxy")
    ids = [c for c in raw.columns if c not in sides and c not in ("wkb", "geometry")]
    return raw.select(*ids, *[F.col(s).cast("double").alias(s) for s in sides])
