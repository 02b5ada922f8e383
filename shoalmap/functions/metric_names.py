"""Names and text values of landscape metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffix classes in the order they are tested, and column names that describe coverage.
SUFFIXES = ("Ws", "Cat", "CatRp100", "WsRp100", "Rp100")
META_COLUMNS = ("catareasqkm", "wsareasqkm", "catpctfull", "wspctfull")
MISSING_TEXT = ("NA", "")
# Fixed patterns of features left out of the models: two-digit years and dam counts.
BAD_PATTERNS = (r"0[8-9](cat|ws)$", r"^Dam")


def metric_stem(c: Column) -> Column:
    """Name without its first 20dd year, marked as an average; names without a year stay."""
    return F.regexp_replace(c, "^(.*?)20[0-9][0-9](.*)$", "$1$2_avg")


def metric_year(c: Column) -> Column:
    year = F.regexp_extract(c, "20[0-9][0-9]", 0)
    return F.when(year == "", "all").otherwise(year)


def metric_class(c: Column) -> Column:
    out = None
    for suffix in SUFFIXES:
        hit = F.endswith(c, F.lit(suffix))
        out = F.when(hit, suffix) if out is None else out.when(hit, suffix)
    return out.otherwise("other")


def parse_metric(c: Column) -> Column:
    """Missing text is NaN; other text that is no number is NULL, which marks an error row."""
    return F.when(c.isin(*MISSING_TEXT), F.lit(float("nan"))).otherwise(c.try_cast("double"))


def is_meta(metric: Column) -> Column:
    return F.lower(metric).isin(*META_COLUMNS)


def prune_features(metrics: DataFrame, bad: list[str] | None = None, col: str = "metric") -> DataFrame:
    """Rows whose metric is not listed as bad and matches no bad pattern."""
    keep = ~F.col(col).rlike("|".join(BAD_PATTERNS))
    if bad:
        keep = keep & ~F.col(col).isin(*bad)
    return metrics.filter(keep)


def latest_version(metrics: DataFrame, col: str = "metric") -> DataFrame:
    """Of names that differ only in their _v1 / _v2 / _v2_1 ending, keep the highest version."""
    version = F.regexp_extract(col, "_v([0-9]+(?:_[0-9]+)?)$", 1)
    names = metrics.select(col).distinct().select(
        F.col(col),
        F.regexp_replace(col, "_v[0-9]+(_[0-9]+)?$", "").alias("stem"),
        F.coalesce(F.split(version, "_")[0].try_cast("int"), F.lit(0)).alias("major"),
        F.coalesce(F.try_element_at(F.split(version, "_"), F.lit(2)).try_cast("int"), F.lit(0)).alias("minor"),
    )
    best = names.groupBy("stem").agg(F.max(F.struct("major", "minor", col)).alias("best")).select(F.col(f"best.{col}"))
    return metrics.join(best, col, "left_semi")


def drop_matching(metrics: DataFrame, subs: list[str], col: str = "metric") -> DataFrame:
    """Drop names whose lower-case form contains a listed text; an upper-case text never matches."""
    hit = F.lit(False)
    for sub in subs:
        hit = hit | F.contains(F.lower(F.col(col)), F.lit(sub))
    return metrics.filter(~hit)
