"""Boundaries and catchments as bounding boxes (minx, miny, maxx, maxy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.functions.ids import huc_prefix, stringify_huc

SIDES = ("minx", "miny", "maxx", "maxy")
# First HUC2 outside the contiguous states, the two states left out, states kept.
FIRST_OUTER_HUC2 = 19
OUTER_STATES = ("02", "15")
STATES_KEPT = 49


def conus_only(df: DataFrame, col: str = "huc2") -> DataFrame:
    return df.filter(F.col(col).cast("int") < FIRST_OUTER_HUC2)


def conus_states(states: DataFrame, fips: str = "fips") -> DataFrame:
    """The first 49 states by FIPS code without Alaska and Hawaii."""
    return states.filter(~F.col(fips).isin(*OUTER_STATES)).orderBy(fips).limit(STATES_KEPT)


def bounding_box(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    aggs = [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]
    return boxes.groupBy(*(by or [])).agg(*aggs)


def boundary_join(data: DataFrame, boxes: DataFrame, level: str) -> DataFrame:
    """Boundaries that have data, with the data attached."""
    return boxes.join(data, level)


def catchment_join(pred: DataFrame, catch: DataFrame) -> DataFrame:
    """Attach catchment boxes; ids are text in predictions and numbers in the catchment table."""
    keyed = pred.withColumn("featureid", F.col("comid").cast("bigint"))
    return keyed.join(catch, "featureid")


def _overlaps(a: str, b: str) -> Column:
    c = F.col
    return (
        (c(f"{a}.minx") <= c(f"{b}.maxx"))
        & (c(f"{a}.maxx") >= c(f"{b}.minx"))
        & (c(f"{a}.miny") <= c(f"{b}.maxy"))
        & (c(f"{a}.maxy") >= c(f"{b}.miny"))
    )


def overlaps_extent(boxes: DataFrame, ref: DataFrame) -> DataFrame:
    """Boxes that touch the bounding box of `ref`. The four sides are scalar subqueries, so this is
    a filter on the scan and not a join."""
    side = {s: ref.agg((F.min if s.startswith("min") else F.max)(s)).scalar() for s in SIDES}
    return boxes.filter(
        (F.col("minx") <= side["maxx"])
        & (F.col("maxx") >= side["minx"])
        & (F.col("miny") <= side["maxy"])
        & (F.col("maxy") >= side["miny"])
    )


def _cells(df: DataFrame, cell: float) -> DataFrame:
    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    return df.withColumn("_cx", F.explode(span("minx", "maxx"))).withColumn("_cy", F.explode(span("miny", "maxy")))


def bbox_overlap(boxes: DataFrame, ref: DataFrame, ref_id: str, cell: float) -> DataFrame:
    """Pairs (id, ref_id) of boxes that touch, many boxes on both sides.

    Both sides are cut into grid cells, which gives an equi key. A pair is kept only in the first
    cell both boxes share, so it comes out once and no distinct is needed.
    """
    a = _cells(boxes, cell).alias("a")
    b = _cells(ref.withColumnRenamed("id", ref_id), cell).alias("b")
    first = (F.col("a._cx") == F.greatest(F.floor(F.col("a.minx") / cell), F.floor(F.col("b.minx") / cell))) & (
        F.col("a._cy") == F.greatest(F.floor(F.col("a.miny") / cell), F.floor(F.col("b.miny") / cell))
    )
    same = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    return a.join(b, same & first & _overlaps("a", "b")).select("a.id", f"b.{ref_id}")


def clip_boxes(boxes: DataFrame, bound: tuple[float, float, float, float]) -> DataFrame:
    """Cut boxes to a bound; boxes left without area are dropped."""
    minx, miny, maxx, maxy = (F.lit(float(v)) for v in bound)
    return (
        boxes.withColumn("minx", F.greatest("minx", minx))
        .withColumn("miny", F.greatest("miny", miny))
        .withColumn("maxx", F.least("maxx", maxx))
        .withColumn("maxy", F.least("maxy", maxy))
        .filter((F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")))
    )


def within_bounds(bound: tuple[float, float, float, float]) -> Column:
    minx, miny, maxx, maxy = bound
    return (F.col("minx") >= minx) & (F.col("miny") >= miny) & (F.col("maxx") <= maxx) & (F.col("maxy") <= maxy)


def expand_bbox(boxes: DataFrame, ratio: float) -> DataFrame:
    """Push all sides out by `ratio` of the shorter side."""
    step = F.least(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) * ratio
    out = boxes.withColumn("_step", step)
    return out.select(
        *[F.col(c) for c in boxes.columns if c not in SIDES],
        (F.col("minx") - F.col("_step")).alias("minx"),
        (F.col("miny") - F.col("_step")).alias("miny"),
        (F.col("maxx") + F.col("_step")).alias("maxx"),
        (F.col("maxy") + F.col("_step")).alias("maxy"),
    )


def bbox_ratio(inner: str, outer: str) -> list[Column]:
    """Share of the outer box (two struct columns or join aliases) by area, width and height."""
    wide = lambda b: F.col(f"{b}.maxx") - F.col(f"{b}.minx")
    high = lambda b: F.col(f"{b}.maxy") - F.col(f"{b}.miny")
    return [
        ((wide(inner) * high(inner)) / (wide(outer) * high(outer))).alias("area_ratio"),
        (wide(inner) / wide(outer)).alias("x_ratio"),
        (high(inner) / high(outer)).alias("y_ratio"),
    ]


def boundary_for(boxes: DataFrame, hucs: DataFrame, level: int) -> DataFrame:
    """Boundary rows (column huc2, huc4, ...) of the units that contain the given codes."""
    name = f"huc{level}"
    wanted = hucs.select(huc_prefix(stringify_huc(F.col("huc")), level).alias(name)).distinct()
    return boxes.join(wanted, name, "left_semi")
