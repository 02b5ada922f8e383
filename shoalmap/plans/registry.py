"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalmap.plans.views import Views, sql_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROW_SQL: dict[str, str] = {}
BODIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(name: str, views: str = "", sql: str | None = None, digest: tuple[str, str] | None = None):
    """Register `fn(views) -> DataFrame`; `views` names the SQL views that `sql` reads.

    `digest` = (group columns, value columns) adds a last aggregate for results of a row per
    prediction and more: all rows are computed, and counted and summed per group. Tests compare
    such results row by row at a small scale.
    """

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        BODIES[name] = fn
        body = fn if digest is None else lambda views_: digested(fn(views_), *digest)
        QUERIES[name] = lambda spark, sf_dir: body(Views(spark, sf_dir))
        if sql is not None:
            needed = tuple(views.split())
            ROW_SQL[name] = sql_with(needed, sql)
            ORACLES[name] = sql_with(needed, sql if digest is None else digest_sql(sql, *digest))
        return fn

    return wrap


def digested(df: DataFrame, groups: str, values: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values.split():
        aggs += [r6(F.sum(v)).alias(f"{v}_sum"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return df.groupBy(*groups.split()).agg(*aggs)


def digest_sql(body: str, groups: str, values: str) -> str:
    parts = [*groups.split(), "count(*) AS n"]
    for v in values.split():
        parts += [R(f"sum({v})", f"{v}_sum"), f"min({v}) AS {v}_min", f"max({v}) AS {v}_max"]
    return f"SELECT {', '.join(parts)} FROM ({body}) GROUP BY ALL"


def r6(c: Column | str) -> Column:
    """Six decimals; the small shift keeps exact halves from falling apart between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), 6)


def R(expr: str, name: str | None = None) -> str:
    """The SQL text of `r6`."""
    text = f"round(({expr}) + 1e-9, 6)"
    return f"{text} AS {name}" if name else text
