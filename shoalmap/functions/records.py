"""Nested records: content ids, flattening, overrides and equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_id(*cols: Column | str) -> Column:
    """The same content gives the same id, whatever wrote it."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def _leaves(dtype: T.StructType, path: list[str]):
    for field in dtype.fields:
        here = [*path, field.name]
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, here)
        else:
            yield here


def flatten_struct(df: DataFrame, col: str, sep: str = ":") -> DataFrame:
    """One column per leaf of a nested struct, named `a:b`."""
    dtype = df.schema[col].dataType
    if not isinstance(dtype, T.StructType):
        raise TypeError(f"{col} is not a struct")
    others = [F.col(f"`{c}`") for c in df.columns if c != col]
    leaves = [F.col(".".join(f"`{p}`" for p in [col, *path])).alias(sep.join(path)) for path in _leaves(dtype, [])]
    return df.select(*others, *leaves)


def override_struct(col: Column, spec: dict) -> Column:
    """Replace only the fields that `spec` names, also inside nested structs."""
    for name, value in spec.items():
        if isinstance(value, dict):
            col = col.withField(name, override_struct(col.getField(name), value))
        else:
            col = col.withField(name, value if isinstance(value, Column) else F.lit(value))
    return col


def override_map(col: Column, other: Column) -> Column:
    """Keys of `other` win."""
    return F.map_from_entries(
        F.concat(
            F.filter(F.map_entries(col), lambda e: ~F.map_contains_key(other, e["key"])),
            F.map_entries(other),
        )
    )


def struct_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def map_equal(a: Column, b: Column) -> Column:
    """Maps have no order: compare their sorted entries."""
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def set_key(df: DataFrame, key: str, value) -> DataFrame:
    """The same value for one key in all rows."""
    return df.withColumn(key, F.lit(value))
