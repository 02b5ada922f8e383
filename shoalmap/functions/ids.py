"""Hydrologic unit codes and catchment ids. Codes lose leading zeros in source data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def pad_huc8(c: Column, strict: bool = True) -> Column:
    """Seven digits get a leading zero; any other length than 7 or 8 fails, or is NULL if not strict."""
    bad = F.raise_error(F.concat(F.lit("not a HUC8: "), c)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.length(c) == 8, c).when(F.length(c) == 7, F.concat(F.lit("0"), c)).when(c.isNull(), None).otherwise(bad)


def huc12_str(c: Column) -> Column:
    """A HUC12 held as a number, also as a double, as 12 characters; longer values are NULL."""
    text = c.cast("bigint").cast("string")
    return F.when(F.length(text) <= 12, F.lpad(text, 12, "0"))


def stringify_huc(c: Column) -> Column:
    """Codes have an even number of digits; an odd count means a lost zero."""
    text = c.cast("string")
    return F.when(F.length(text) % 2 == 1, F.concat(F.lit("0"), text)).otherwise(text)


def huc_prefix(c: Column, level: int) -> Column:
    if level % 2 or not 2 <= level <= 12:
        raise ValueError(f"HUC levels are even, from 2 to 12: {level}")
    return F.substring(c, 1, level)


def format_name(c: Column) -> Column:
    """First letter upper, the rest lower (a genus is capitalised, a species is not)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))
