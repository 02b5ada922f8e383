"""Set operations on id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def extended_huc8(survey: DataFrame, species_range: DataFrame, given: DataFrame) -> DataFrame:
    """Survey or range HUC8s that are not in the given list."""
    # Distinct first: a set operation deals rows by their value, and a HUC8 has many.
    both = survey.select("huc8").distinct().union(species_range.select("huc8").distinct())
    return both.subtract(given.select("huc8").distinct())


def unsampled_huc8(species_range: DataFrame, survey: DataFrame) -> DataFrame:
    """Range HUC8s of a species where it was not surveyed."""
    return species_range.select("species", "huc8").distinct().subtract(survey.select("species", "huc8").distinct())


def shared_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().intersect(b.distinct())


def stack(dfs: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
