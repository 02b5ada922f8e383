"""Joins that decide where a species could have been found and what work is left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.functions.ids import huc_prefix
from shoalmap.functions.records import override_struct
from shoalmap.operators.numbering import beside, spread_join
from shoalmap.operators.slots import slot_sums
from shoalmap.session import cut, task_floor

# Rows of a task after the species were added to the cells, and the longest list of species and HUC8s that is sent.
TASK_ROWS = 100_000
SENT_ROWS = 1_000_000


def attach_huc12(df: DataFrame, crosswalk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their HUC12 (NULL if none), and the distinct ids that have none."""
    known = crosswalk.select("comid", "huc12")
    return df.join(known, "comid", "left"), df.select("comid").distinct().join(known, "comid", "left_anti")


def range_new_hucs(species_range: DataFrame, survey: DataFrame) -> DataFrame:
    """Range HUC8s that were surveyed without finding the species; only species the survey knows."""
    seen = survey.select("species", "huc8").distinct()
    return (
        species_range.select("species", "huc8")
        .distinct()
        .join(seen.select("huc8").distinct(), "huc8", "left_semi")
        .join(seen.select("species").distinct(), "species", "left_semi")
        .join(seen, ["species", "huc8"], "left_anti")
    )


def range_unmatched(species_range: DataFrame, survey: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Range HUC8s outside the survey, and range species outside the survey."""
    return (
        species_range.select("huc8").distinct().join(survey.select("huc8").distinct(), "huc8", "left_anti"),
        species_range.select("species").distinct().join(survey.select("species").distinct(), "species", "left_anti"),
    )


def presence_absence(survey: DataFrame, species_range: DataFrame | None = None) -> DataFrame:
    """(species, huc8, comid, presence) for every surveyed catchment in a HUC8 of the species.

    A HUC8 belongs to a species if it was found there, or, with a range list, if it is a surveyed
    HUC8 of its range. The observations are read once: their distinct pairs are written and used
    three times.
    """
    return presence_of_pairs(cut(survey.select("species", "comid", "huc8").distinct(), "pairs"), species_range)


def presence_of_pairs(pairs: DataFrame, species_range: DataFrame | None = None, crosswalk: DataFrame | None = None) -> DataFrame:
    """As `presence_absence`, from a stored table of distinct (species, comid, huc8); with a crosswalk also
    huc12, for the catchments it knows.

    A catchment carries the species found in it, a list no longer than the list of species, so nothing is
    moved after the species of its HUC8 were added.
    """
    where = pairs.select("species", "huc8").distinct()
    if species_range is not None:
        where = where.unionByName(range_new_hucs(species_range, pairs))
    known = F.array_contains("_found", F.col("species")) & F.col("comid").isNotNull()

    def cells(n: int) -> DataFrame:
        placed = pairs.groupBy("comid").agg(F.collect_set("species").alias("_found"), F.collect_set("huc8").alias("_units"))
        # Dealt last, as a small side of the join would be sent and its partitions lost.
        placed = (placed if crosswalk is None else placed.join(crosswalk, "comid")).repartition(n, "comid")
        return placed.select(*[c for c in placed.columns if c != "_units"], F.explode("_units").alias("huc8"))

    out = region_join(pairs.select("comid", "huc8"), cells, where)
    more = [] if crosswalk is None else [c for c in crosswalk.columns if c != "comid"]
    return out.select("species", "huc8", "comid", F.coalesce(known, F.lit(False)).cast("int").alias("presence"), *more)


def region_join(places: DataFrame, cells: Callable[[int], DataFrame], where: DataFrame) -> DataFrame:
    """Every cell with every species of its HUC8, in as many tasks as keep each at about `TASK_ROWS` rows.

    `cells(n)` gives the cells in n partitions by comid, `places` their (comid, huc8), in which rows may repeat.
    The list of species and HUC8s is written once and sent to the tasks, so that rows stay where their
    catchment is and later groups by catchment need no shuffle. A list of more than `SENT_ROWS` rows is joined.
    """
    where = cut(where, "where")
    listed = where.groupBy("huc8").agg(F.count(F.lit(1)).alias("_species"))
    # An estimate is enough to choose the number of tasks.
    rows = places.groupBy("huc8").agg(F.approx_count_distinct("comid").alias("_cells")).join(listed, "huc8")
    total = rows.agg(F.sum(F.col("_cells") * F.col("_species")).alias("total")).first()["total"] or 0
    n = max(-(-total // TASK_ROWS), task_floor(where.sparkSession))
    # As many as a join before it has would be dropped as dealt already, and its tasks merged by the bytes of few columns.
    n += n == int(where.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if where.count() > SENT_ROWS:
        return spread_join(cells(n), where, ["huc8"], ["comid"])
    return cells(n).join(F.broadcast(where), "huc8")


def with_metrics(pa: DataFrame, metric: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose catchment has metrics, and the distinct catchments dropped."""
    known = metric.select("comid").distinct()
    return pa.join(known, "comid", "left_semi"), pa.select("comid").distinct().join(known, "comid", "left_anti")


def predict_universe(survey: DataFrame, species_range: DataFrame, crosswalk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(species, huc12, comid) to predict: all catchments in survey or range HUC8s; and the HUC8s
    that the crosswalk lacks."""
    where = survey.select("species", "huc8").union(species_range.select("species", "huc8")).distinct()
    cells = crosswalk.select("comid", "huc12", huc_prefix(F.col("huc12"), 8).alias("huc8"))
    universe = region_join(cells, lambda n: cells.repartition(n, "comid"), where).select("species", "huc12", "comid")
    missing = where.select("huc8").distinct().join(cells.select("huc8").distinct(), "huc8", "left_anti")
    return universe, missing


def missing_comids(pred: DataFrame, universe: DataFrame, level: int) -> DataFrame:
    """Catchments of the HUCs with predictions that were not predicted themselves.

    They are shown as y = 1 for coarse units (level 8 or less), else left empty.
    """
    unit = huc_prefix(F.col("huc12"), level)
    touched = pred.select(unit.alias("unit")).distinct()
    fill = F.lit(1) if level <= 8 else F.lit(None).cast("int")
    return (
        universe.select("comid", "huc12", unit.alias("unit"))
        .distinct()
        .join(touched, "unit", "left_semi")
        .join(pred.select("comid").distinct(), "comid", "left_anti")
        .select("comid", "huc12", fill.alias("y"))
    )


def align_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Repeat the truth of a catchment over its estimators, repeats and splits."""
    on = ["species", "huc12", "comid"]
    rest = [c for c in pred.columns if c not in (*on, "y")]
    return beside(pred.drop("y"), truth.select(*on, "y"), on).select(*on, *rest, "y")


def mul_xb(x: DataFrame, coef: DataFrame, wt: DataFrame | None = None) -> DataFrame:
    """x * b per row and variable, averaged over repeats and splits, or summed with weights.

    Without weights the coefficients are averaged before the join: x does not vary over the folds,
    so mean(x * b) = x * mean(b) and the join stays one row per (row, estimator, variable).
    """
    row = ["species", "estimator", "huc12", "comid", "var"]
    if wt is None:
        b = cut(coef.groupBy("species", "estimator", "var").agg(F.avg("value").alias("b")), "coefs")
        return x.join(b, ["species", "var"]).select(*row, (F.col("x") * F.col("b")).alias("xb"))
    keys, fold = row[:4], ["rep_idx", "split_idx"]
    sums, places, width = slot_sums(wt.select(*keys, *fold, "wt"), coef, keys, fold)
    mixed = sums.select(*keys, "chunk", "_known", F.array(*[f"_s{i}" for i in range(width)]).alias("_sums"))
    # Only rows are met, a variable finds its sum by its place.
    place = F.broadcast(places.withColumnsRenamed({"chunk": "_chunk", "pos": "_pos"}))
    x = x.select("species", "huc12", "comid", "var", "x").join(place, "var")
    met = beside(mixed, x, ["species", "huc12", "comid"]).filter((F.col("chunk") == F.col("_chunk")) & (F.getbit("_known", "_pos") == 1))
    return met.select(*row, (F.col("x") * F.get("_sums", F.col("_pos"))).alias("xb"))


def pending(plan: DataFrame, done: DataFrame, failed: DataFrame | None, keys: list[str]) -> DataFrame:
    """Planned work that is neither done nor failed."""
    left = plan.join(done.select(*keys).distinct(), keys, "left_anti")
    return left if failed is None else left.join(failed.select(*keys).distinct(), keys, "left_anti")


def is_complete(plan: DataFrame, done: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per `by` group: planned and finished counts and whether nothing is left."""
    seen = done.select(*keys).distinct().withColumn("_done", F.lit(1))
    return (
        plan.select(*keys)
        .distinct()
        .join(seen, keys, "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("planned"), F.count("_done").alias("finished"))
        .withColumn("complete", F.col("planned") == F.col("finished"))
    )


def purge_orphans(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Plan rows that have a result."""
    return plan.join(results.select(*keys).distinct(), keys, "left_semi")


def append_new(index: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The index plus the results it does not list yet."""
    return index.unionByName(results.select(*index.columns).join(index.select(*keys).distinct(), keys, "left_anti"))


def param_grid(df: DataFrame, record: str, variations: dict[str, list]) -> DataFrame:
    """Every combination of listed values, set in the struct column `record` of every base row.

    Dots in a name reach nested fields. Value lists are literals, so the grid is an explode of
    arrays inside each row and needs no join.
    """
    for name, values in variations.items():
        df = df.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in values])))
        spec: dict | Column = F.col("_v")
        for part in reversed(name.split(".")):
            spec = {part: spec}
        df = df.withColumn(record, override_struct(F.col(record), spec)).drop("_v")
    return df


def merge_keyed(dfs: list[DataFrame], key: str, overwrite: bool = True) -> DataFrame:
    """Stack keyed tables. A key seen again replaces the earlier rows, or gets the suffix `_i`
    of the table it came from."""
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("_file", F.lit(i)) for i, df in enumerate(dfs)],
    )
    ends = F.max("_file") if overwrite else F.min("_file")
    edge = reduce(lambda a, b: a.union(b), [df.select(key).distinct().withColumn("_file", F.lit(i)) for i, df in enumerate(dfs)])
    edge = edge.groupBy(key).agg(ends.alias("_edge"))
    joined = stacked.join(edge, key)
    if overwrite:
        return joined.filter(F.col("_file") == F.col("_edge")).drop("_file", "_edge")
    renamed = F.when(F.col("_file") == F.col("_edge"), F.col(key)).otherwise(F.concat_ws("_", F.col(key), F.col("_file")))
    return joined.withColumn(key, renamed).drop("_file", "_edge")


def partial_match(runs: DataFrame, targets: DataFrame, target_id: str, fields: list[str], relax: list[str]) -> DataFrame:
    """Saved runs equal to a target on all `fields`; if none is, one more field of `relax` is left
    out at a time, and the first level with a hit wins.

    Each level only tries the targets that no earlier level matched.
    """
    if not set(fields) - set(relax):
        raise ValueError("at least one field must always match")
    parts, open_targets = [], targets.select(target_id, *fields)
    for level in range(len(relax) + 1):
        on = [f for f in fields if f not in relax[:level]]
        hits = open_targets.select(target_id, *on).join(runs, on).select(target_id, *runs.columns)
        parts.append(hits.withColumn("match_level", F.lit(level)))
        known = runs.select(*on).distinct()
        open_targets = open_targets.join(known, on, "left_anti")
    return reduce(lambda a, b: a.unionByName(b), parts)


def species_mismatch(external: DataFrame, species: DataFrame) -> DataFrame:
    """Rows of an outside result table whose species is not in the species list."""
    return external.join(species.select("species").distinct(), "species", "left_anti")


def select_keys(dfs: list[DataFrame], key: str, values: list | DataFrame) -> list[DataFrame]:
    """The rows of each table whose key is one of a short list or a column of another table."""
    if isinstance(values, DataFrame):
        wanted = values.select(key).distinct()
        return [df.join(wanted, key, "left_semi") for df in dfs]
    return [df.filter(F.col(key).isin(*values)) for df in dfs]


def crosswalk_lookup(crosswalk: DataFrame, huc12: str | None = None, comid: str | None = None) -> DataFrame:
    """All rows of one HUC12, or one row for a catchment with a message if it is unknown."""
    if huc12 is not None:
        return crosswalk.filter(F.col("huc12") == huc12)
    hit = crosswalk.filter(F.col("comid") == comid).agg(F.min("huc12").alias("huc12"))
    return hit.select(
        F.lit(comid).alias("comid"),
        "huc12",
        F.when(F.col("huc12").isNull(), F.lit("not found")).otherwise("ok").alias("message"),
    )


def lookup_many(crosswalk: DataFrame, wanted: DataFrame) -> DataFrame:
    """The catchment lookup for a table of ids."""
    return wanted.select("comid").distinct().join(crosswalk.select("comid", "huc12"), "comid", "left").select(
        "comid", "huc12", F.when(F.col("huc12").isNull(), F.lit("not found")).otherwise("ok").alias("message")
    )
