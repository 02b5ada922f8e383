"""From stacked predictions and fold coefficients to feature importance per HUC12.

Rows are (species, estimator, huc12, comid); folds are (rep_idx, split_idx). Coefficients do not
vary by catchment and weights do not vary by variable; the two meet as late as possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoalmap.functions.numeric import diff_score
from shoalmap.operators.aggregates import FOLD, ROW, ratio_to
from shoalmap.operators.numbering import beside
from shoalmap.operators.slots import named_slots, slot_sums
from shoalmap.session import cut

SCORE_PREFIX = "scorer:"
MODEL = ["species", "estimator"]
# Estimators that have no coefficients.
WITHOUT_COEFS = ("gradient-boosting-classifier", "hist-gradient-boosting-classifier", "rbf-svc")


def split_coef_score(long: DataFrame, drop_nocoef: bool = False) -> tuple[DataFrame, DataFrame]:
    """Coefficient rows and score rows. Models whose coefficients are all missing lose their
    coefficient rows, and with `drop_nocoef` only models with both parts stay."""
    is_score = F.startswith(F.col("var"), F.lit(SCORE_PREFIX))
    coef, score = long.filter(~is_score), long.filter(is_score)
    known = coef.filter(F.col("value").isNotNull()).select(*MODEL).distinct()
    coef = coef.join(known, MODEL, "left_semi")
    if drop_nocoef:
        coef = coef.join(score.select(*MODEL).distinct(), MODEL, "left_semi")
        score = score.join(known, MODEL, "left_semi")
    return coef, score


def stack_predictions(runs: DataFrame, order: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """All runs in one table. Runs of one species and estimator follow each other: their repeats are
    moved up by the repeats of the runs before. The truth comes once per species."""
    tops = runs.groupBy(*MODEL, order).agg((F.max("rep_idx") + 1).alias("_reps"))
    earlier = Window.partitionBy(*MODEL).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(*MODEL, order, F.coalesce(F.sum("_reps").over(earlier), F.lit(0)).alias("_offset"))
    stacked = runs.join(offsets, [*MODEL, order]).withColumn("rep_idx", F.col("rep_idx") + F.col("_offset"))
    truth = runs.select("species", "huc12", "comid", "y").distinct()
    return stacked.drop("_offset", "y"), truth


def row_norm(coef: DataFrame) -> DataFrame:
    """Coefficients as shares of their sum over the variables of one fold (a few hundred rows)."""
    fold = Window.partitionBy(*MODEL, *FOLD)
    return coef.withColumn("value", F.col("value") / F.sum("value").over(fold))


def fold_scores(score: DataFrame) -> DataFrame:
    """The scores of the folds, written once: the planner knows that they are few and sends them to the predictions."""
    return cut(score.select(*MODEL, *FOLD, F.col("value").alias("_score")), "scores")


def make_weight(pred: DataFrame, score: DataFrame, kind: str = "fitscor_diffscor", legacy: bool = False) -> DataFrame:
    """Weight of every prediction: score of its fold times closeness of the prediction, either
    alone, or 1. `score` holds one scorer."""
    fit, diff = "fit" in kind, "diff" in kind
    wt: Column = F.lit(1.0)
    if fit:
        pred = pred.join(fold_scores(score), [*MODEL, *FOLD])
        wt = wt * F.col("_score")
    if diff:
        wt = wt * diff_score(F.col("y"), F.col("yhat"), legacy)
    return pred.select(*ROW, *FOLD, "y", wt.alias("wt"))


def make_weights(pred: DataFrame, score: DataFrame, kinds: dict[str, str], legacy: bool = False) -> DataFrame:
    """Several kinds of `make_weight` as columns (name: kind) of one pass over the predictions."""
    joined = pred.join(fold_scores(score), [*MODEL, *FOLD])
    close = diff_score(F.col("y"), F.col("yhat"), legacy)
    one = F.lit(1.0)
    columns = [((F.col("_score") if "fit" in kind else one) * (close if "diff" in kind else one)).alias(name) for name, kind in kinds.items()]
    return joined.select(*ROW, *FOLD, "y", *columns)


def cvnorm(wt: DataFrame, fold: list[str] = FOLD) -> DataFrame:
    """Weights of one row sum to 1 over its folds; a row has at most repeats * splits folds."""
    return wt.withColumn("wt", F.col("wt") / F.sum("wt").over(Window.partitionBy(*ROW)))


def _folded(wt: DataFrame, coef: DataFrame, collapse: bool | str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Weights and coefficients at the fold grain of the collapse mode; the coefficients are written, so that
    the planner knows their size."""
    fold: list[str] = []
    if collapse == "split":
        fold = ["rep_idx"]
    elif collapse is not True:
        return wt, cut(coef, "coefs"), list(FOLD)
    means = coef.groupBy(*MODEL, "var", *fold).agg(F.avg("value").alias("value"))
    return wt.groupBy(*ROW, "y", *fold).agg(F.avg("wt").alias("wt")), cut(means, "coefs"), fold


def cv_weighted_coef(coef: DataFrame, wt: DataFrame, collapse: bool | str = False, listed: bool = False) -> DataFrame:
    """Coefficient per (row, var), averaged over folds with the row's weights.

    `collapse`: False keeps folds apart, "split" averages the splits of a repeat first, True takes
    the plain mean over folds. With `listed` a row has its coefficients as the array `coefs` of (var, coef), and
    its mean weight as `row_wt`; it is unfolded by what follows.
    """
    w, c, fold = _folded(wt, coef, collapse)
    if not fold:
        if listed:
            raise ValueError("lists are made from folds")
        return w.select(*ROW).join(c, MODEL).select(*ROW, "var", F.col("value").alias("coef"))
    sums, places, width = slot_sums(w.select(*ROW, *fold, "wt"), c, ROW, fold)
    rows = named_slots(sums, places, width, lambda i: F.col(f"_s{i}") / F.col("_total"), "coef")
    if listed:
        known = F.filter("_named", lambda n: n["on"])
        return rows.select(*ROW, F.col("_mean").alias("row_wt"), F.transform(known, lambda n: F.struct(n["var"].alias("var"), n["coef"].alias("coef"))).alias("coefs"))
    return rows.select(*ROW, F.inline("_named")).filter("on").drop("on")


def huc_weighted_coef(row_coef: DataFrame, wt: DataFrame, equal: bool = False) -> DataFrame:
    """Coefficient per (huc12, var), rows weighted by their mean weight. With `equal` every species
    of a HUC12 counts the same. Listed coefficients bring the mean weight of their row; others meet it."""
    scope = ["huc12", "species"] if equal else ["huc12"]
    mean_wt = wt.groupBy(*ROW).agg(F.avg("wt").alias("wt"))
    total = cut(mean_wt.groupBy(*scope).agg(F.sum("wt").alias("_total")), "totals")
    if "coefs" in row_coef.columns:
        weighed = row_coef.dropna(subset=ROW).select(*ROW, F.col("row_wt").alias("wt"), F.inline("coefs"))
    else:
        weighed = beside(row_coef, mean_wt, ROW)
    # Divided after the sum: only a row per scope meets the totals.
    mixed = weighed.groupBy(*scope, "var").agg(F.sum(F.col("coef") * F.col("wt")).alias("_sum"))
    summed = mixed.join(total, scope).select(*scope, "var", (F.col("_sum") / F.col("_total")).alias("coef"))
    return summed.groupBy("huc12", "var").agg(F.avg("coef").alias("coef")) if equal else summed


def presence_split(row_coef: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row coefficients where the species was not found, and where it was."""
    found = truth.select("species", "huc12", "comid", "y")

    def side(y: int) -> DataFrame:
        own = beside(row_coef, found.filter(F.col("y") == y).drop("y"), ["species", "huc12", "comid"])
        if "coefs" not in row_coef.columns:
            return own.select(*row_coef.columns)
        return own.select(*ROW, F.inline("coefs"))

    return side(0), side(1)


def feature_importance(
    pred: DataFrame,
    coef: DataFrame,
    score: DataFrame,
    kind: str = "fitscor_diffscor",
    collapse: bool | str = False,
    spec_wt: str | None = None,
    presence: bool = False,
    legacy: bool = False,
) -> DataFrame:
    """(huc12, var, coef), with column y first if `presence` splits absent from present rows.

    A row's share in its HUC12 is m / M with m the mean weight of the row, its fold shares are
    w / (n m) with n its number of folds. Their product w / (n M) needs no variable, so weights are
    summed to (huc12, species, estimator, fold) first and only that small table meets the
    coefficients: per row there is one weight sum instead of one product per variable.
    `spec_wt` "equal" or "even" gives every species of a HUC12 the same weight.
    """
    equal = spec_wt in ("equal", "even")
    pred = pred.filter(~F.col("estimator").isin(*WITHOUT_COEFS))
    w, c, fold = _folded(make_weight(pred, score, kind, legacy), coef, collapse)
    row_wt = w.withColumn("_part", F.col("wt") / F.count(F.lit(1)).over(Window.partitionBy(*ROW)))
    if fold == []:
        row_wt = w.withColumn("_part", F.col("wt"))
    scope = ["huc12", "species"] if equal else ["huc12"]
    side = ["y"] if presence else []
    cell = row_wt.groupBy("huc12", *MODEL, *fold, "y").agg(F.sum("_part").alias("_part"))
    total = cell.groupBy(*scope).agg(F.sum("_part").alias("_total"))
    small = cell.groupBy("huc12", *MODEL, *fold, *side).agg(F.sum("_part").alias("_part"))
    summed = (
        small.join(c, [*MODEL, *fold])
        .groupBy(*scope, *side, "var")
        .agg(F.sum(F.col("_part") * F.col("value")).alias("_sum"))
        .join(total, scope)
        .select(*scope, *side, "var", (F.col("_sum") / F.col("_total")).alias("coef"))
    )
    if equal:
        summed = summed.groupBy("huc12", *side, "var").agg(F.avg("coef").alias("coef"))
    return summed.select(*side, "huc12", "var", "coef")


def location_weights(score: DataFrame, pred: DataFrame, norm: str = "comid") -> DataFrame:
    """Mean score of the model times (1 - mean absolute error of the row), as a share of its
    catchment or HUC12."""
    return location_shares(score, pred, ["comid" if norm == "comid" else "huc12"]).withColumnRenamed("by_0", "wt")


def location_shares(score: DataFrame, pred: DataFrame, scopes: list[str]) -> DataFrame:
    """`location_weights` for several scopes: by_0, by_1, ... One pass writes the sums per catchment, a second
    one makes the rows; they are neither written nor moved for a total that is small."""
    model_score = cut(score.groupBy(*MODEL).agg(F.avg("value").alias("_score")), "scores")
    err = pred.groupBy(*ROW).agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("_err"))
    rows = err.join(model_score, MODEL).select(*ROW, (F.col("_score") * (1 - F.col("_err"))).alias("_wt"))
    places = cut(rows.groupBy(*dict.fromkeys(["comid", *scopes])).agg(F.sum("_wt").alias("_wt")), "places")
    out = rows
    for i, scope in enumerate(scopes):
        total = cut(places.groupBy(scope).agg(F.sum("_wt").alias("_total")), "totals")
        out = out.join(total, scope).withColumn(f"by_{i}", F.col("_wt") / F.col("_total")).drop("_total")
    return out.select(*ROW, *[f"by_{i}" for i in range(len(scopes))])


def rank_by_abs_mean(coef: DataFrame) -> DataFrame:
    """Variables by the size of their mean over HUC12 means. One row per variable is ordered."""
    unit = coef.groupBy("huc12", "var").agg(F.avg("coef").alias("coef"))
    means = unit.groupBy("var").agg(F.avg("coef").alias("mean_coef"))
    # The means are rounded so that ties do not depend on the order of the sums.
    order = Window.orderBy(F.abs(F.round("mean_coef", 9)).desc(), "var")
    return means.withColumn("rank", F.row_number().over(order).cast("bigint"))


def rescale_coef(coef: DataFrame, fold_std: DataFrame, global_std: DataFrame) -> DataFrame:
    """Coefficients of fold-standardised features on the scale of the whole sample; 0 where either
    standard deviation is below 0.01."""
    joined = coef.join(fold_std, ["species", "var", *FOLD]).join(global_std, ["species", "var"])
    flat = (F.col("fold_std") < 0.01) | (F.col("global_std") < 0.01)
    scaled = F.when(flat, F.lit(0.0)).otherwise(F.col("value") / F.col("fold_std") * F.col("global_std"))
    return joined.select(*coef.columns, scaled.alias("rescaled"))


def species_coef(coef: DataFrame, score: DataFrame, collapse: bool | str = "split", weighted: bool = True) -> DataFrame:
    """Score-weighted coefficient per (species, var), the input of the clustering.

    True: means over folds, weights normalised over a species' estimators, summed. "split" or False:
    folds (repeats) kept, weights normalised over all folds of a species, summed over folds and
    averaged over estimators.
    """
    s = score.select(*MODEL, *FOLD, F.col("value").alias("score"))
    if collapse is True:
        c = coef.groupBy(*MODEL, "var").agg(F.avg("value").alias("value"))
        if not weighted:
            return c.groupBy("species", "var").agg(F.avg("value").alias("coef"))
        w = ratio_to(s.groupBy(*MODEL).agg(F.avg("score").alias("score")), "score", ["species"], "share")
        return c.join(w, MODEL).groupBy("species", "var").agg(F.sum(F.col("value") * F.col("share")).alias("coef"))
    if not weighted:
        raise ValueError("folds are only kept apart for weighting")
    fold = ["rep_idx"] if collapse == "split" else list(FOLD)
    c, w = coef, s
    if collapse == "split":
        c = coef.groupBy(*MODEL, "var", "rep_idx").agg(F.avg("value").alias("value"))
        w = s.groupBy(*MODEL, "rep_idx").agg(F.avg("score").alias("score"))
    w = ratio_to(w, "score", ["species"], "share")
    per_model = c.join(w, [*MODEL, *fold]).groupBy(*MODEL, "var").agg(F.sum(F.col("value") * F.col("share")).alias("coef"))
    return per_model.groupBy("species", "var").agg(F.avg("coef").alias("coef"))
