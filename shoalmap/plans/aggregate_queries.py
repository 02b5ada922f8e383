"""Checked queries for grouped summaries, importance, losses and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalmap.functions.records import content_id
from shoalmap.operators import aggregates as ag
from shoalmap.operators import importance as im
from shoalmap.operators import losses as ls
from shoalmap.operators import runs as rn
from shoalmap.operators.features import as_vectors
from shoalmap.operators.joins import presence_absence, range_new_hucs
from shoalmap.operators.linear import ols, predict_linear
from shoalmap.plans.registry import R, query, r6
from shoalmap.plans.views import VARIABLES

C = F.col


def text(c):
    return F.concat_ws(",", c)


@query(
    "d01_species_lists",
    "survey",
    """SELECT species, first_order, first_line, n_rows, comid, huc8 FROM
       (SELECT species, CAST(floor(min(l_orderkey * 100 + l_linenumber) / 100) AS BIGINT) AS first_order,
               CAST(min(l_orderkey * 100 + l_linenumber) % 100 AS INTEGER) AS first_line, count(*) AS n_rows FROM survey GROUP BY species)
       JOIN (SELECT DISTINCT species, comid, huc8 FROM survey) USING (species)""",
)
def _(v):
    heads, places = ag.species_lists(v.survey, ["l_orderkey", "l_linenumber"])
    first = heads.select("species", C("first_row.l_orderkey").alias("first_order"), C("first_row.l_linenumber").alias("first_line"), "n_rows")
    return first.join(places, "species")


@query(
    "d01_species_occurrences",
    "survey",
    """SELECT species, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS species_index, row_index, comid, huc8 FROM
       (SELECT *, min(row_index) OVER (PARTITION BY species) AS first FROM
       (SELECT species, comid, huc8, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, species NULLS FIRST, comid NULLS FIRST, huc8 NULLS FIRST) - 1 AS BIGINT) AS row_index FROM survey))""",
)
def _(v):
    return ag.species_occurrences(v.survey, ["l_orderkey", "l_linenumber"])


@query(
    "d02_distinct_comids",
    "survey",
    "SELECT 'all' AS huc8, comid FROM (SELECT DISTINCT comid FROM survey) UNION ALL SELECT huc8, comid FROM (SELECT DISTINCT huc8, comid FROM survey)",
)
def _(v):
    return ag.distinct_comids(v.survey).select(F.lit("all").alias("huc8"), "comid").unionByName(ag.comids_per_huc8(v.survey))


@query(
    "d03_huc12_comids",
    "crosswalk",
    "SELECT huc12, CAST(0 AS BIGINT) AS block, string_agg(comid, ',' ORDER BY comid) AS members FROM crosswalk GROUP BY huc12",
)
def _(v):
    return ag.huc12_comids(v.crosswalk).withColumn("members", text("members"))


@query("d03_invert_map", "crosswalk", "SELECT comid, max(huc12) AS huc12 FROM crosswalk GROUP BY comid")
def _(v):
    return ag.invert_map(ag.huc12_comids(v.crosswalk))


@query("d04_huc_hierarchy", "crosswalk", "SELECT DISTINCT substr(huc12, 1, 2) AS huc2, substr(huc12, 1, 8) AS huc8, huc12 FROM crosswalk")
def _(v):
    return ag.huc_hierarchy(v.crosswalk)


NEW_HUCS = """new_hucs AS (SELECT species, huc8 FROM species_range r WHERE huc8 IN (SELECT huc8 FROM survey) AND species IN (SELECT species FROM survey)
       AND NOT EXISTS (SELECT 1 FROM survey s WHERE s.species = r.species AND s.huc8 = r.huc8))"""


@query(
    "d05_species_huc8",
    "survey species_range",
    f"""WITH {NEW_HUCS} SELECT 'range' AS kind, species, huc8 FROM species_range UNION ALL SELECT 'new', species, huc8 FROM new_hucs""",
)
def _(v):
    new = ag.species_huc8(v.species_range, new_hucs=range_new_hucs(v.species_range, v.survey))
    return ag.species_huc8(v.species_range).select(F.lit("range").alias("kind"), "species", "huc8").union(new.select(F.lit("new"), "species", "huc8"))


STEM = r"regexp_replace(metric, '^(.*?)20[0-9][0-9](.*)$', '\1\2_avg')"
PARSED = "CASE WHEN value IN ('', 'NA') THEN CAST('nan' AS DOUBLE) ELSE TRY_CAST(value AS DOUBLE) END"


@query(
    "d06_collapse_years",
    "metric_raw",
    rf"""WITH m AS (SELECT comid, regexp_replace(metric, '19[0-9][0-9]', '20' || substr(metric, 7, 2)) AS metric, value FROM metric_raw)
       SELECT comid, {STEM} AS stem, CASE WHEN isnan(avg({PARSED})) THEN NULL ELSE {R(f"avg({PARSED})")} END AS value FROM m GROUP BY 1, 2""",
)
def _(v):
    years = v.metric_raw.withColumn("metric", F.regexp_replace("metric", "19([0-9][0-9])", "20$1"))
    return ag.collapse_years(years).withColumn("value", r6(F.nanvl("value", F.lit(None).cast("double"))))


# All metrics of the test table: five priorities, seven years.
METRICS = [f"Pct{k}{year}Cat" for k in range(1, 6) for year in range(1995, 2002)]


@query(
    "d07_widen",
    "metric_raw",
    f"""SELECT comid, {", ".join(f"max(CASE WHEN metric = '{k}' THEN v END) AS {k}" for k in METRICS)}
       FROM (SELECT comid, metric, CASE WHEN isnan(p) THEN NULL ELSE p END AS v FROM
       (SELECT comid, metric, {PARSED} AS p FROM metric_raw)) GROUP BY comid""",
)
def _(v):
    from shoalmap.functions.metric_names import parse_metric

    null = F.lit(None).cast("double")
    long = v.metric_raw.withColumn("value", F.nanvl(parse_metric(C("value")), null))
    wide = ag.widen(long, METRICS, col="metric")
    return wide.select("comid", *[F.nanvl(C(k), null).alias(k) for k in METRICS])


def species_x(v):
    return v.truth.select("species", "huc12", "comid", "y").join(v.features, "comid")


@query(
    "d08_species_meta",
    "truth features",
    f"""SELECT species, var, count(x) AS n, {R("avg(x)", "mean")}, {R("stddev_samp(x)", "std")}, min(x) AS min, max(x) AS max,
       {R("quantile_cont(x, 0.25)", "q25")}, {R("quantile_cont(x, 0.5)", "q50")}, {R("quantile_cont(x, 0.75)", "q75")}
       FROM truth JOIN features USING (comid) GROUP BY species, var""",
)
def _(v):
    meta = ag.species_meta(species_x(v))
    return meta.select("species", "var", "n", "min", "max", *[r6(c).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query(
    "d09_eligible_species",
    "truth",
    "SELECT species, count(*) AS n, CAST(sum(y) AS BIGINT) AS ones FROM truth GROUP BY species HAVING count(*) >= 32 AND sum(y) >= 8",
)
def _(v):
    return ag.eligible_species(v.truth)


@query("d10_large_enough", "truth", "SELECT species, count(*) AS n FROM truth GROUP BY species HAVING count(*) >= ceil(2 * 300 / 0.8)")
def _(v):
    return ag.large_enough(v.truth, 300)


SITE = """site AS (SELECT huc12, comid, sum(y) AS f, sum(1 - y) AS nf, avg(y) AS s FROM truth GROUP BY 1, 2),
       unit AS (SELECT huc12, avg(f) AS f, avg(nf) AS nf, avg(s) AS s, avg(f) + avg(nf) AS p FROM site GROUP BY 1)"""


@query(
    "d11_richness",
    "truth",
    f"WITH {SITE} SELECT huc12, {R('f', 'found')}, {R('nf', 'not_found')}, {R('s', 'share_found')}, {R('p', 'potential')} FROM unit",
)
def _(v):
    return ag.richness(v.truth).select("huc12", *[r6(c).alias(c) for c in ("found", "not_found", "share_found", "potential")])


@query(
    "d11_richness_huc8",
    "truth",
    f"""WITH {SITE} SELECT substr(huc12, 1, 8) AS huc8, {R('avg(f)', 'found')}, {R('avg(nf)', 'not_found')}, {R('avg(s)', 'share_found')}, {R('avg(p)', 'potential')} FROM unit GROUP BY 1""",
)
def _(v):
    return ag.richness(v.truth, 8).select("huc8", *[r6(c).alias(c) for c in ("found", "not_found", "share_found", "potential")])


@query(
    "d12_confusion_by_huc",
    "pred",
    f"""WITH r AS (SELECT species, estimator, huc12, comid, y, avg(y - yhat) AS g, avg(abs(y - yhat)) AS s FROM pred GROUP BY ALL)
       SELECT substr(huc12, 1, 8) AS huc8, {R("avg(CASE WHEN y = 1 THEN 1 - g END)", "tp")}, {R("avg(CASE WHEN y = 0 THEN s END)", "fp")},
       {R("avg(CASE WHEN y = 1 THEN g END)", "fn")}, {R("avg(CASE WHEN y = 0 THEN 1 - s END)", "tn")} FROM r GROUP BY 1""",
)
def _(v):
    return ag.confusion_by_huc(v.pred, 8).select("huc8", *[r6(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


@query(
    "d13_huc_aggregate",
    "pred",
    f"""SELECT 'huc4' AS level, substr(huc12, 1, 4) AS unit, {R("avg(yhat)", "yhat")} FROM pred GROUP BY 2
       UNION ALL SELECT 'kept', substr(huc12, 1, 2), {R("max(yhat)")} FROM pred GROUP BY 2""",
)
def _(v):
    rows = v.pred.select("huc12", "yhat")
    mean = ag.huc_aggregate(rows, 4).select(F.lit("huc4").alias("level"), C("huc4").alias("unit"), r6("yhat").alias("yhat"))
    kept = ag.huc_aggregate(rows, 2, collapse=False).groupBy("huc2").agg(r6(F.max("yhat")).alias("yhat"))
    return mean.union(kept.select(F.lit("kept"), "huc2", "yhat"))


@query(
    "d14_error_by_huc",
    "pred",
    f"""WITH r AS (SELECT species, estimator, huc12, comid, avg(y - yhat) AS e, avg(abs(y - yhat)) AS a FROM pred GROUP BY ALL)
       SELECT huc12, {R("avg(e)", "err")}, {R("1 - avg(a)", "accuracy")} FROM r GROUP BY 1""",
)
def _(v):
    return ag.error_by_huc(v.pred).select("huc12", r6("err").alias("err"), r6("accuracy").alias("accuracy"))


@query(
    "d15_mean_over_estimators",
    "pred",
    f"SELECT species, huc12, comid, rep_idx, split_idx, {R('avg(yhat)', 'yhat')} FROM pred GROUP BY ALL",
)
def _(v):
    return ag.mean_over_estimators(v.pred).withColumn("yhat", r6("yhat"))


@query("d16_cv_probability", "pred", f"SELECT species, estimator, huc12, comid, {R('avg(yhat)', 'y')} FROM pred GROUP BY ALL")
def _(v):
    return ag.cv_probability(v.pred).withColumn("y", r6("y"))


@query(
    "d17_split_by_huc",
    "pred",
    "SELECT substr(huc12, 1, 8) AS huc8, count(*) AS n, count(DISTINCT species) AS n_species FROM pred GROUP BY 1",
)
def _(v):
    split = ag.split_by_huc(v.pred.select("species", "huc12"), 8).groupBy("huc8").agg(F.count(F.lit(1)).alias("n"))
    species = ag.predicted_huc8(v.pred).groupBy("huc8").agg(F.count(F.lit(1)).alias("n_species"))
    return split.join(species, "huc8")


PROB = "prob AS (SELECT species, huc12, comid, avg(yhat) AS y FROM pred GROUP BY ALL)"


@query(
    "d18_classify",
    "pred",
    f"""WITH {PROB} SELECT species, huc12, comid, CASE WHEN round(y, 9) >= 0.5 THEN 'present' ELSE 'absent' END AS kind FROM prob""",
)
def _(v):
    prob = ag.cv_probability(v.pred, ["species", "huc12", "comid"]).withColumn("y", F.round("y", 9))
    return ag.classify(prob, include_absent=True).drop("y")


@query(
    "d19_merge_species",
    "pred",
    f"""WITH {PROB} SELECT huc12, comid, {R("sum(y)", "total")}, {R("avg(y)", "mean")}, {R("avg(1 - y)", "inverse_sum")}, {R("sum(1 - y)", "inverse_total")} FROM prob GROUP BY 1, 2""",
)
def _(v):
    prob = ag.cv_probability(v.pred, ["species", "huc12", "comid"])
    out = ag.merge_species(prob, ["sum", "mean", "inverse_sum", "inverse_total"]).withColumnRenamed("sum", "total")
    return out.select("huc12", "comid", *[r6(c).alias(c) for c in ("total", "mean", "inverse_sum", "inverse_total")])


@query("d20_value_range", "pred", "SELECT min(yhat) AS low, max(yhat) AS high FROM pred")
def _(v):
    return ag.value_range(v.pred, "yhat")


@query(
    "d21_score_table",
    "score",
    """WITH s AS (SELECT 0 AS part, * FROM score WHERE fold % 2 = 0 UNION ALL SELECT 1, * FROM score WHERE fold % 2 = 1)
       SELECT species, estimator, scorer_id, fold, value, row_number() OVER (PARTITION BY scorer_id, estimator, species ORDER BY part, fold) AS place FROM s""",
)
def _(v):
    even, odd = v.score.filter(C("fold") % 2 == 0), v.score.filter(C("fold") % 2 == 1)
    return ag.score_table([even, odd])


@query("d22_drop_nan_species", "score", "SELECT * FROM score WHERE species NOT IN (SELECT species FROM score WHERE value IS NULL)")
def _(v):
    return ag.drop_nan_species(v.score)


@query(
    "d23_score_mlu",
    "score",
    f"""WITH s AS (SELECT scorer_id, estimator, species, avg(value) AS m, list_sort(list(coalesce(value, CAST('nan' AS DOUBLE)))) AS l, count(*) - 1 AS t FROM score GROUP BY 1, 2, 3),
       b AS (SELECT *, l[CAST(floor(t * CAST(0.025 AS DOUBLE)) AS BIGINT) + 1] AS lo, l[CAST(ceil(t * CAST(0.975 AS DOUBLE)) AS BIGINT) + 1] AS hi FROM s)
       SELECT scorer_id, estimator, species, {R("m", "mean")}, CASE WHEN isnan(lo) THEN NULL ELSE lo END AS lower, CASE WHEN isnan(hi) THEN NULL ELSE hi END AS upper FROM b""",
)
def _(v):
    return ag.score_mlu(v.score).withColumn("mean", r6("mean"))


BEST = """means AS (SELECT scorer_id, species, estimator, avg(value) AS score FROM score GROUP BY 1, 2, 3 HAVING avg(value) IS NOT NULL),
       best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scorer_id, species ORDER BY score DESC, estimator) AS k FROM means) WHERE k = 1)"""


@query("d24_best_estimator", "score", f"WITH {BEST} SELECT scorer_id, species, estimator, {R('score', 'score')} FROM best")
def _(v):
    return ag.best_estimator(v.score).withColumn("score", r6("score"))


@query(
    "d25_stack_predictions",
    "pred",
    """SELECT CASE WHEN estimator = 'logit' THEN 'lpm' ELSE estimator END AS estimator, species, huc12, comid,
       CAST(rep_idx + CASE WHEN estimator = 'lpm' THEN 2 ELSE 0 END AS BIGINT) AS rep_idx, split_idx, yhat FROM pred""",
    digest=("species estimator rep_idx split_idx", "yhat"),
)
def _(v):
    # Runs named logit and lpm become two runs of one estimator, in the order of their names.
    runs = v.pred.withColumn("run_id", C("estimator")).withColumn("estimator", F.when(C("estimator") == "logit", "lpm").otherwise(C("estimator")))
    stacked, _truth = im.stack_predictions(runs)
    return stacked.drop("run_id")


@query("d25_stack_truth", "truth", "SELECT DISTINCT species, huc12, comid, y FROM truth")
def _(v):
    return im.stack_predictions(v.pred.withColumn("run_id", C("estimator")))[1]


@query(
    "d26_row_norm",
    "coef",
    f"""SELECT species, estimator, var, rep_idx, split_idx, {R("v / sum(v) OVER (PARTITION BY species, estimator, rep_idx, split_idx)", "value")}
       FROM (SELECT * EXCLUDE (value), value + 5 AS v FROM coef)""",
)
def _(v):
    return im.row_norm(v.coef.withColumn("value", C("value") + 5)).withColumn("value", r6("value"))


@query("d27_drop_pseudo", "truth", "SELECT species, huc12, comid, y FROM truth")
def _(v):
    pseudo = v.truth.select("huc12", "comid").distinct().select(F.lit(ag.PSEUDO_SPECIES).alias("species"), "huc12", "comid", F.lit(1).alias("y"))
    return ag.drop_pseudo(v.truth.unionByName(pseudo))


F1 = "f1 AS (SELECT * EXCLUDE (scorer) FROM fit_score WHERE scorer = 'f1_micro')"
WT = f"""{F1}, w AS (SELECT species, estimator, huc12, comid, rep_idx, split_idx, y, f1.value * exp(-abs(yhat - y)) AS wt, f1.value AS fit, exp(-abs(yhat - y)) AS diff
       FROM pred JOIN f1 USING (species, estimator, rep_idx, split_idx))"""
NORM = f"""{WT}, nw AS (SELECT *, wt / sum(wt) OVER (PARTITION BY species, estimator, huc12, comid) AS nwt FROM w)"""
ROWC = f"""{NORM}, rc AS (SELECT species, estimator, huc12, comid, var, sum(nwt * value) AS coef FROM nw JOIN coef USING (species, estimator, rep_idx, split_idx) GROUP BY ALL)"""
SHARE = """mw AS (SELECT species, estimator, huc12, comid, avg(wt) AS m FROM w GROUP BY ALL),
       sh AS (SELECT *, m / sum(m) OVER (PARTITION BY huc12) AS share, m / sum(m) OVER (PARTITION BY huc12, species) AS share_eq FROM mw)"""


def one_scorer(v):
    return v.fit_score.filter(C("scorer") == "f1_micro").drop("scorer")


@query(
    "d28_make_weight",
    "pred fit_score",
    f"WITH {WT} SELECT species, estimator, huc12, comid, rep_idx, split_idx, {R('wt', 'wt')}, {R('fit', 'fit')}, {R('diff', 'diff')}, CAST(1 AS DOUBLE) AS one FROM w",
    digest=("species estimator rep_idx", "wt fit diff"),
)
def _(v):
    kinds = {"wt": "fitscor_diffscor", "fit": "fitscor", "diff": "diffscor", "one": "none"}
    out = im.make_weights(v.pred, one_scorer(v), kinds)
    return out.select(*ag.ROW, *ag.FOLD, *[r6(k).alias(k) for k in ("wt", "fit", "diff")], "one")


@query("d29_cvnorm", "pred fit_score", f"WITH {NORM} SELECT species, estimator, huc12, comid, rep_idx, split_idx, {R('nwt', 'wt')} FROM nw", digest=("species estimator rep_idx", "wt"))
def _(v):
    return im.cvnorm(im.make_weight(v.pred, one_scorer(v))).drop("y").withColumn("wt", r6("wt"))


@query(
    "d30_cv_weighted_coef",
    "pred coef fit_score",
    f"WITH {ROWC} SELECT species, estimator, huc12, comid, var, {R('coef', 'coef')} FROM rc",
    digest=("huc12 var", "coef"),
)
def _(v):
    return im.cv_weighted_coef(v.coef, im.make_weight(v.pred, one_scorer(v))).withColumn("coef", r6("coef"))


@query(
    "d30_cv_weighted_coef_by_repeat",
    "pred coef fit_score",
    f"""WITH {WT}, rw AS (SELECT species, estimator, huc12, comid, rep_idx, avg(wt) AS wt FROM w GROUP BY ALL),
       c AS (SELECT species, estimator, var, rep_idx, avg(value) AS value FROM coef GROUP BY ALL)
       SELECT species, estimator, huc12, comid, var, {R("sum(wt * value) / sum(wt)", "coef")} FROM rw JOIN c USING (species, estimator, rep_idx) GROUP BY ALL""",
    digest=("huc12 var", "coef"),
)
def _(v):
    return im.cv_weighted_coef(v.coef, im.make_weight(v.pred, one_scorer(v)), "split").withColumn("coef", r6("coef"))


@query(
    "d30_cv_weighted_coef_collapsed",
    "truth coef",
    f"""WITH c AS (SELECT species, estimator, var, avg(value) AS coef FROM coef GROUP BY ALL)
       SELECT species, estimator, huc12, comid, var, {R("coef", "coef")} FROM truth JOIN c USING (species)""",
    digest=("huc12 var", "coef"),
)
def _(v):
    return im.cv_weighted_coef(v.coef, im.make_weight(v.pred, one_scorer(v)), True).withColumn("coef", r6("coef"))


@query(
    "d31_huc_weighted_coef",
    "pred coef fit_score",
    f"WITH {ROWC}, {SHARE} SELECT huc12, var, {R('sum(coef * share)', 'coef')} FROM rc JOIN sh USING (species, estimator, huc12, comid) GROUP BY ALL",
)
def _(v):
    wt = im.make_weight(v.pred, one_scorer(v))
    return im.huc_weighted_coef(im.cv_weighted_coef(v.coef, wt, listed=True), wt).withColumn("coef", r6("coef"))


@query(
    "d31_huc_weighted_coef_equal",
    "pred coef fit_score",
    f"""WITH {ROWC}, {SHARE}, s AS (SELECT huc12, species, var, sum(coef * share_eq) AS coef FROM rc JOIN sh USING (species, estimator, huc12, comid) GROUP BY ALL)
       SELECT huc12, var, {R('avg(coef)', 'coef')} FROM s GROUP BY ALL""",
)
def _(v):
    wt = im.make_weight(v.pred, one_scorer(v))
    return im.huc_weighted_coef(im.cv_weighted_coef(v.coef, wt, listed=True), wt, equal=True).withColumn("coef", r6("coef"))


@query(
    "d32_presence_split",
    "pred coef fit_score",
    f"WITH {ROWC} SELECT y AS side, species, estimator, huc12, comid, var, {R('coef', 'coef')} FROM rc JOIN truth USING (species, huc12, comid)",
    digest=("side huc12 var", "coef"),
)
def _(v):
    absent, present = im.presence_split(im.cv_weighted_coef(v.coef, im.make_weight(v.pred, one_scorer(v)), listed=True), v.truth)
    return absent.withColumn("side", F.lit(0)).unionByName(present.withColumn("side", F.lit(1))).withColumn("coef", r6("coef"))


@query(
    "d33_feature_importance",
    "pred coef fit_score",
    f"WITH {ROWC}, {SHARE} SELECT huc12, var, {R('sum(coef * share)', 'coef')} FROM rc JOIN sh USING (species, estimator, huc12, comid) GROUP BY ALL",
)
def _(v):
    return im.feature_importance(v.pred, v.coef, one_scorer(v)).withColumn("coef", r6("coef"))


@query(
    "d33_feature_importance_equal",
    "pred coef fit_score",
    f"""WITH {ROWC}, {SHARE}, s AS (SELECT huc12, species, var, sum(coef * share_eq) AS coef FROM rc JOIN sh USING (species, estimator, huc12, comid) GROUP BY ALL)
       SELECT huc12, var, {R('avg(coef)', 'coef')} FROM s GROUP BY ALL""",
)
def _(v):
    return im.feature_importance(v.pred, v.coef, one_scorer(v), spec_wt="even").withColumn("coef", r6("coef"))


@query(
    "d33_feature_importance_presence",
    "pred coef fit_score",
    f"""WITH {ROWC}, {SHARE} SELECT y, huc12, var, {R('sum(coef * share)', 'coef')} FROM rc JOIN sh USING (species, estimator, huc12, comid)
       JOIN truth USING (species, huc12, comid) GROUP BY ALL""",
)
def _(v):
    return im.feature_importance(v.pred, v.coef, one_scorer(v), presence=True).withColumn("coef", r6("coef"))


@query(
    "d33_feature_importance_by_repeat",
    "pred coef fit_score",
    f"""WITH {WT}, rw AS (SELECT species, estimator, huc12, comid, rep_idx, avg(wt) AS wt FROM w GROUP BY ALL),
       c AS (SELECT species, estimator, var, rep_idx, avg(value) AS value FROM coef GROUP BY ALL),
       rc AS (SELECT species, estimator, huc12, comid, var, sum(wt * value) / sum(wt) AS coef, avg(wt) AS m FROM rw JOIN c USING (species, estimator, rep_idx) GROUP BY ALL)
       SELECT huc12, var, {R("sum(coef * m) / sum(m)", "coef")} FROM rc GROUP BY ALL""",
)
def _(v):
    return im.feature_importance(v.pred, v.coef, one_scorer(v), collapse="split").withColumn("coef", r6("coef"))


@query(
    "d34_location_weights",
    "pred fit_score",
    f"""WITH {F1}, s AS (SELECT species, estimator, avg(value) AS s FROM f1 GROUP BY ALL),
       e AS (SELECT species, estimator, huc12, comid, avg(abs(y - yhat)) AS e FROM pred GROUP BY ALL),
       w AS (SELECT *, s * (1 - e) AS wt FROM e JOIN s USING (species, estimator))
       SELECT species, estimator, huc12, comid, {R("wt / sum(wt) OVER (PARTITION BY comid)", "by_comid")}, {R("wt / sum(wt) OVER (PARTITION BY huc12)", "by_huc12")} FROM w""",
)
def _(v):
    out = im.location_shares(one_scorer(v), v.pred, ["comid", "huc12"])
    return out.select(*ag.ROW, r6("by_0").alias("by_comid"), r6("by_1").alias("by_huc12"))


@query(
    "d35_rank_by_abs_mean",
    "truth coef",
    f"""WITH rows AS (SELECT huc12, var, value FROM truth JOIN coef USING (species)), u AS (SELECT huc12, var, avg(value) AS c FROM rows GROUP BY ALL),
       m AS (SELECT var, avg(c) AS m FROM u GROUP BY var)
       SELECT var, {R("m", "mean_coef")}, row_number() OVER (ORDER BY abs(round(m, 9)) DESC, var) AS rank FROM m""",
)
def _(v):
    # The mean over folds is taken first: every row has the same folds.
    folds = v.coef.groupBy("species", "var").agg(F.avg("value").alias("coef"))
    rows = v.truth.join(folds, "species").select("huc12", "var", "coef")
    return im.rank_by_abs_mean(rows).withColumn("mean_coef", r6("mean_coef"))


THRESHOLDS = """t AS (SELECT species, (avg(yhat) FILTER (y = 0) + avg(yhat) FILTER (y = 1)) / 2 AS avgavg, avg(yhat) AS wtavgavg,
       (median(yhat) FILTER (y = 0) + median(yhat) FILTER (y = 1)) / 2 AS avgmed FROM pred GROUP BY species),
       th AS (SELECT species, 'avgavg' AS threshold , avgavg AS t FROM t UNION ALL SELECT species, 'wtavgavg', wtavgavg FROM t
       UNION ALL SELECT species, 'avgmed', avgmed FROM t
       UNION ALL SELECT species, c.n, c.t FROM t, (VALUES ('0.45', CAST(0.45 AS DOUBLE)), ('0.5', 0.5), ('0.55', 0.55), ('1', 1), ('0', 0)) c(n, t))"""


@query(
    "d36_threshold_loss",
    "pred",
    f"""WITH {THRESHOLDS} SELECT species, threshold, {R("avg(CASE WHEN CAST(round(yhat, 9) > round(t, 9) AS INTEGER) <> y THEN 1 ELSE 0 END)", "loss")} FROM pred JOIN th USING (species) GROUP BY ALL""",
)
def _(v):
    return ls.threshold_loss(v.pred).withColumn("loss", r6("loss"))


CLIP = "least(greatest(yhat, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"


@query(
    "d37_losses",
    "pred",
    f"""WITH h AS (SELECT species, y, yhat, CAST(yhat > 0.5 AS INTEGER) AS h FROM pred),
       g AS (SELECT species, yhat, sum(y) AS o, count(*) AS n FROM h GROUP BY ALL),
       r AS (SELECT species, o, sum(o) OVER (PARTITION BY species) AS p, sum(o) OVER w AS tp, sum(n) OVER w AS np FROM g WINDOW w AS (PARTITION BY species ORDER BY yhat DESC)),
       a AS (SELECT species, -sum(CAST(o AS DOUBLE) / p * tp / np) AS ap FROM r GROUP BY species)
       SELECT species, {R("avg((y - yhat) * (y - yhat))", "mse")}, {R("avg(abs(y - yhat))", "mae")}, {R(f"avg(-(y * ln({CLIP}) + (1 - y) * ln(1 - {CLIP})))", "logloss")},
       {R("coalesce(-2.0 * sum(h * y) / nullif(2 * sum(h * y) + sum(h * (1 - y)) + sum((1 - h) * y), 0), 0)", "f1")},
       {R("coalesce(-5.0 * sum(h * y) / nullif(5 * sum(h * y) + sum(h * (1 - y)) + 4 * sum((1 - h) * y), 0), 0)", "f2")},
       {R("avg((0.5 - yhat) * (y - h))", "splithinge")}, {R("any_value(ap)", "avg_precision")} FROM h JOIN a USING (species) GROUP BY species""",
)
def _(v):
    out = ls.losses(v.pred)
    return out.select("species", *[r6(c).alias(c) for c in out.columns if c != "species"])


@query(
    "d38_naive_losses",
    "truth",
    f"""WITH m AS (SELECT species, avg(y) AS m FROM truth GROUP BY species)
       SELECT t.species, {R("any_value(m)", "y_mean")}, {R("avg((y - m) * (y - m))", "naive_mse")}, {R("avg(abs(y - CASE WHEN m > 0.5 THEN 1 ELSE 0 END))", "naive_binary")}
       FROM truth t JOIN m USING (species) GROUP BY t.species""",
)
def _(v):
    out = ls.naive_losses(v.truth)
    return out.select("species", *[r6(c).alias(c) for c in ("y_mean", "naive_mse", "naive_binary")])


@query(
    "d39_scorers",
    "pred",
    f"""WITH h AS (SELECT species, estimator, y, CAST(yhat > 0.5 AS INTEGER) AS h FROM pred),
       s AS (SELECT species, estimator, avg(CAST(h = y AS INTEGER)) AS hit, sum(h * y) / CAST(sum(y) AS DOUBLE) AS sens, sum((1 - h) * (1 - y)) / CAST(sum(1 - y) AS DOUBLE) AS spec FROM h GROUP BY ALL)
       SELECT species, estimator, {R("hit", "f1_micro")}, {R("hit", "precision_micro")}, {R("hit", "recall_micro")}, {R("(sens + spec) / 2", "roc_auc_micro")} FROM s""",
)
def _(v):
    out = ls.scorers(v.pred, ["species", "estimator"])
    return out.select("species", "estimator", *[r6(c).alias(c) for c in ("f1_micro", "precision_micro", "recall_micro", "roc_auc_micro")])


@query(
    "d39_scorers_small",
    "labels_pred",
    f"""WITH h AS (SELECT y, yhat, CAST(yhat > 0.5 AS INTEGER) AS h FROM labels_pred),
       s AS (SELECT avg(CAST(h = y AS INTEGER)) AS hit, sum(h * y) / CAST(sum(y) AS DOUBLE) AS sens, sum((1 - h) * (1 - y)) / CAST(sum(1 - y) AS DOUBLE) AS spec FROM h)
       SELECT {R("hit", "f1_micro")}, {R("hit", "precision_micro")}, {R("hit", "recall_micro")}, {R("(sens + spec) / 2", "roc_auc_micro")} FROM s""",
)
def _(v):
    out = ls.scorers(v.labels_pred, [])
    return out.select(*[r6(c).alias(c) for c in ("f1_micro", "precision_micro", "recall_micro", "roc_auc_micro")])


SCORED = "scored AS (SELECT *, coalesce(ln(loss / naiveloss + 1) / pow(ln(batch_n * batch_n * batchcount), 1.5), 1e301) AS s FROM model_runs)"


@query("d40_run_score", "model_runs", f"WITH {SCORED} SELECT run_seq, {R('s', 'run_score')} FROM scored")
def _(v):
    return rn.with_run_score(v.model_runs).select("run_seq", r6("run_score").alias("run_score"))


@query(
    "d41_condense_runs",
    "model_runs",
    f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY species, config_id, batchcount ORDER BY s, run_seq DESC) AS k FROM scored)
       SELECT species, config_id, batchcount, run_seq, loss FROM k WHERE k = 1 AND loss < naiveloss""",
)
def _(v):
    kept = rn.condense_runs(v.model_runs, ["species", "config_id", "batchcount"], "naiveloss")
    return kept.select("species", "config_id", "batchcount", "run_seq", "loss")


@query(
    "d42_merge_listdicts",
    "model_runs score",
    "SELECT species, run_seq AS value, 0 AS source FROM model_runs UNION ALL SELECT species, fold, 1 FROM score",
)
def _(v):
    a = v.model_runs.select("species", C("run_seq").alias("value"))
    b = v.score.select("species", C("fold").alias("value"))
    return ag.merge_listdicts([a, b], "species", "value")


@query(
    "d43_runs_by_species",
    "model_runs",
    """SELECT 'species' AS kind, species AS key, CAST(0 AS BIGINT) AS block, string_agg(CAST(run_seq AS STRING), ',' ORDER BY run_seq) AS members FROM model_runs GROUP BY species
       UNION ALL SELECT 'spec', sha256(concat_ws('|', species, CAST(batchcount AS STRING))), 0, string_agg(CAST(run_seq AS STRING), ',' ORDER BY run_seq) FROM model_runs GROUP BY species, batchcount""",
)
def _(v):
    listed = lambda d, k, key: d.select(F.lit(k).alias("kind"), C(key).alias("key"), "block", text(F.transform("members", lambda m: m.cast("string"))).alias("members"))
    a = rn.runs_by_species(v.model_runs)
    b = rn.runs_by_spec(v.model_runs, content_id("species", "batchcount"))
    return listed(a, "species", "species").unionByName(listed(b, "spec", "spec_id"))


@query("d44_cluster_sizes", "truth", "SELECT huc12 AS cluster, count(*) AS n FROM truth GROUP BY 1")
def _(v):
    return ag.cluster_sizes(v.truth.withColumnRenamed("huc12", "cluster"))


@query(
    "d45_histogram",
    "survey",
    """WITH m AS (SELECT species, CAST(count(*) AS DOUBLE) AS n FROM survey GROUP BY species), r AS (SELECT min(n) AS lo, max(n) AS hi FROM m)
       SELECT 'linear' AS kind, CAST(least(floor((n - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM m, r GROUP BY 2
       UNION ALL SELECT 'log', CAST(least(floor((log10(n) - log10(lo)) / (log10(hi) - log10(lo)) * 9), 8) AS BIGINT), count(*) FROM m, r GROUP BY 2""",
)
def _(v):
    sizes = v.survey.groupBy("species").agg(F.count(F.lit(1)).cast("double").alias("size"))
    return ag.histogram(sizes, "size", 10).withColumn("kind", F.lit("linear")).unionByName(
        ag.histogram(sizes, "size", 10, log=True).withColumn("kind", F.lit("log"))
    )


@query(
    "d45_joint_histogram",
    "score",
    f"""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM score), b AS (SELECT estimator, CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM score, r WHERE value IS NOT NULL GROUP BY 1, 2)
       SELECT estimator, bin, n, {R("n / sum(n) OVER (PARTITION BY estimator)", "share")} FROM b""",
)
def _(v):
    return ag.joint_histogram(v.score, "estimator", "value", 20).withColumn("share", r6("share"))


@query("d46_basic_meta", "truth", f"SELECT species, count(*) AS n, {R('avg(y)', 'y_mean')} FROM truth GROUP BY species")
def _(v):
    return ag.basic_meta(v.truth).withColumn("y_mean", r6("y_mean"))


@query(
    "d48_balanced_weight",
    "truth",
    f"""WITH c AS (SELECT species, y, count(*) AS c FROM truth GROUP BY ALL), s AS (SELECT species, y, sum(c) OVER (PARTITION BY species) / (CAST(c AS DOUBLE) * count(*) OVER (PARTITION BY species)) AS w FROM c)
       SELECT species, comid, y, {R("w", "weight")} FROM truth JOIN s USING (species, y)""",
)
def _(v):
    return ag.balanced_weight(v.truth, "y", ["species"]).select("species", "comid", "y", r6("weight").alias("weight"))


@query(
    "d49_ols",
    "truth features",
    f"""WITH d AS (SELECT species, CAST(y AS DOUBLE) AS y, x FROM truth JOIN features USING (comid) WHERE var = 'ElevCat' AND x IS NOT NULL),
       f AS (SELECT species, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d GROUP BY species),
       e AS (SELECT species, avg((y - a - b * x) * (y - a - b * x)) AS mse FROM d JOIN f USING (species) GROUP BY species)
       SELECT species, '(intercept)' AS var, {R("a", "b")}, {R("a", "b_standard")}, {R("mse", "mse")} FROM f JOIN e USING (species)
       UNION ALL SELECT species, 'ElevCat', {R("b")}, {R("b")}, {R("mse")} FROM f JOIN e USING (species)""",
)
def _(v):
    x = v.features.filter((C("var") == "ElevCat") & C("x").isNotNull()).select("comid", F.array("x").alias("xs"))
    fit = ols(v.truth.join(x, "comid"), ["species"], "xs", "y", ["ElevCat"])
    return fit.select("species", "var", *[r6(c).alias(c) for c in ("b", "b_standard", "mse")])


@query(
    "d49_ols_all_variables",
    "truth features",
    f"""WITH w AS (SELECT comid, count(x) AS have FROM features WHERE var IN ({", ".join(repr(n) for n, _k in VARIABLES)}) GROUP BY comid),
       n AS (SELECT species, count(*) AS n FROM truth JOIN w USING (comid) WHERE have = {len(VARIABLES)} GROUP BY species)
       SELECT species, var, n, CAST(0 AS DOUBLE) AS gap FROM n, (VALUES ('(intercept)'), {", ".join(f"('{n}')" for n, _k in VARIABLES)}) v(var)""",
)
def _(v):
    """The solve with all variables: residuals have no product with any of them (`gap`)."""
    names = [n for n, _k in VARIABLES]
    x = as_vectors(v.features.filter(C("var").isin(*names)), [], names).filter(~F.exists("xs", lambda x: x.isNull()))
    rows = v.truth.join(x, "comid")
    fit = ols(rows, ["species"], "xs", "y", names)
    residual = predict_linear(rows, fit, ["species"], "xs", names, value="b").withColumn("r", C("y") - C("yhat"))
    parts = [F.struct(F.lit("(intercept)").alias("var"), C("r").alias("g"))]
    parts += [F.struct(F.lit(n).alias("var"), (C("r") * C("xs")[i]).alias("g")) for i, n in enumerate(names)]
    sums = residual.select("species", F.inline(F.array(*parts))).groupBy("species", "var").agg(F.count("*").alias("n"), F.sum("g").alias("g"))
    return sums.select("species", "var", "n", F.when(F.abs(C("g")) <= 1e-6 * C("n"), 0.0).otherwise(C("g")).alias("gap"))


@query(
    "d50_by_repeat",
    "coef",
    f"""SELECT species, estimator, var, rep_idx, {R("avg(v)", "mean")}, {R("sum(v)", "total")} FROM
       (SELECT *, CASE WHEN rep_idx = 1 AND estimator = 'svc' THEN NULL ELSE value END AS v FROM coef) GROUP BY ALL""",
)
def _(v):
    long = v.coef.withColumn("value", F.when((C("rep_idx") == 1) & (C("estimator") == "svc"), None).otherwise(C("value")))
    keys = ["species", "estimator", "var"]
    mean = ag.by_repeat(long, keys, "value").withColumnRenamed("value", "mean")
    total = ag.by_repeat(long, keys, "value", "sum").withColumnRenamed("value", "total")
    return mean.join(total, [*keys, "rep_idx"]).select(*keys, "rep_idx", r6("mean").alias("mean"), r6("total").alias("total"))


@query(
    "h16_rescale_coef",
    "coef features truth",
    f"""WITH x AS (SELECT species, var, x, CAST(comid AS BIGINT) AS c FROM truth JOIN features USING (comid)),
       g AS (SELECT species, var, stddev_samp(x) AS g FROM x GROUP BY ALL),
       f AS (SELECT species, var, r.i AS rep_idx, s.i AS split_idx, stddev_samp(x) AS f FROM x, (VALUES (0), (1)) r(i), (VALUES (0), (1), (2)) s(i) WHERE (c + r.i) % 3 <> s.i GROUP BY ALL)
       SELECT species, estimator, var, rep_idx, split_idx, {R("CASE WHEN f < 0.01 OR g < 0.01 THEN 0 ELSE value / f * g END", "rescaled")} FROM coef JOIN f USING (species, var, rep_idx, split_idx) JOIN g USING (species, var)""",
)
def _(v):
    x = species_x(v).select("species", "var", "x", C("comid").cast("bigint").alias("c"))
    whole = x.groupBy("species", "var").agg(F.stddev_samp("x").alias("global_std"))
    folds = x.withColumn("rep_idx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("split_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    train = folds.filter((C("c") + C("rep_idx")) % 3 != C("split_idx"))
    fold = train.groupBy("species", "var", "rep_idx", "split_idx").agg(F.stddev_samp("x").alias("fold_std"))
    return im.rescale_coef(v.coef, fold, whole).drop("value").withColumn("rescaled", r6("rescaled"))


@query(
    "h19_species_coef",
    "coef fit_score",
    f"""WITH {F1}, c AS (SELECT species, estimator, var, rep_idx, avg(value) AS v FROM coef GROUP BY ALL), s AS (SELECT species, estimator, rep_idx, avg(value) AS s FROM f1 GROUP BY ALL),
       n AS (SELECT *, s / sum(s) OVER (PARTITION BY species) AS n FROM s), m AS (SELECT species, estimator, var, sum(v * n) AS coef FROM c JOIN n USING (species, estimator, rep_idx) GROUP BY ALL)
       SELECT species, var, {R("avg(coef)", "coef")} FROM m GROUP BY ALL""",
)
def _(v):
    return im.species_coef(v.coef, one_scorer(v), "split").withColumn("coef", r6("coef"))


@query(
    "h19_species_coef_collapsed",
    "coef fit_score",
    f"""WITH {F1}, c AS (SELECT species, estimator, var, avg(value) AS v FROM coef GROUP BY ALL), s AS (SELECT species, estimator, avg(value) AS s FROM f1 GROUP BY ALL)
       SELECT species, var, {R("sum(v * s) / sum(s)", "coef")} FROM c JOIN s USING (species, estimator) GROUP BY ALL""",
)
def _(v):
    return im.species_coef(v.coef, one_scorer(v), True).withColumn("coef", r6("coef"))


def found_share(v):
    """Flagship: share of species found per HUC8, from raw observations."""
    found = presence_absence(v.survey).join(v.crosswalk, "comid").select("species", "huc12", "comid", C("presence").alias("y"))
    return ag.richness(found, 8).select("huc8", *[r6(c).alias(c) for c in ("found", "not_found", "share_found", "potential")])
