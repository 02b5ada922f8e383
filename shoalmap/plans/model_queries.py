"""Checked queries for feature preparation, models and kernels.

Fits run over all rows of the test tables. Where a fit cannot be written in SQL the query has no
oracle; tests hold it against brute force or known properties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalmap.operators import boosted as bo
from shoalmap.operators import clusters as cl
from shoalmap.operators import features as ft
from shoalmap.operators import folded as fo
from shoalmap.operators import grouped as gr
from shoalmap.operators import importance as im
from shoalmap.operators import kernel as kn
from shoalmap.operators import linear as ln
from shoalmap.operators import models as md
from shoalmap.operators.aggregates import class_weights
from shoalmap.operators.losses import scorers
from shoalmap.operators.sampling import stratified_kfold
from shoalmap.plans.aggregate_queries import one_scorer
from shoalmap.plans.registry import R, query, r6
from shoalmap.plans.views import VARIABLES

C = F.col
NAMES = [n for n, _k in VARIABLES]
KEY = ["species"]


@query("h01_impute_middle", "features", f"SELECT comid, var, {R('coalesce(x, avg(x) OVER (PARTITION BY var))', 'x')} FROM features")
def _(v):
    return ft.impute_middle(v.features, []).withColumn("x", r6("x"))


@query(
    "h01_impute_most_frequent",
    "features",
    """WITH c AS (SELECT var, x, row_number() OVER (PARTITION BY var ORDER BY count(*) DESC, x) AS k FROM features WHERE x IS NOT NULL GROUP BY var, x)
       SELECT comid, f.var, coalesce(f.x, c.x) AS x FROM features f JOIN c ON c.var = f.var AND c.k = 1""",
)
def _(v):
    return ft.impute_middle(v.features, [], "mode")


# Features of the catchments of each HUC2; donors come from the same HUC2.
def region_features(v):
    return v.features.join(v.crosswalk.select("comid", F.substring("huc12", 1, 2).alias("huc2")), "comid").filter(C("var").isin(*NAMES))


def _dist(a: str, b: str) -> str:
    both = [f"{a}.x{i} IS NOT NULL AND {b}.x{i} IS NOT NULL" for i in range(5)]
    shared = " + ".join(f"CASE WHEN {w} THEN 1 ELSE 0 END" for w in both)
    total = " + ".join(f"coalesce(({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i}), 0)" for i in range(5))
    return f"round(sqrt(CAST(5 AS DOUBLE) / nullif({shared}, 0) * ({total})), 9)"


WIDE = "w AS (SELECT substr(huc12, 1, 2) AS huc2, comid, " + ", ".join(
    f"max(CASE WHEN var = '{n}' THEN x END) AS x{i}" for i, n in enumerate(NAMES)
) + " FROM features JOIN crosswalk USING (comid) GROUP BY 1, 2)"
JSON_TEXT = "'{\"xs\":[' || concat_ws(','" + "".join(f", coalesce(CAST(x{i} AS STRING), 'null')" for i in range(5)) + ") || ']}'"


@query(
    "h02_impute_knn",
    "features crosswalk",
    f"""WITH {WIDE}, t AS (SELECT *, {JSON_TEXT} AS tie FROM w),
       g AS ({" UNION ALL ".join(f"SELECT huc2, comid, '{n}' AS var, {i} AS i, x0, x1, x2, x3, x4 FROM t WHERE x{i} IS NULL" for i, n in enumerate(NAMES))}),
       d AS (SELECT g.huc2, g.comid, g.var, CASE g.i WHEN 0 THEN t.x0 WHEN 1 THEN t.x1 WHEN 2 THEN t.x2 WHEN 3 THEN t.x3 ELSE t.x4 END AS x, {_dist("g", "t")} AS dist, t.tie
             FROM g JOIN t ON t.huc2 = g.huc2),
       k AS (SELECT *, row_number() OVER (PARTITION BY huc2, comid, var ORDER BY dist, tie) AS k FROM d WHERE x IS NOT NULL AND dist IS NOT NULL)
       SELECT huc2, comid, var, {R("avg(x)", "x")} FROM k WHERE k <= 10 GROUP BY ALL
       UNION ALL SELECT substr(huc12, 1, 2), comid, var, {R("x")} FROM features JOIN crosswalk USING (comid) WHERE x IS NOT NULL AND var <> 'ConstWs'""",
)
def _(v):
    return ft.impute_knn(region_features(v), ["huc2"], NAMES).withColumn("x", r6("x"))


@query(
    "h03_one_hot",
    "",
    """SELECT c_custkey, c_mktsegment, """
    + ", ".join(
        f"CAST(c_mktsegment = s.l[{i + 1}] AS DOUBLE) AS hot{i}" for i in range(5)
    )
    + " FROM customer, (SELECT list_sort(list(DISTINCT c_mktsegment)) AS l FROM customer) s",
)
def _(v):
    from pyspark.ml.functions import vector_to_array

    hot = ft.one_hot(v.table("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    array = vector_to_array("c_mktsegment_hot")
    return hot.select("c_custkey", "c_mktsegment", *[array[i].alias(f"hot{i}") for i in range(5)])


@query(
    "h04_standardize",
    "features",
    f"""WITH s AS (SELECT var, avg(x) AS m, stddev_samp(x) AS s, stddev_pop(x) AS p FROM features GROUP BY var)
       SELECT comid, var, {R("CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END", "sample")}, {R("CASE WHEN p = 0 THEN 0 ELSE (x - m) / p END", "population")} FROM features JOIN s USING (var) WHERE x IS NOT NULL""",
)
def _(v):
    x = v.features.filter(C("x").isNotNull())
    a = ft.standardize(x, []).select("comid", "var", r6("x").alias("sample"))
    return a.join(ft.standardize(x, [], population=True).select("comid", "var", r6("x").alias("population")), ["comid", "var"])


@query(
    "h04_build_x_train",
    "truth features",
    f"""WITH x AS (SELECT species, huc12, comid, var, x FROM truth JOIN features USING (comid)), s AS (SELECT species, var, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY ALL)
       SELECT species, huc12, comid, var, {R("coalesce((x - m) / nullif(s, 0), CASE WHEN x IS NOT NULL THEN 0 END)", "x")} FROM x JOIN s USING (species, var)""",
    digest=("species var", "x"),
)
def _(v):
    return ft.build_x_train(v.truth, v.features).withColumn("x", r6("x"))


@query("h05_drop_const", "features", "SELECT * FROM features WHERE var IN (SELECT var FROM features GROUP BY var HAVING count(DISTINCT x) > 1)")
def _(v):
    return ft.drop_const(v.features)


# --- models ---------------------------------------------------------------------------------------


def catchments(v):
    """One row per catchment with its features, gaps filled with the mean."""
    return ft.impute_middle(v.features.filter(C("var").isin(*NAMES)), []).groupBy("comid").agg(
        *[F.max(F.when(C("var") == n, C("x"))).alias(n) for n in NAMES]
    )


def sample(v):
    """One row per (species, catchment) of the truth with its features."""
    return v.truth.join(catchments(v), "comid").select("species", "huc12", "comid", "y", *NAMES)


def vectors(v):
    return md.assemble(sample(v), NAMES)


def counted(v):
    """`sample` with the rows of a catchment and y as one row and their number `n`: the pooled models see the
    features only, and these are the same for all species of a catchment."""
    counts = v.truth.groupBy("comid", "y").agg(F.count(F.lit(1)).alias("n"))
    return md.cut(counts.join(catchments(v), "comid"), "counted")


def counted_vectors(v):
    return md.cut(md.assemble(counted(v), NAMES, copies="n"), "vectors")


def coef_table(model, names, spark):
    last = model.stages[-1] if hasattr(model, "stages") else model
    return spark.createDataFrame([(n, float(c)) for n, c in zip(names, last.coefficients)], "var string, value double")


@query("h06_select_sparse")
def _(v):
    kept = ft.select_sparse(counted(v), NAMES, "y", max_k=4, reg=0.0001, copies="n")
    return v.spark.createDataFrame([(n,) for n in kept], "var string")


def lpm_blocks(v):
    """The sample with gaps filled and the folds of every repeat, in blocks: no row is repeated."""
    points = sample(v).select("species", "huc12", "comid", "y", F.array(*NAMES).alias("xs"))
    return fo.fold_blocks(points, KEY, ["comid"], "xs", "y", fo.OUTER_SPLITS, fo.OUTER_REPEATS, 1, more=["huc12"])


@query("h07_fit_lpm")
def _(v):
    return coef_table(md.fit_lpm(vectors(v)), NAMES, v.spark)


@query("h07_lpm_all_species")
def _(v):
    return ln.lpm_of_blocks(lpm_blocks(v), KEY, NAMES)


@query("h08_fit_logistic")
def _(v):
    return coef_table(md.fit_logistic(vectors(v)), NAMES, v.spark)


@query("h09_fit_linear_svc")
def _(v):
    return coef_table(md.fit_linear_svc(vectors(v)), NAMES, v.spark)


@query("h10_fit_rbf_svc")
def _(v):
    model = md.fit_rbf_svc(counted_vectors(v), len(NAMES), copies="n")
    # A catchment is predicted once, for all its species.
    places = md.predict(model, md.as_features(catchments(v), NAMES)).select("comid", "yhat")
    return v.truth.join(md.cut(places, "places"), "comid").select("species", "comid", "y", "yhat")


# Sample sizes per species and fold in SQL; folds differ by one row at most, the first ones are larger.
FOLDS_SQL = f"""n AS (SELECT species, count(*) AS n FROM truth WHERE comid IN (SELECT comid FROM features) GROUP BY ALL),
       folds AS (SELECT species, n, CAST(r AS INTEGER) AS rep_idx, CAST(s AS INTEGER) AS split_idx, (n - s + {fo.OUTER_SPLITS - 1}) // {fo.OUTER_SPLITS} AS n_test
                 FROM n, range({fo.OUTER_REPEATS}) t(r), range({fo.OUTER_SPLITS}) u(s))"""


def raw_vectors(v):
    """(comid, xs) with gaps: what is fitted to fill them must not see test rows."""
    return ft.as_vectors(v.features.filter(C("var").isin(*NAMES)), [], NAMES)


def raw_points(v):
    return v.truth.select("species", "comid", "y").join(raw_vectors(v), "comid")


def folded_sample(v, inner=1, reps=fo.OUTER_REPEATS):
    blocks = fo.fold_blocks(raw_points(v), KEY, ["comid"], "xs", "y", fo.OUTER_SPLITS, reps, 1, inner)
    return blocks, fo.preparations(blocks, KEY, fo.OUTER_SPLITS, reps, inner)


def all_species(v, kind, cost=1.0, reps=fo.OUTER_REPEATS):
    blocks, prepared = folded_sample(v, reps=reps)
    return blocks, gr.fit_models(blocks, fo.fold_models(prepared, KEY, [cost]), KEY, kind)


def pooled_fits(v, kind="logistic"):
    """One group of all species: a group of any size is many blocks."""
    points = raw_points(v).select(F.lit("all").alias("species"), C("species").alias("name"), "comid", "y", "xs")
    blocks = fo.fold_blocks(points, KEY, ["name", "comid"], "xs", "y", fo.OUTER_SPLITS, fo.OUTER_REPEATS, 2)
    prepared = fo.preparations(blocks, KEY, fo.OUTER_SPLITS, fo.OUTER_REPEATS)
    return blocks, gr.fit_models(blocks, fo.fold_models(prepared, KEY, [1.0]), KEY, kind)


def from_id(df, *names):
    """The columns that the blocks keep as JSON text."""
    return df.select("*", *[F.get_json_object("id", f"$.{n}").alias(n) for n in names]).drop("id")


@query(
    "h04_prepared_folds",
    "truth features",
    f"""WITH p AS (SELECT species, comid, var, x, CAST(comid AS BIGINT) % 5 AS f FROM truth JOIN features USING (comid) WHERE var IN ({', '.join(repr(n) for n in NAMES)})),
       t AS (SELECT s.split_idx, p.* FROM p, (SELECT unnest(range(5)) AS split_idx) s WHERE p.f <> s.split_idx),
       m AS (SELECT species, split_idx, var, coalesce(avg(x), 0) AS fill FROM t GROUP BY ALL),
       z AS (SELECT species, split_idx, var, any_value(fill) AS fill, avg(coalesce(x, fill)) AS mean, stddev_pop(coalesce(x, fill)) AS std, count(*) AS n FROM t JOIN m USING (species, split_idx, var) GROUP BY ALL)
       SELECT species, CAST(split_idx AS INTEGER) AS split_idx, var, n, {R("fill", "fill")}, {R("mean", "mean")}, round(CASE WHEN std < 1e-7 * greatest(1, abs(mean)) THEN 1 ELSE std END, 4) AS std FROM z""",
)
def _(v):
    """Preparation of each training set, for folds that SQL can make as well."""
    points = raw_points(v).withColumn("folds", F.array((C("comid").cast("bigint") % 5).cast("int")))
    prepared = fo.preparations(fo.fold_blocks(points, KEY, ["comid"], "xs", "y", 5, 1, 1, folds="folds"), KEY, 5, 1)
    var = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in NAMES]).alias("var"), "fill", "mean", "std")).alias("v")
    rows = prepared.select("species", "split_idx", C("n").cast("long").alias("n"), var)
    return rows.select("species", "split_idx", "v.var", "n", r6("v.fill").alias("fill"), r6("v.mean").alias("mean"), F.round("v.std", 4).alias("std"))


def optimal_fits(v, kind):
    _blocks, fitted = all_species(v, kind)
    return fitted.select("species", "rep_idx", "split_idx", C("n").cast("long").alias("n_train"), (C("residual") <= 1e-8).alias("optimal"))


OPTIMAL_SQL = f"WITH {FOLDS_SQL} SELECT species, rep_idx, split_idx, n - n_test AS n_train, true AS optimal FROM folds"


@query("h08_logistic_all_species", "truth features", OPTIMAL_SQL)
def _(v):
    """L1 logistic regression of every species and fold; optimal by the subgradient over the training rows."""
    return optimal_fits(v, "logistic")


@query("h09_linear_svc_all_species", "truth features", OPTIMAL_SQL)
def _(v):
    return optimal_fits(v, "svc")


@query("h10_rbf_svc_all_species", "truth features", OPTIMAL_SQL)
def _(v):
    """RBF machine of every species and fold on landmarks of its own training rows."""
    blocks, prepared = folded_sample(v)
    models = gr.landmark_models(blocks, prepared, KEY, [1.0], [gr.RBF_GAMMAS[1]])
    fitted = gr.fit_models(blocks, models, KEY, "svc")
    return fitted.select("species", "rep_idx", "split_idx", C("n").cast("long").alias("n_train"), (C("residual") <= 1e-8).alias("optimal"))


def boosted(v, reps):
    blocks, prepared = folded_sample(v, reps=reps)
    edges = bo.bin_edges(blocks, prepared, KEY)
    return blocks, bo.fit_boosted(blocks, edges, KEY)


@query(
    "h11_boosted_all_species",
    "truth features",
    f"""WITH {FOLDS_SQL} SELECT species, rep_idx, split_idx, n - n_test AS n_train, {bo.TREES} AS trees, true AS fell FROM folds WHERE rep_idx = 0""",
)
def _(v):
    """Boosted trees of every species and fold of one repeat, with all trees, and whether the training loss fell."""
    _blocks, fitted = boosted(v, 1)
    losses = C("losses")
    return fitted.select("species", "rep_idx", "split_idx", C("n").cast("long").alias("n_train"), (F.size(losses) - 1).alias("trees"), (F.element_at(losses, -1) < losses[0]).alias("fell"))


@query("h11_fit_gbt")
def _(v):
    """Out-of-fold classes of the boosted trees of every species."""
    blocks, fitted = boosted(v, 1)
    return from_id(bo.predict_boosted(blocks, fitted, KEY), "comid")


@query("h08_coefficients")
def _(v):
    """Weights per raw unit and standardised, of every species and fold."""
    _blocks, fitted = all_species(v, "logistic")
    return gr.coefficient_rows(fitted, KEY, NAMES, "logistic")


@query(
    "h12_cross_validate",
    "truth features",
    f"""WITH {FOLDS_SQL} SELECT species, estimator, rep_idx, split_idx, n_test, true AS scored
       FROM folds, (VALUES ('logistic-reg'), ('linear-svc')) e(estimator) WHERE n_test > 0""",
)
def _(v):
    """Scores of both linear classifiers on each test fold of every species."""
    blocks, prepared = folded_sample(v)
    models = fo.fold_models(prepared, KEY, [1.0])
    out = None
    for kind, name in gr.ESTIMATORS.items():
        fitted = gr.fit_models(blocks, models, KEY, kind)
        part = gr.model_scores(blocks, fitted, KEY, kind).join(fitted.select("species", "model", "rep_idx", "split_idx"), ["species", "model"])
        part = part.select("species", F.lit(name).alias("estimator"), "rep_idx", "split_idx", "n_test", C("f1_micro").between(0, 1).alias("scored"))
        out = part if out is None else out.unionByName(part)
    return out


@query("h12_scores")
def _(v):
    """The scores of all species' models, by scorer, from the hard out-of-fold predictions."""
    blocks, fitted = all_species(v, "logistic")
    oof = gr.predictions(gr.predict_models(blocks, fitted, KEY, "logistic"), fitted, KEY, "logistic")
    return scorers(oof, ["species", "estimator", "rep_idx", "split_idx"])


@query(
    "h13_inner_search",
    "truth features",
    f"""WITH {FOLDS_SQL} SELECT species, rep_idx, split_idx, {len(gr.GRIDS['svc'])} AS points, true AS in_grid FROM folds""",
)
def _(v):
    """Inner search of the linear SVM: all points over five inner folds of every outer training set."""
    blocks, prepared = folded_sample(v, gr.INNER_SPLITS)
    points, chosen = gr.inner_search(blocks, prepared, KEY, "svc")
    counted = points.groupBy("species", "rep_idx", "split_idx").agg(F.count("*").cast("int").alias("points"))
    inside = F.array_contains(F.array(*[F.lit(float(c)) for c in gr.GRIDS["svc"]]), C("C"))
    return counted.join(chosen.select("species", "rep_idx", "split_idx", inside.alias("in_grid")), ["species", "rep_idx", "split_idx"])


@query("h13_grid_search")
def _(v):
    wide = md.cut(catchments(v).dropna(), "catchments")
    # Folds are dealt to rows that carry their names only; then the rows of a catchment, y and fold are counted.
    rows = v.truth.join(wide.select("comid"), "comid").select("species", "comid", "y")
    folded = stratified_kfold(rows, [], "y", ["species", "comid"], 3, 1, 0)
    counts = folded.groupBy("comid", "y", C("split_idx").alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    data = md.cut(md.assemble(md.cut(counts.join(wide, "comid"), "counted"), NAMES, copies="n"), "vectors")
    search = md.fit_searched(data, "logistic-reg", ["species", "comid"], 3, 0, copies="n")
    grid = [(float(m.get(search.getEstimator().regParam)), float(a)) for m, a in zip(search.getEstimatorParamMaps(), search.avgMetrics)]
    return v.spark.createDataFrame(grid, "reg double, roc_auc double")


@query("h14_predict_oof")
def _(v):
    blocks = lpm_blocks(v)
    oof = ln.lpm_oof_of_blocks(blocks, ln.lpm_of_blocks(blocks, KEY, NAMES), KEY, NAMES)
    return from_id(oof, "huc12", "comid")


@query("h14_predict_oof_pooled")
def _(v):
    blocks, fitted = pooled_fits(v)
    oof = gr.predictions(gr.predict_models(blocks, fitted, KEY, "logistic"), fitted, KEY, "logistic").drop("species", "margin")
    return from_id(oof.withColumn("y", C("y").cast("int")), "name", "comid").withColumnRenamed("name", "species")


@query(
    "h14_predict_oof_svc",
    "truth features",
    f"""WITH {FOLDS_SQL}, y AS (SELECT species, sum(y) AS ones FROM truth WHERE comid IN (SELECT comid FROM features) GROUP BY ALL)
       SELECT species, rep_idx, sum(n_test) AS n, any_value(ones) AS ones, true AS hard FROM folds JOIN y USING (species) GROUP BY species, rep_idx""",
)
def _(v):
    """Hard out-of-fold classes: each row once per repeat, by the model that did not see it."""
    blocks, fitted = all_species(v, "svc")
    oof = gr.predictions(gr.predict_models(blocks, fitted, KEY, "svc"), fitted, KEY, "svc")
    hard = F.bool_and(C("yhat").isin(0, 1)).alias("hard")
    return oof.groupBy("species", "rep_idx").agg(F.count("*").cast("decimal(38,0)").alias("n"), F.sum("y").cast("long").cast("decimal(38,0)").alias("ones"), hard)


def universe(v):
    from shoalmap.operators.joins import predict_universe

    places, _missing = predict_universe(v.survey, v.species_range, v.crosswalk)
    wide = ft.impute_middle(v.features.filter(C("var").isin(*NAMES)), []).groupBy("comid").agg(
        *[F.max(F.when(C("var") == n, C("x"))).alias(n) for n in NAMES]
    )
    return places.join(wide, "comid")


@query("h15_predict_universe")
def _(v):
    coef = ln.lpm_of_blocks(lpm_blocks(v), KEY, NAMES)
    points = universe(v).select("species", "huc12", "comid", F.array(*NAMES).alias("xs"))
    return ln.lpm_predict_universe(points, coef, ["species"], "xs", NAMES).drop("xs")


def raw_universe(v):
    """Catchments outside the sample, per species, with gaps."""
    from shoalmap.operators.joins import predict_universe

    places, _missing = predict_universe(v.survey, v.species_range, v.crosswalk)
    return places.join(raw_vectors(v), "comid")


@query("h15_predict_universe_pooled")
def _(v):
    _blocks, fitted = pooled_fits(v)
    rows = raw_universe(v).select(F.lit("all").alias("species"), F.to_json(F.struct(C("species").alias("name"), "huc12", "comid")).alias("_id"), C("xs").alias("_x"))
    out = gr.predict_models(fo.pack_blocks(rows, KEY), fitted, KEY, "logistic", tested=False)
    out = gr.predictions(out, fitted, KEY, "logistic").drop("species", "margin")
    return from_id(out, "name", "huc12", "comid").withColumnRenamed("name", "species")


@query("h15_predict_universe_all_species")
def _(v):
    """All fold models of a species over its universe, in one scan."""
    _blocks, fitted = all_species(v, "logistic")
    rows = raw_universe(v).select("species", F.to_json(F.struct("huc12", "comid")).alias("_id"), C("xs").alias("_x"))
    out = gr.predict_models(fo.pack_blocks(rows, KEY), fitted, KEY, "logistic", tested=False)
    return from_id(gr.predictions(out, fitted, KEY, "logistic"), "huc12", "comid")


@query("h17_coef_score_rows")
def _(v):
    """Coefficient rows and score rows of every species and fold, scores marked by their prefix."""
    blocks, fitted = all_species(v, "logistic")
    coefs = gr.coefficient_rows(fitted, KEY, NAMES, "logistic").drop("standard")
    oof = gr.predictions(gr.predict_models(blocks, fitted, KEY, "logistic"), fitted, KEY, "logistic")
    return coefs.unionByName(md.score_rows(scorers(oof, ["species", "estimator", "rep_idx", "split_idx"])))


def clustered(v, method, **settings):
    wide = cl.coef_vectors(im.species_coef(v.coef, one_scorer(v)), NAMES)
    return cl.cluster_species(wide, method, **settings)


@query("h18_cluster_kmeans")
def _(v):
    return clustered(v, "kmeans", k=3)


@query("h18_cluster_agglomerative")
def _(v):
    return clustered(v, "agglomerative", k=3)


@query("h18_cluster_dbscan")
def _(v):
    return clustered(v, "dbscan")


@query("h20_novelty_score")
def _(v):
    data = counted_vectors(v)
    # A catchment is scored once, for all its species.
    places = md.as_features(catchments(v), NAMES)
    scored = md.cut(md.novelty_score(data.filter(C("y") == 1), places, len(NAMES), nu=0.05, copies="n").select("comid", "inside"), "scored")
    signed = F.sum(F.when(C("y") == 1, 1).otherwise(-1) * C("inside")).alias("signed")
    sums = v.truth.join(scored, "comid").groupBy("species", "y").agg(signed).join(class_weights(data, copies="n"), "y")
    per = sums.groupBy("species").agg(F.sum(C("weight") * C("signed")).alias("score"))
    return per.withColumn("score", r6("score"))


@query("h24_permutation_importance")
def _(v):
    data = md.cut(vectors(v))
    return md.permutation_importance(md.fit_logistic(data), data, NAMES, ["species", "comid"], reps=1, seed=4)


# --- kernels: batches of 50 catchments by id ------------------------------------------------------

KERNEL_NAMES = ["PctUrbCat", "PctAgWs", "ElevCat", "RdDensCat"]
POINTS = """p AS (SELECT CAST(comid AS BIGINT) AS c, CAST(floor(CAST(comid AS BIGINT) / 50) AS BIGINT) AS batch, comid AS id, max(CASE WHEN var = 'PctUrbCat' THEN x END) AS x0,
       max(CASE WHEN var = 'PctAgWs' THEN x END) AS x1, max(CASE WHEN var = 'ElevCat' THEN x END) AS x2, max(CASE WHEN var = 'RdDensCat' THEN x END) AS x3, max(CASE WHEN var = 'BFIWs' THEN x END) AS y
       FROM features GROUP BY comid HAVING x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND y IS NOT NULL)"""
K4 = "exp(-0.5 * ((a.x0 - b.x0) * (a.x0 - b.x0) / 4 + (a.x1 - b.x1) * (a.x1 - b.x1) / 9 + (a.x2 - b.x2) * (a.x2 - b.x2) / 6.25 + (a.x3 - b.x3) * (a.x3 - b.x3) / 2.25))"
BW = [2.0, 3.0, 2.5, 1.5]


def points(v):
    wide = kn.as_points(v.features, [*KERNEL_NAMES, "BFIWs"])
    c = C("comid").cast("bigint")
    return wide.select(
        C("comid").alias("id"), F.floor(c / 50).alias("batch"), F.slice("xs", 1, 4).alias("xs"), C("xs")[4].alias("y"), (c % 50 / 10).cast("int").alias("part")
    )


@query(
    "c20_pair_distance",
    "features",
    f"""WITH {POINTS}, d AS (SELECT a.batch, a.id, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) + (a.x3 - b.x3) * (a.x3 - b.x3)) AS l2, abs(a.x2 - b.x2) AS g FROM p a JOIN p b ON a.batch = b.batch AND a.id <> b.id)
       SELECT batch, id, CAST(count(*) AS INTEGER) AS partners, {R("min(l2)", "nearest")}, {R("avg(l2)", "mean_l2")}, {R("max(g)", "widest_gap")} FROM d GROUP BY ALL""",
)
def _(v):
    pairs = kn.pair_distance(points(v), ["batch"]).filter(F.size("partners") > 0)
    l2 = F.transform("partners", lambda p: p["l2"])
    gaps = F.transform("partners", lambda p: p["gaps"][2])
    n = F.size("partners")
    total = F.aggregate(l2, F.lit(0.0), lambda s, d: s + d)
    return pairs.select(
        "batch", "id", n.alias("partners"), r6(F.array_min(l2)).alias("nearest"), r6(total / n).alias("mean_l2"), r6(F.array_max(gaps)).alias("widest_gap")
    )


@query(
    "d47_kde",
    "features",
    f"""WITH {POINTS}, n AS (SELECT batch, count(*) AS n FROM p GROUP BY batch),
       s AS (SELECT a.id, sum(exp(-(a.x0 - b.x0) * (a.x0 - b.x0) / 8)) * sum(exp(-(a.x1 - b.x1) * (a.x1 - b.x1) / 18)) * sum(exp(-(a.x2 - b.x2) * (a.x2 - b.x2) / 12.5)) * sum(exp(-(a.x3 - b.x3) * (a.x3 - b.x3) / 4.5)) AS s FROM p a JOIN p b USING (batch) GROUP BY a.id)
       SELECT a.id, {R("sum(k) / any_value(n)", "plain")}, {R("1e4 * sum(k) / any_value(n) / pow(any_value(n), 4)", "own_n")}, {R("1e4 * sum(k / s) / any_value(n)", "self")}
       FROM (SELECT a.id, a.batch, b.id AS bid, {K4} AS k FROM p a JOIN p b USING (batch)) a JOIN s ON s.id = a.bid JOIN n ON n.batch = a.batch GROUP BY a.id""",
)
def _(v):
    p = points(v)
    plain = kn.kde(p, ["batch"], BW).select("id", r6("density").alias("plain"))
    own = kn.kde(p, ["batch"], BW, "own_n").select("id", r6(C("density") * 1e4).alias("own_n"))
    self_ = kn.kde(p, ["batch"], BW, "self").select("id", r6(C("density") * 1e4).alias("self"))
    return plain.join(own, "id").join(self_, "id")


@query(
    "h21_nw_predict",
    "features",
    f"""WITH {POINTS}, k AS (SELECT a.id, {K4} AS k, b.y FROM p a JOIN p b ON a.batch = b.batch AND b.c % 50 < 25 WHERE a.c % 50 >= 25)
       SELECT id, {R("sum(k * y) / sum(k)", "yhat")}, {R("sum(k * y)", "raw")} FROM k GROUP BY id""",
)
def _(v):
    p = points(v).withColumn("c", C("id").cast("bigint"))
    train, ask = p.filter(C("c") % 50 < 25), p.filter(C("c") % 50 >= 25)
    across = kn.nw_predict(train, ask, ["batch"], BW).select("id", r6("yhat").alias("yhat"))
    raw = kn.nw_predict(train, ask, ["batch"], BW, norm="none").select("id", r6("yhat").alias("raw"))
    return across.filter(C("yhat").isNotNull()).join(raw, "id")


@query(
    "h22_nested_bandwidth",
    "features",
    f"""WITH {POINTS}, d AS (SELECT a.batch, a.id, b.id AS bid, (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) + (a.x3 - b.x3) * (a.x3 - b.x3) AS q FROM p a JOIN p b USING (batch)),
       p2 AS (SELECT id, pow(avg(exp(-q / 32)), 0.5) AS b FROM d GROUP BY id), p1 AS (SELECT d.id, pow(avg(exp(-q / 18) * p2.b), 2) AS b FROM d JOIN p2 ON p2.id = d.bid GROUP BY d.id),
       r2 AS (SELECT id, pow(sum(exp(-q / 32)), 0.5) AS b FROM d GROUP BY id), r1 AS (SELECT d.id, pow(sum(exp(-q / (2 * r2.b * r2.b))), 1) AS b FROM d JOIN r2 ON r2.id = d.bid GROUP BY d.id)
       SELECT id, {R("p1.b", "product")}, {R("r1.b", "recursive")} FROM p1 JOIN r1 USING (id)""",
)
def _(v):
    p = points(v)
    a = kn.nested_bandwidth(p, ["batch"], [3.0, 4.0], [2.0, 0.5]).select("id", r6("bandwidth").alias("product"))
    b = kn.nested_bandwidth(p, ["batch"], [4.0], [1.0, 0.5], kind="recursive", norm="none").select("id", r6("bandwidth").alias("recursive"))
    return a.join(b, "id")


@query(
    "h23_nw_crossval",
    "features",
    f"""WITH {POINTS}, k AS (SELECT a.id, {K4} AS k, b.y FROM p a JOIN p b ON a.batch = b.batch AND floor((a.c % 50) / 10) <> floor((b.c % 50) / 10))
       SELECT id, {R("sum(k * y) / sum(k)", "yhat")} FROM k GROUP BY id HAVING sum(k) > 1e-6""",
)
def _(v):
    p = points(v)
    out = kn.nw_crossval(p, ["batch"], "part", BW)
    # The own batch is subtracted, so weights near zero are not compared.
    return out.select("id", r6("yhat").alias("yhat")).filter(C("yhat").isNotNull())
