"""Checked queries for ranking, blocks, sampling and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalmap.operators import aggregates as ag
from shoalmap.operators import losses as ls
from shoalmap.operators import ranking as rk
from shoalmap.operators import runs as rn
from shoalmap.operators import sampling as sm
from shoalmap.plans.aggregate_queries import BEST
from shoalmap.plans.registry import R, query, r6

C = F.col

# Coefficients per HUC12: the mean over the species found there and their folds.
HUC_COEF = """hc AS (SELECT huc12, var, avg(value) AS coef FROM truth JOIN coef USING (species) WHERE y = 1 GROUP BY ALL)"""


def huc_coef(v):
    folds = v.coef.groupBy("species", "var").agg(F.avg("value").alias("value"))
    return v.truth.filter(C("y") == 1).join(folds, "species").groupBy("huc12", "var").agg(F.avg("value").alias("coef"))


MEANS = "m AS (SELECT var, round(avg(coef), 9) AS mean FROM hc GROUP BY var)"


@query(
    "e01_top_features",
    "truth coef",
    f"""WITH {HUC_COEF}, {MEANS} SELECT var, {R("mean", "mean")}, side FROM (SELECT *, 'low' AS side FROM (SELECT * FROM m ORDER BY mean, var LIMIT 2)
       UNION ALL SELECT *, 'high' FROM (SELECT * FROM m ORDER BY mean DESC, var DESC LIMIT 2))""",
)
def _(v):
    return rk.top_features(huc_coef(v), 2).withColumn("mean", r6("mean"))


EXTREME = """lo AS (SELECT huc12, var FROM (SELECT *, row_number() OVER (PARTITION BY huc12 ORDER BY round(coef, 9), var) AS k FROM {src}) WHERE k = 1),
       hi AS (SELECT huc12, var FROM (SELECT *, row_number() OVER (PARTITION BY huc12 ORDER BY round(coef, 9) DESC, var) AS k FROM {src}) WHERE k = 1)"""


@query(
    "e02_vote_features",
    "truth coef",
    f"""WITH {HUC_COEF}, {EXTREME.format(src='hc')} SELECT * FROM (SELECT 'low' AS side, var, count(*) AS votes FROM lo GROUP BY var ORDER BY votes DESC, var LIMIT 2)
       UNION ALL SELECT * FROM (SELECT 'high', var, count(*) AS votes FROM hi GROUP BY var ORDER BY votes DESC, var LIMIT 2)""",
)
def _(v):
    return rk.vote_features(huc_coef(v), 2)


@query(
    "e03_best_feature_per_huc",
    "truth coef",
    f"""WITH {HUC_COEF}, {MEANS}, tl AS (SELECT var FROM m ORDER BY mean, var LIMIT 2), th AS (SELECT var FROM m ORDER BY mean DESC, var DESC LIMIT 2),
       lo AS (SELECT huc12, var FROM (SELECT *, row_number() OVER (PARTITION BY huc12 ORDER BY round(coef, 9), var) AS k FROM hc WHERE var IN (SELECT var FROM tl)) WHERE k = 1),
       hi AS (SELECT huc12, var FROM (SELECT *, row_number() OVER (PARTITION BY huc12 ORDER BY round(coef, 9) DESC, var) AS k FROM hc WHERE var IN (SELECT var FROM th)) WHERE k = 1)
       SELECT huc12, var, 'low' AS side FROM lo UNION ALL SELECT huc12, var, 'high' FROM hi""",
)
def _(v):
    return rk.best_feature_per_huc(huc_coef(v), rk.top_features(huc_coef(v), 2))


@query(
    "e04_feature_rank",
    "truth coef",
    f"""WITH {HUC_COEF}, m AS (SELECT substr(huc12, 1, 4) AS huc4, var, round(avg(coef), 9) AS mean FROM hc GROUP BY ALL)
       SELECT huc4, var, {R("mean", "mean")}, CAST(row_number() OVER (PARTITION BY huc4 ORDER BY mean, var) AS INTEGER) AS rank FROM m""",
)
def _(v):
    return rk.feature_rank(huc_coef(v), 4).withColumn("mean", r6("mean"))


@query(
    "e05_rank_scores",
    "pred",
    """WITH g AS (SELECT species, estimator, yhat, CAST(sum(y) AS BIGINT) AS ones, CAST(sum(1 - y) AS BIGINT) AS zeros FROM pred GROUP BY ALL),
       r AS (SELECT *, CAST(sum(ones) OVER w - ones AS BIGINT) AS ones_below, CAST(sum(zeros) OVER w - zeros AS BIGINT) AS zeros_below FROM g WINDOW w AS (PARTITION BY species, estimator ORDER BY yhat))
       SELECT *, ones_below + zeros_below + (ones + zeros + 1) / CAST(2 AS DOUBLE) AS avg_rank FROM r""",
)
def _(v):
    return ls.rank_scores(v.pred, ["species", "estimator"])


@query(
    "e05_roc_auc",
    "pred",
    f"""WITH r AS (SELECT species, estimator, y, rank() OVER w + (count(*) OVER (PARTITION BY species, estimator, yhat) - 1) / 2.0 AS r FROM pred WINDOW w AS (PARTITION BY species, estimator ORDER BY yhat)),
       s AS (SELECT species, estimator, sum(CASE WHEN y = 1 THEN r END) AS rs, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM r GROUP BY ALL)
       SELECT species, estimator, {R("(rs - p * (p + 1) / 2) / nullif(p * n, 0)", "roc_auc")} FROM s""",
)
def _(v):
    keys = ["species", "estimator"]
    return ls.roc_auc(ls.rank_scores(v.pred, keys), keys).withColumn("roc_auc", r6("roc_auc"))


@query(
    "e06_order_species",
    "score",
    f"""WITH {BEST} SELECT scorer_id, species, estimator, {R("score", "score")}, row_number() OVER (PARTITION BY scorer_id ORDER BY round(score, 9), species) AS place FROM best""",
)
def _(v):
    return rk.order_species(ag.best_estimator(v.score)).withColumn("score", r6("score"))


@query(
    "e07_best_runs",
    "model_runs",
    """WITH k AS (SELECT species, run_seq, loss, row_number() OVER (PARTITION BY species ORDER BY loss, run_seq) AS place, count(*) OVER (PARTITION BY species) AS n FROM model_runs WHERE loss < naiveloss)
       SELECT 'share' AS kind, species, run_seq, loss, place FROM k WHERE place <= greatest(1, floor(n * 0.3))
       UNION ALL SELECT 'count', species, run_seq, loss, place FROM k WHERE place <= 2""",
)
def _(v):
    cols = ["species", "run_seq", "loss", "place"]
    share = rn.best_runs(v.model_runs, 0.3, "naiveloss").select(F.lit("share").alias("kind"), *cols)
    return share.unionByName(rn.best_runs(v.model_runs, 2, "naiveloss").select(F.lit("count").alias("kind"), *cols))


@query(
    "e08_best_iteration",
    "model_runs",
    """WITH t AS (SELECT species, run_seq, loss, min(loss) OVER (PARTITION BY species ORDER BY run_seq) AS best_loss FROM model_runs)
       SELECT species, run_seq, loss, best_loss, max(CASE WHEN loss = best_loss AND first THEN run_seq END) OVER (PARTITION BY species ORDER BY run_seq) AS best_step
       FROM (SELECT *, row_number() OVER (PARTITION BY species, best_loss ORDER BY run_seq) = 1 AS first FROM t)""",
)
def _(v):
    return rn.best_iteration(v.model_runs.select("species", "run_seq", "loss"), ["species"], "run_seq", "loss")


@query(
    "e09_id_blocks",
    "truth",
    """WITH r AS (SELECT species, CAST(comid AS BIGINT) AS c, CAST(floor((row_number() OVER (PARTITION BY species ORDER BY CAST(comid AS BIGINT)) - 1) / 100) AS BIGINT) AS block FROM truth)
       SELECT species, block, count(*) AS n, sha256(string_agg(CAST(c AS STRING), ',' ORDER BY c)) AS block_id FROM r GROUP BY ALL""",
)
def _(v):
    return rk.block_ids(rk.id_blocks(v.truth, 100))


@query(
    "e10_key_chunks",
    "survey",
    """WITH k AS (SELECT DISTINCT comid FROM survey), r AS (SELECT comid, row_number() OVER (ORDER BY comid) AS i, count(*) OVER () AS n, ntile(7) OVER (ORDER BY comid) - 1 AS t FROM k)
       SELECT comid, CAST(t AS BIGINT) AS near_equal, CAST(floor((i - 1) / ceil(n / CAST(7 AS DOUBLE))) AS BIGINT) AS ceil_sized FROM r""",
)
def _(v):
    return rk.key_chunks(v.survey, "comid", 7)


@query(
    "e11_save_gap",
    "model_runs",
    f"""SELECT species, run_seq, {R("(epoch_us(when_saved) - epoch_us(lag(when_saved) OVER (PARTITION BY species ORDER BY when_saved, run_seq))) / CAST(1000000 AS DOUBLE)", "gap_seconds")} FROM model_runs""",
)
def _(v):
    gaps = rn.save_gap(v.model_runs.select("species", "run_seq", "when_saved"), ["species"])
    return gaps.select("species", "run_seq", r6("gap_seconds").alias("gap_seconds"))


@query("e12_sort_results", "fit_score", "SELECT * FROM fit_score ORDER BY species, estimator, scorer, rep_idx, split_idx")
def _(v):
    return rk.sort_results(v.fit_score, ["species", "estimator", "scorer", "rep_idx", "split_idx"])


@query("e13_largest_species", "truth", "SELECT species, count(*) AS n FROM truth GROUP BY species ORDER BY n DESC, species LIMIT 20")
def _(v):
    return rk.largest_species(v.truth.groupBy("species").agg(F.count(F.lit(1)).alias("n")), 20)


# --- sampling: the draws differ from any SQL hash, so what is compared is what must hold for all ---


@query(
    "g01_repeated_kfold",
    "truth",
    """WITH n AS (SELECT species, count(*) AS n FROM truth GROUP BY species)
       SELECT species, r.i AS rep_idx, s.i AS split_idx, CAST(floor((n - s.i + 4) / 5) AS BIGINT) AS rows FROM n, (VALUES (0), (1)) r(i), (VALUES (0), (1), (2), (3), (4)) s(i) WHERE n > s.i""",
)
def _(v):
    folded = sm.repeated_kfold(v.truth, ["species"], ["comid"], k=5, reps=2, seed=7)
    return folded.groupBy("species", "rep_idx", "split_idx").agg(F.count(F.lit(1)).alias("rows"))


@query("g01_repeated_kfold_rows")
def _(v):
    return sm.repeated_kfold(v.truth, ["species"], ["comid"], k=5, reps=2, seed=7)


@query(
    "g02_fold_plan",
    "truth",
    """WITH o AS (SELECT species, CAST(sum(y) AS BIGINT) AS ones FROM truth GROUP BY species), k AS (SELECT *, greatest(CAST(floor(ones / 4) AS BIGINT), 2) AS few FROM o)
       SELECT species, ones, CASE WHEN ones < 20 THEN few ELSE 20 END AS n_splits, CASE WHEN ones < 20 THEN CAST(ceil(40 / CAST(few AS DOUBLE)) AS BIGINT) ELSE 2 END AS n_repeats FROM k""",
)
def _(v):
    return sm.fold_plan(v.truth, ["species"], k=20, reps=2)


@query(
    "g02_planned_kfold",
    "truth",
    """WITH o AS (SELECT species, count(*) AS n, sum(y) AS ones FROM truth GROUP BY species), k AS (SELECT *, greatest(CAST(floor(ones / 4) AS BIGINT), 2) AS few FROM o)
       SELECT species, CASE WHEN ones < 20 THEN least(few, n) ELSE least(20, n) END AS splits, n * CASE WHEN ones < 20 THEN CAST(ceil(40 / CAST(few AS DOUBLE)) AS BIGINT) ELSE 2 END AS rows FROM k""",
)
def _(v):
    plan = sm.fold_plan(v.truth, ["species"], k=20, reps=2)
    folded = sm.planned_kfold(v.truth, plan, ["species"], ["comid"], seed=3)
    return folded.groupBy("species").agg((F.max("split_idx") + 1).alias("splits"), F.count(F.lit(1)).alias("rows"))


@query(
    "g03_quantile_folds",
    "",
    """WITH g AS (SELECT CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10 / CAST(count(*) OVER () AS DOUBLE)) AS INTEGER) AS y_group FROM orders), n AS (SELECT y_group, count(*) AS n FROM g GROUP BY 1)
       SELECT y_group, r.i AS rep_idx, s.i AS split_idx, CAST(floor((n - s.i + 2) / 3) AS BIGINT) AS rows FROM n, (VALUES (0), (1)) r(i), (VALUES (0), (1), (2)) s(i) WHERE n > s.i""",
)
def _(v):
    folded = sm.quantile_folds(v.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], groups=10, k=3, reps=2, seed=5)
    return folded.groupBy("y_group", "rep_idx", "split_idx").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "g04_stratified_kfold",
    "truth",
    """WITH n AS (SELECT species, y, count(*) AS n FROM truth GROUP BY ALL)
       SELECT species, y, r.i AS rep_idx, s.i AS split_idx, CAST(floor((n - s.i + 2) / 3) AS BIGINT) AS rows FROM n, (VALUES (0), (1)) r(i), (VALUES (0), (1), (2)) s(i) WHERE n > s.i""",
)
def _(v):
    folded = sm.stratified_kfold(v.truth, ["species"], "y", ["comid"], k=3, reps=2, seed=11)
    return folded.groupBy("species", "y", "rep_idx", "split_idx").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "g05_balanced_batches",
    "truth",
    """WITH n AS (SELECT species, CAST(sum(y) AS BIGINT) AS o, CAST(sum(1 - y) AS BIGINT) AS z FROM truth GROUP BY species), p AS (SELECT species, CASE WHEN o < z THEN 1 ELSE 0 END AS rare,
       CAST(least(floor(least(o, z) / 2), floor(greatest(o, z) / 6), 4) AS BIGINT) AS b FROM n)
       SELECT species, d.i AS draw, t.i AS batch, c.y, CASE WHEN c.y = rare THEN CAST(2 AS BIGINT) ELSE 6 END AS rows FROM p, (VALUES (0), (1)) d(i), (SELECT range AS i FROM range(4)) t, (VALUES (0), (1)) c(y) WHERE t.i < b""",
)
def _(v):
    batches = sm.balanced_batches(v.truth, ["species"], ["comid"], batch_n=8, batches=4, min_y=0.25, draws=2, seed=13)
    return batches.groupBy("species", "draw", "batch", "y").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "g06_sample_by_huc",
    "crosswalk",
    """WITH u AS (SELECT substr(huc12, 1, 2) AS huc2, substr(huc12, 1, 8) AS huc8, count(*) AS n FROM crosswalk GROUP BY ALL), q AS (SELECT huc2, least(count(*), greatest(1, floor(15 / count(DISTINCT huc2) OVER ()))) AS k, count(*) AS units FROM u GROUP BY huc2)
       SELECT huc2, CAST(least(units, 3) AS BIGINT) AS huc8s FROM q""",
)
def _(v):
    rows = sm.sample_by_huc(v.crosswalk, n=300, n8=15, seed=17)
    return rows.groupBy("huc2").agg(F.count_distinct("huc8").alias("huc8s"))


@query("g06_sample_by_huc_rows")
def _(v):
    return sm.sample_by_huc(v.crosswalk, n=300, n8=15, seed=17)


@query("g06_sample_huc8")
def _(v):
    return sm.sample_huc8(v.crosswalk, 6, 17, even=False)


@query("g07_shuffle", "truth", "SELECT species, huc12, comid, y FROM truth")
def _(v):
    return sm.shuffle(v.truth, ["species", "comid"], seed=19)


@query(
    "g08_drop_missing",
    "features",
    """SELECT * FROM (SELECT comid, max(CASE WHEN var = 'ElevCat' THEN x END) AS "ElevCat", max(CASE WHEN var = 'BFIWs' THEN x END) AS "BFIWs", max(CASE WHEN var = 'PctAgWs' THEN x END) AS "PctAgWs" FROM features GROUP BY comid)
       WHERE "ElevCat" IS NOT NULL AND "BFIWs" IS NOT NULL AND "PctAgWs" IS NOT NULL""",
)
def _(v):
    return sm.drop_missing(ag.widen(v.features, ["ElevCat", "BFIWs", "PctAgWs"], col="var", value="x"))
