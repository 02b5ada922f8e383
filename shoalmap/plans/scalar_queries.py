"""Checked queries for column functions (ids, names, numbers, records)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalmap.functions import ids, metric_names, numeric, records
from shoalmap.operators import boxes as bx
from shoalmap.operators import importance
from shoalmap.operators.kernel import eval_grid
from shoalmap.plans.registry import R, query, r6
from shoalmap.sources.store import split_errors

C = F.col


@query("b01_digits_only", "survey", "SELECT DISTINCT 'id-' || comid || '/a' AS raw, regexp_replace('id-' || comid || '/a', '[^0-9]', '', 'g') AS id FROM survey")
def _(v):
    raw = F.concat(F.lit("id-"), C("comid"), F.lit("/a"))
    return v.survey.select("comid").distinct().select(raw.alias("raw"), ids.digits_only(raw).alias("id"))


@query(
    "b02_pad_huc8",
    "survey",
    """SELECT DISTINCT substr(huc8, 2) AS short, CASE length(substr(huc8, 2)) WHEN 7 THEN '0' || substr(huc8, 2) ELSE substr(huc8, 2) END AS padded,
       CASE length(huc8) WHEN 7 THEN '0' || huc8 ELSE huc8 END AS kept FROM survey""",
)
def _(v):
    short = F.substring("huc8", 2, 7)
    return v.survey.select(
        short.alias("short"), ids.pad_huc8(short).alias("padded"), ids.pad_huc8(C("huc8")).alias("kept")
    ).distinct()


@query(
    "b03_huc12_str",
    "crosswalk",
    "SELECT comid, CAST(huc12 AS DOUBLE) AS as_number, lpad(CAST(CAST(CAST(huc12 AS DOUBLE) AS BIGINT) AS STRING), 12, '0') AS huc12 FROM crosswalk",
)
def _(v):
    number = C("huc12").cast("double")
    return v.crosswalk.select("comid", number.alias("as_number"), ids.huc12_str(number).alias("huc12"))


@query(
    "b04_stringify_huc",
    "crosswalk",
    """SELECT comid, CASE WHEN length(h) % 2 = 1 THEN '0' || h ELSE h END AS huc
       FROM (SELECT comid, CAST(CAST(huc12 AS BIGINT) AS STRING) AS h FROM crosswalk)""",
)
def _(v):
    return v.crosswalk.select("comid", ids.stringify_huc(C("huc12").cast("bigint")).alias("huc"))


@query(
    "b05_huc_prefix",
    "crosswalk",
    "SELECT comid, substr(huc12, 1, 2) AS huc2, substr(huc12, 1, 8) AS huc8, substr(huc12, 1, 10) AS huc10 FROM crosswalk",
)
def _(v):
    h = C("huc12")
    return v.crosswalk.select("comid", *[ids.huc_prefix(h, n).alias(f"huc{n}") for n in (2, 8, 10)])


@query(
    "b06_metric_year",
    "metric_raw",
    r"""SELECT DISTINCT metric, regexp_replace(metric, '^(.*?)20[0-9][0-9](.*)$', '\1\2_avg') AS stem,
       CASE WHEN regexp_extract(metric, '20[0-9][0-9]') = '' THEN 'all' ELSE regexp_extract(metric, '20[0-9][0-9]') END AS year
       FROM metric_raw""",
)
def _(v):
    m = C("metric")
    return v.metric_raw.select("metric").distinct().select(
        m, metric_names.metric_stem(m).alias("stem"), metric_names.metric_year(m).alias("year")
    )


@query(
    "b07_metric_class",
    "metric_raw",
    """SELECT metric, CASE WHEN ends_with(metric, 'Ws') THEN 'Ws' WHEN ends_with(metric, 'Cat') THEN 'Cat'
       WHEN ends_with(metric, 'CatRp100') THEN 'CatRp100' WHEN ends_with(metric, 'WsRp100') THEN 'WsRp100'
       WHEN ends_with(metric, 'Rp100') THEN 'Rp100' ELSE 'other' END AS class, count(*) AS n
       FROM (SELECT metric || CASE row_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Rp100' WHEN 2 THEN 'Ws' ELSE 'Elev' END AS metric FROM metric_raw)
       GROUP BY 1, 2""",
)
def _(v):
    tail = F.when(C("row_id") % 4 == 0, "").when(C("row_id") % 4 == 1, "Rp100").when(C("row_id") % 4 == 2, "Ws").otherwise("Elev")
    named = v.metric_raw.select(F.concat("metric", tail).alias("metric"))
    return named.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).withColumn("class", metric_names.metric_class(C("metric")))


@query(
    "b08_parse_metric",
    "metric_raw",
    """SELECT row_id, comid, metric, CASE WHEN value IN ('', 'NA') THEN NULL ELSE TRY_CAST(value AS DOUBLE) END AS value,
       value IN ('', 'NA') AS missing FROM metric_raw""",
)
def _(v):
    parsed = metric_names.parse_metric(C("value"))
    return v.metric_raw.select(
        "row_id", "comid", "metric", F.nanvl(parsed, F.lit(None).cast("double")).alias("value"), F.isnan(parsed).alias("missing")
    )


@query(
    "b09_cast_objects",
    "metric_raw",
    "SELECT comid, CAST(row_id AS BIGINT) AS row_id, TRY_CAST(value AS DOUBLE) AS value FROM metric_raw",
)
def _(v):
    return numeric.cast_objects(v.metric_raw.select("comid", "row_id", "value"), keep=["comid"])


NAMED = """SELECT DISTINCT CASE row_id % 5 WHEN 0 THEN metric WHEN 1 THEN 'Dam' || metric WHEN 2 THEN 'Nsurp08cat'
       WHEN 3 THEN metric || '_v1' ELSE metric || CASE row_id % 2 WHEN 0 THEN '_v2' ELSE '_v2_1' END END AS metric FROM metric_raw"""


def named(v):
    m, r = C("metric"), C("row_id")
    return v.metric_raw.select(
        F.when(r % 5 == 0, m)
        .when(r % 5 == 1, F.concat(F.lit("Dam"), m))
        .when(r % 5 == 2, "Nsurp08cat")
        .when(r % 5 == 3, F.concat(m, F.lit("_v1")))
        .otherwise(F.concat(m, F.when(r % 2 == 0, "_v2").otherwise("_v2_1")))
        .alias("metric")
    ).distinct()


@query(
    "b10_prune_features",
    "metric_raw",
    f"SELECT metric FROM ({NAMED}) WHERE NOT regexp_matches(metric, '0[8-9](cat|ws)$|^Dam') AND metric NOT IN ('Pct11992Cat')",
)
def _(v):
    return metric_names.prune_features(named(v), bad=["Pct11992Cat"])


@query(
    "b11_latest_version",
    "metric_raw",
    rf"""SELECT metric FROM (SELECT metric, row_number() OVER (PARTITION BY regexp_replace(metric, '_v[0-9]+(_[0-9]+)?$', '')
       ORDER BY CASE WHEN ends_with(metric, '_v1') THEN 1 WHEN ends_with(metric, '_v2') THEN 2 WHEN ends_with(metric, '_v2_1') THEN 3 ELSE 0 END DESC) AS k
       FROM ({NAMED})) WHERE k = 1""",
)
def _(v):
    return metric_names.latest_version(named(v))


@query(
    "b12_drop_matching",
    "coef",
    "SELECT * FROM coef WHERE NOT (contains(lower(var), 'urb') OR contains(lower(var), 'bfi') OR contains(lower(var), 'Al2O3'))",
)
def _(v):
    return metric_names.drop_matching(v.coef, ["urb", "bfi", "Al2O3"], col="var")


@query(
    "b13_feature_columns",
    "features",
    """SELECT comid, max(CASE WHEN var = 'BFIWs' THEN x END) AS "BFIWs", max(CASE WHEN var = 'ElevCat' THEN x END) AS "ElevCat",
       max(CASE WHEN var = 'PctUrbCat' THEN x END) AS "PctUrbCat" FROM features GROUP BY comid""",
)
def _(v):
    from shoalmap.operators.aggregates import widen
    from shoalmap.operators.features import feature_columns

    wide = widen(v.features, ["BFIWs", "ElevCat", "PctUrbCat", "PctAgWs"], col="var", value="x", fill=None)
    return wide.select("comid", *feature_columns(wide, location=["comid"], dropped=["PctAgWs"], target="y"))


@query(
    "b14_binarize",
    "labels_pred",
    "SELECT doc_id, CASE WHEN yhat > 0.5 THEN 1 ELSE 0 END AS at_half, CASE WHEN yhat - 0.5 > 0 THEN 1 ELSE -1 END AS at_zero FROM labels_pred",
)
def _(v):
    return v.labels_pred.select(
        "doc_id", numeric.binarize(C("yhat"), 0.5).alias("at_half"), numeric.binarize(C("yhat") - 0.5, 0).alias("at_zero")
    )


@query(
    "b15_log_shift",
    "features",
    f"""WITH m AS (SELECT min(x) AS lo FROM features)
       SELECT comid, var, {R("ln(x - (SELECT lo FROM m) + 1)", "log")}, {R("ln(greatest(x - 5, -5) + 5 + 1)", "log1p")},
       {R("sign(x - 5) * ln(abs(x - 5) + 1)", "signed")}, {R("x", "back")} FROM features WHERE x IS NOT NULL""",
)
def _(v):
    x = C("x")
    df = v.features.filter(x.isNotNull())
    log, signed = numeric.LogShift.fit(df, "x", "log"), numeric.LogShift("signed1p")
    log1p = numeric.LogShift.fit(df.select((x - 5).alias("x")), "x", "log1p")
    return df.select(
        "comid",
        "var",
        r6(log.transform(x)).alias("log"),
        r6(log1p.transform(x - 5)).alias("log1p"),
        r6(signed.transform(x - 5)).alias("signed"),
        r6(log.inverse(log.transform(x))).alias("back"),
    )


@query(
    "b16_huc_distance",
    "crosswalk",
    """WITH p AS (SELECT comid, huc12, lag(huc12) OVER (ORDER BY CAST(comid AS BIGINT)) AS before FROM crosswalk)
       SELECT comid, CASE WHEN huc12 = before THEN 0 ELSE CAST(floor(log10(abs(CAST(huc12 AS DOUBLE) - CAST(before AS DOUBLE))) / 2) + 1 AS BIGINT) END AS level
       FROM p WHERE before IS NOT NULL""",
)
def _(v):
    from shoalmap.operators.numbering import running

    numbered = v.crosswalk.withColumn("k", C("comid").cast("bigint"))
    pairs = running(numbered, [], ["k"], before=("prev", "huc12")).filter(C("before").isNotNull())
    return pairs.select("comid", numeric.huc_distance(C("huc12"), C("before")).alias("level"))


@query(
    "b17_scale_distance",
    "features",
    f"""WITH p AS (SELECT comid, var, abs(x - 5) AS d FROM features WHERE x IS NOT NULL)
       SELECT comid, var, {R("d / 4", "divide")}, {R("ln(d + 1)", "ln1")}, {R("d / (SELECT max(d) FROM p)", "norm1")} FROM p""",
)
def _(v):
    df = v.features.filter(C("x").isNotNull()).select("comid", "var", F.abs(C("x") - 5).alias("d"))
    top = df.agg(F.max("d")).scalar()
    return df.select(
        "comid",
        "var",
        r6(numeric.scale_distance(C("d"), "divide", 4)).alias("divide"),
        r6(numeric.scale_distance(C("d"), "ln1")).alias("ln1"),
        r6(numeric.scale_distance(C("d"), "norm1", top)).alias("norm1"),
    )


@query("b18_gkern", "features", f"SELECT comid, var, {R('exp(-(x * x) / (2 * 1.5 * 1.5))', 'k')} FROM features WHERE x IS NOT NULL")
def _(v):
    return v.features.filter(C("x").isNotNull()).select("comid", "var", r6(numeric.gkern(C("x"), 1.5)).alias("k"))


@query(
    "b19_diff_score",
    "pred",
    f"""SELECT species, estimator, comid, rep_idx, {R("exp(-abs(yhat - y))", "good")}, {R("-exp(abs(yhat - y))", "legacy")} FROM pred""",
    digest=("species estimator rep_idx", "good legacy"),
)
def _(v):
    y, p = C("y"), C("yhat")
    return v.pred.select(
        "species", "estimator", "comid", "rep_idx", r6(numeric.diff_score(y, p)).alias("good"), r6(numeric.diff_score(y, p, legacy=True)).alias("legacy")
    )


@query(
    "b20_ci_band",
    "features",
    f"""SELECT var, {R("m - 1.96 * s", "lower")}, {R("m + 1.96 * s", "upper")} FROM
       (SELECT var, avg(x) AS m, stddev_samp(x) / sqrt(count(x)) AS s FROM features GROUP BY var)""",
)
def _(v):
    stats = v.features.groupBy("var").agg(F.avg("x").alias("m"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("s"))
    low, high = numeric.ci_band(C("m"), C("s"))
    return stats.select("var", r6(low).alias("lower"), r6(high).alias("upper"))


@query("b21_format_name", "survey", "SELECT DISTINCT species, upper(substr(species, 1, 1)) || lower(substr(species, 2)) AS name FROM survey")
def _(v):
    return v.survey.select("species").distinct().select("species", ids.format_name(C("species")).alias("name"))


@query(
    "b22_content_id",
    "model_runs",
    "SELECT run_seq, sha256(concat_ws('|', species, config_id, CAST(batch_n AS STRING), CAST(batchcount AS STRING))) AS run_id FROM model_runs",
)
def _(v):
    return v.model_runs.select("run_seq", records.content_id("species", "config_id", "batch_n", "batchcount").alias("run_id"))


def nested(v):
    inner = F.struct("species", "config_id").alias("data_gen")
    kern = F.struct(F.struct("loss", "naiveloss").alias("losses"), C("batch_n").alias("n")).alias("model_gen")
    return v.model_runs.select("run_seq", F.struct(inner, kern).alias("run"))


@query(
    "b23_flatten_struct",
    "model_runs",
    """SELECT run_seq, species AS "data_gen:species", config_id AS "data_gen:config_id", loss AS "model_gen:losses:loss",
       naiveloss AS "model_gen:losses:naiveloss", batch_n AS "model_gen:n" FROM model_runs""",
)
def _(v):
    return records.flatten_struct(nested(v), "run")


@query(
    "b24_override_struct",
    "model_runs",
    """SELECT run_seq, species AS "data_gen:species", 'fixed' AS "data_gen:config_id", loss AS "model_gen:losses:loss",
       loss * 2 AS "model_gen:losses:naiveloss", batch_n AS "model_gen:n" FROM model_runs""",
)
def _(v):
    spec = {"data_gen": {"config_id": "fixed"}, "model_gen": {"losses": {"naiveloss": C("run.model_gen.losses.loss") * 2}}}
    changed = nested(v).withColumn("run", records.override_struct(C("run"), spec))
    return records.flatten_struct(changed, "run")


@query(
    "b25_struct_equal",
    "model_runs",
    "SELECT run_seq, config_id = 'click' AND batchcount = 2 AS same, batchcount = 2 AS same_map FROM model_runs",
)
def _(v):
    a = F.struct("config_id", "batchcount")
    b = F.struct(F.lit("click").alias("config_id"), F.lit(2).cast("bigint").alias("batchcount"))
    m = F.create_map(F.lit("n"), C("batchcount"), F.lit("one"), F.lit(1).cast("bigint"))
    w = F.create_map(F.lit("one"), F.lit(1).cast("bigint"), F.lit("n"), F.lit(2).cast("bigint"))
    return v.model_runs.select("run_seq", records.struct_equal(a, b).alias("same"), records.map_equal(m, w).alias("same_map"))


@query(
    "b26_eval_grid",
    "features",
    f"""WITH s AS (SELECT var, avg(x) AS m, stddev_samp(x) AS sd FROM features GROUP BY var),
       g AS (SELECT range AS i, -3 + range * CAST(6 AS DOUBLE) / 6 AS even,
             CASE WHEN range < 3 THEN -(exp((3 - range) * ln(4) / 3) - 1) WHEN range = 3 THEN 0 ELSE exp((range - 3) * ln(4) / 3) - 1 END AS expo
             FROM range(7))
       SELECT var, a.i AS i, b.i AS j, {R("m + a.even * sd", "even")}, {R("m + b.expo * sd", "expo")} FROM s, g a, g b""",
)
def _(v):
    stats = v.features.groupBy("var").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    even, expo = eval_grid("even", 7, 3.0), eval_grid("exp", 7, 3.0)
    return (
        stats.select("*", F.posexplode(F.array(*[F.lit(g) for g in even])).alias("i", "a"))
        .select("*", F.posexplode(F.array(*[F.lit(g) for g in expo])).alias("j", "b"))
        .select(
            "var",
            C("i").cast("bigint").alias("i"),
            C("j").cast("bigint").alias("j"),
            r6(C("m") + C("a") * C("sd")).alias("even"),
            r6(C("m") + C("b") * C("sd")).alias("expo"),
        )
    )


COEF_SCORE = """long AS (SELECT species, estimator, var, rep_idx, split_idx, CASE WHEN estimator = 'svc' THEN NULL ELSE value END AS value FROM coef
       UNION ALL SELECT species, estimator, 'scorer:' || scorer, rep_idx, split_idx, value FROM fit_score)"""


def coef_score(v):
    coef = v.coef.withColumn("value", F.when(C("estimator") != "svc", C("value")))
    score = v.fit_score.select("species", "estimator", F.concat(F.lit("scorer:"), C("scorer")).alias("var"), "rep_idx", "split_idx", "value")
    return coef.unionByName(score)


@query(
    "b27_split_coef_score",
    "coef fit_score",
    f"""WITH {COEF_SCORE}, k AS (SELECT species, estimator FROM long WHERE var NOT LIKE 'scorer:%' GROUP BY 1, 2 HAVING count(value) > 0)
       SELECT CASE WHEN var LIKE 'scorer:%' THEN 'score' ELSE 'coef' END AS part, long.* FROM long JOIN k USING (species, estimator)""",
)
def _(v):
    coef, score = importance.split_coef_score(coef_score(v), drop_nocoef=True)
    return coef.withColumn("part", F.lit("coef")).unionByName(score.withColumn("part", F.lit("score")))


@query(
    "b28_conus_only",
    "crosswalk",
    """SELECT 'huc2' AS kind, huc12 AS code FROM (SELECT DISTINCT huc12 FROM crosswalk) WHERE CAST(substr(huc12, 1, 2) AS INTEGER) < 4
       UNION ALL SELECT 'state', fips FROM (SELECT fips FROM (SELECT DISTINCT lpad(CAST(CAST(substr(huc12, 3, 6) AS INTEGER) AS STRING), 2, '0') AS fips FROM crosswalk)
       WHERE fips NOT IN ('02', '15') ORDER BY fips LIMIT 49)""",
)
def _(v):
    units = v.crosswalk.select("huc12").distinct()
    # The test table has five regions, so they are moved up by 15 to lie around the limit.
    hucs = bx.conus_only(units.withColumn("huc2", C("huc12").substr(1, 2).cast("int") + 15))
    states = units.select(F.lpad(C("huc12").substr(3, 6).cast("int").cast("string"), 2, "0").alias("fips")).distinct()
    return hucs.select(F.lit("huc2").alias("kind"), C("huc12").alias("code")).union(
        bx.conus_states(states).select(F.lit("state"), "fips")
    )


@query("b29_set_key", "coef", "SELECT species, 'all' AS estimator, var, rep_idx, split_idx, value FROM coef")
def _(v):
    return records.set_key(v.coef, "estimator", "all")


@query(
    "a10_split_errors",
    "metric_raw",
    """SELECT row_id, comid, metric, value, TRY_CAST(value AS DOUBLE) IS NULL AND value NOT IN ('', 'NA') AS failed
       FROM (SELECT row_id, comid, metric, CASE WHEN row_id % 89 = 0 THEN 'n/a?' ELSE value END AS value FROM metric_raw)""",
)
def _(v):
    df = v.metric_raw.withColumn("value", F.when(C("row_id") % 89 == 0, "n/a?").otherwise(C("value")))
    good, bad = split_errors(df, metric_names.parse_metric(C("value")).isNull())
    return good.withColumn("failed", F.lit(False)).unionByName(bad.withColumn("failed", F.lit(True)))
