"""Checked queries for joins, boxes and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalmap.functions.ids import huc_prefix
from shoalmap.operators import boxes as bx
from shoalmap.operators import joins, sets
from shoalmap.plans.registry import R, query, r6
from shoalmap.session import cut

C = F.col


@query(
    "c01_attach_huc12",
    "survey crosswalk",
    """SELECT s.comid, x.huc12, x.huc12 IS NULL AS failed, count(*) AS n FROM survey s LEFT JOIN crosswalk x USING (comid) GROUP BY 1, 2, 3""",
)
def _(v):
    joined, failed = joins.attach_huc12(v.survey, v.crosswalk)
    counts = joined.groupBy("comid", "huc12").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(failed.withColumn("failed", F.lit(True)), "comid", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


NEW_HUCS = """new_hucs AS (SELECT species, huc8 FROM species_range r WHERE huc8 IN (SELECT huc8 FROM survey) AND species IN (SELECT species FROM survey)
       AND NOT EXISTS (SELECT 1 FROM survey s WHERE s.species = r.species AND s.huc8 = r.huc8))"""


@query("c02_range_new_hucs", "survey species_range", f"WITH {NEW_HUCS} SELECT * FROM new_hucs")
def _(v):
    return joins.range_new_hucs(v.species_range, v.survey)


@query(
    "c03_range_unmatched",
    "survey species_range",
    """SELECT DISTINCT 'huc8' AS kind, huc8 AS name FROM species_range WHERE huc8 NOT IN (SELECT huc8 FROM survey)
       UNION ALL SELECT DISTINCT 'species', species FROM species_range WHERE species NOT IN (SELECT species FROM survey)""",
)
def _(v):
    hucs, species = joins.range_unmatched(v.species_range, v.survey)
    return hucs.select(F.lit("huc8").alias("kind"), C("huc8").alias("name")).union(species.select(F.lit("species"), "species"))


@query(
    "c04_presence_absence",
    "survey species_range",
    f"""WITH {NEW_HUCS}, place AS (SELECT DISTINCT species, huc8 FROM survey UNION SELECT species, huc8 FROM new_hucs)
       SELECT p.species, p.huc8, site.comid, CAST(f.comid IS NOT NULL AS INTEGER) AS presence
       FROM place p JOIN (SELECT DISTINCT comid, huc8 FROM survey) site USING (huc8)
       LEFT JOIN (SELECT DISTINCT species, comid FROM survey) f ON f.species = p.species AND f.comid = site.comid""",
)
def _(v):
    return joins.presence_absence(v.survey, v.species_range)


@query(
    "c05_with_metrics",
    "survey metric_raw",
    """WITH m AS (SELECT DISTINCT comid FROM metric_raw)
       SELECT species, comid, 'kept' AS part FROM (SELECT DISTINCT species, comid FROM survey) WHERE comid IN (SELECT comid FROM m)
       UNION ALL SELECT NULL, comid, 'dropped' FROM (SELECT DISTINCT comid FROM survey) WHERE comid NOT IN (SELECT comid FROM m)""",
)
def _(v):
    pairs = v.survey.select("species", "comid").distinct()
    kept, dropped = joins.with_metrics(pairs, v.metric_raw)
    return kept.withColumn("part", F.lit("kept")).unionByName(dropped.withColumn("part", F.lit("dropped")), allowMissingColumns=True)


UNIVERSE = """place AS (SELECT species, huc8 FROM survey UNION SELECT species, huc8 FROM species_range),
       universe AS (SELECT species, huc12, comid FROM place JOIN crosswalk ON substr(huc12, 1, 8) = huc8)"""


@query(
    "c06_predict_universe",
    "survey species_range crosswalk",
    f"""WITH {UNIVERSE} SELECT species, huc12, comid FROM universe
       UNION ALL SELECT 'no crosswalk', huc8, NULL FROM (SELECT DISTINCT huc8 FROM place WHERE huc8 NOT IN (SELECT substr(huc12, 1, 8) FROM crosswalk))""",
)
def _(v):
    universe, missing = joins.predict_universe(v.survey, v.species_range, v.crosswalk)
    return universe.union(missing.select(F.lit("no crosswalk"), "huc8", F.lit(None).cast("string")))


@query(
    "c07_missing_comids",
    "truth crosswalk",
    """SELECT comid, huc12, 1 AS y FROM crosswalk WHERE substr(huc12, 1, 8) IN (SELECT substr(huc12, 1, 8) FROM truth)
       AND comid NOT IN (SELECT comid FROM truth)""",
)
def _(v):
    return joins.missing_comids(v.truth, v.crosswalk, 8)


@query("c08_align_truth", "pred", "SELECT species, estimator, huc12, comid, rep_idx, split_idx, yhat, y FROM pred", digest=("species estimator rep_idx split_idx", "yhat y"))
def _(v):
    return joins.align_truth(v.pred, v.truth)


# Boundaries are the boxes of the catchments, drawn from the supplier with the same remainder.
BOUNDS = "bounds AS (SELECT lpad(CAST(r AS STRING), 2, '0') AS huc2, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM (SELECT CAST(id AS BIGINT) % 7 AS r, * FROM boxes) GROUP BY 1)"


def bounds(v):
    code = F.lpad((C("id").cast("bigint") % 7).cast("string"), 2, "0")
    return bx.bounding_box(v.boxes.withColumn("huc2", code), ["huc2"])


@query(
    "c09_boundary_join",
    "truth boxes",
    f"WITH {BOUNDS}, d AS (SELECT substr(huc12, 1, 2) AS huc2, sum(y) AS found FROM truth GROUP BY 1) SELECT huc2, minx, miny, maxx, maxy, CAST(found AS BIGINT) AS found FROM bounds JOIN d USING (huc2)",
)
def _(v):
    data = v.truth.groupBy(huc_prefix(C("huc12"), 2).alias("huc2")).agg(F.sum("y").alias("found"))
    return bx.boundary_join(data, bounds(v), "huc2")


@query(
    "c10_catchment_join",
    "truth boxes",
    "SELECT CAST(comid AS BIGINT) AS featureid, species, huc12, comid, y, minx, miny, maxx, maxy FROM truth JOIN boxes ON CAST(id AS BIGINT) = CAST(comid AS BIGINT)",
)
def _(v):
    catch = v.boxes.select(C("id").cast("bigint").alias("featureid"), *bx.SIDES)
    return bx.catchment_join(v.truth, catch)


@query(
    "c11_bbox_overlap",
    "boxes",
    f"""WITH {BOUNDS} SELECT a.id, b.huc2 FROM boxes a JOIN bounds b ON a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny""",
)
def _(v):
    ref = bounds(v).withColumnRenamed("huc2", "id")
    return bx.bbox_overlap(v.boxes, ref, "huc2", cell=10.0)


@query(
    "c11_overlaps_extent",
    "boxes",
    """WITH r AS (SELECT min(minx) AS x0, min(miny) AS y0, max(maxx) AS x1, max(maxy) AS y1 FROM boxes WHERE CAST(id AS BIGINT) % 10 = 3)
       SELECT id FROM boxes, r WHERE minx <= x1 AND maxx >= x0 AND miny <= y1 AND maxy >= y0""",
)
def _(v):
    return bx.overlaps_extent(v.boxes, v.boxes.filter(C("id").cast("bigint") % 10 == 3)).select("id")


@query(
    "c12_clip_boxes",
    "boxes",
    """SELECT id, greatest(minx, 10) AS minx, greatest(miny, 5) AS miny, least(maxx, 40) AS maxx, least(maxy, 25) AS maxy,
       minx >= 10 AND miny >= 5 AND maxx <= 40 AND maxy <= 25 AS inside FROM boxes
       WHERE greatest(minx, 10) < least(maxx, 40) AND greatest(miny, 5) < least(maxy, 25)""",
)
def _(v):
    bound = (10, 5, 40, 25)
    return bx.clip_boxes(v.boxes.withColumn("inside", bx.within_bounds(bound)), bound)


@query(
    "c13_expand_bbox",
    "boxes",
    f"""WITH e AS (SELECT id, 0.25 * least(maxx - minx, maxy - miny) AS s, * EXCLUDE (id) FROM boxes)
       SELECT id, {R("minx - s", "minx")}, {R("miny - s", "miny")}, {R("maxx + s", "maxx")}, {R("maxy + s", "maxy")},
       {R("(maxx - minx) * (maxy - miny) / ((maxx - minx + 2 * s) * (maxy - miny + 2 * s))", "area_ratio")},
       {R("(maxx - minx) / (maxx - minx + 2 * s)", "x_ratio")}, {R("(maxy - miny) / (maxy - miny + 2 * s)", "y_ratio")} FROM e""",
)
def _(v):
    sides = F.struct(*bx.SIDES)
    wide = bx.expand_bbox(v.boxes.withColumn("inner", sides), 0.25).withColumn("outer", sides)
    ratios = bx.bbox_ratio("inner", "outer")
    named = wide.select("*", *ratios)
    return named.select("id", *[r6(c).alias(c) for c in (*bx.SIDES, "area_ratio", "x_ratio", "y_ratio")])


@query(
    "c14_mul_xb",
    "truth features coef",
    f"""WITH b AS (SELECT species, estimator, var, avg(value) AS b FROM coef GROUP BY 1, 2, 3)
       SELECT species, estimator, huc12, comid, var, {R("x * b", "xb")} FROM truth JOIN features USING (comid) JOIN b USING (species, var)""",
    digest=("huc12 var", "xb"),
)
def _(v):
    x = v.truth.select("species", "huc12", "comid").join(v.features, "comid")
    return joins.mul_xb(x, v.coef).withColumn("xb", r6("xb"))


@query(
    "c14_mul_xb_weighted",
    "pred features coef",
    f"""WITH b AS (SELECT species, estimator, huc12, comid, var, sum(yhat * value) AS b FROM pred JOIN coef USING (species, estimator, rep_idx, split_idx) GROUP BY ALL)
       SELECT species, estimator, huc12, comid, var, {R("x * b", "xb")} FROM b JOIN features USING (comid, var)""",
    digest=("huc12 var", "xb"),
)
def _(v):
    x = v.truth.select("species", "huc12", "comid").join(v.features, "comid")
    wt = v.pred.withColumn("wt", C("yhat"))
    return joins.mul_xb(x, v.coef, wt).withColumn("xb", r6("xb"))


PLAN = """plan AS (SELECT DISTINCT species, config_id, batchcount FROM model_runs),
       done AS (SELECT DISTINCT species, config_id, batchcount FROM model_runs WHERE loss < 0.02),
       failed AS (SELECT DISTINCT species, config_id, batchcount FROM model_runs WHERE loss > 0.5)"""
WORK = ["species", "config_id", "batchcount"]


def plan_done_failed(v):
    runs = v.model_runs
    return (
        runs.select(*WORK).distinct(),
        runs.filter(C("loss") < 0.02).select(*WORK).distinct(),
        runs.filter(C("loss") > 0.5).select(*WORK).distinct(),
    )


@query(
    "c15_pending",
    "model_runs",
    f"WITH {PLAN} SELECT * FROM plan EXCEPT SELECT * FROM done EXCEPT SELECT * FROM failed",
)
def _(v):
    plan, done, failed = plan_done_failed(v)
    return joins.pending(plan, done, failed, WORK)


@query(
    "c15_is_complete",
    "model_runs",
    f"""WITH {PLAN} SELECT species, count(*) AS planned, count(d.config_id) AS finished, count(*) = count(d.config_id) AS complete
       FROM plan LEFT JOIN done d USING (species, config_id, batchcount) GROUP BY species""",
)
def _(v):
    plan, done, _failed = plan_done_failed(v)
    return joins.is_complete(plan, done, WORK, ["species"])


@query(
    "c16_purge_and_append",
    "model_runs",
    f"""WITH {PLAN} SELECT 'kept' AS part, * FROM plan WHERE (species, config_id, batchcount) IN (SELECT (species, config_id, batchcount) FROM done)
       UNION ALL SELECT 'index', * FROM (SELECT * FROM done UNION SELECT * FROM failed)""",
)
def _(v):
    plan, done, failed = plan_done_failed(v)
    kept = joins.purge_orphans(plan, done, WORK).select(F.lit("kept").alias("part"), *WORK)
    return kept.unionByName(joins.append_new(done, failed, WORK).select(F.lit("index").alias("part"), *WORK))


@query(
    "c17_param_grid",
    "model_runs",
    """SELECT run_seq, species, d.n AS depth, k.n AS kern, loss FROM model_runs, (VALUES (1), (2), (3)) d(n), (VALUES ('gauss'), ('flat')) k(n)""",
)
def _(v):
    gen = F.struct("species", F.struct(F.lit(0).alias("depth"), F.lit("").alias("kern")).alias("model"), "loss")
    base = v.model_runs.select("run_seq", gen.alias("gen"))
    grid = joins.param_grid(base, "gen", {"model.depth": [1, 2, 3], "model.kern": ["gauss", "flat"]})
    return grid.select("run_seq", "gen.species", "gen.model.depth", "gen.model.kern", "gen.loss")


@query(
    "c18_merge_keyed",
    "survey",
    """WITH a AS (SELECT DISTINCT comid, 'a' AS src FROM survey WHERE huc8 < '03'), b AS (SELECT DISTINCT comid, 'b' AS src FROM survey WHERE huc8 > '02')
       SELECT 'overwrite' AS mode, comid, src FROM b UNION ALL SELECT 'overwrite', comid, src FROM a WHERE comid NOT IN (SELECT comid FROM b)
       UNION ALL SELECT 'suffix', comid, src FROM a UNION ALL SELECT 'suffix', CASE WHEN comid IN (SELECT comid FROM a) THEN comid || '_1' ELSE comid END, src FROM b""",
)
def _(v):
    a = v.survey.filter(C("huc8") < "03").select("comid", F.lit("a").alias("src")).distinct()
    b = v.survey.filter(C("huc8") > "02").select("comid", F.lit("b").alias("src")).distinct()
    both = joins.merge_keyed([a, b], "comid").select(F.lit("overwrite").alias("mode"), "comid", "src")
    return both.union(joins.merge_keyed([a, b], "comid", overwrite=False).select(F.lit("suffix"), "comid", "src"))


@query(
    "c19_partial_match",
    "model_runs",
    """WITH t AS (SELECT DISTINCT species AS target, species, config_id, 2 + batchcount AS batchcount FROM model_runs WHERE loss > 0.5),
       r AS (SELECT run_seq, species, config_id, batchcount FROM model_runs WHERE loss <= 0.1),
       m AS (SELECT t.target, r.*, CASE WHEN r.config_id = t.config_id AND r.batchcount = t.batchcount THEN 0 WHEN r.config_id = t.config_id THEN 1 ELSE 2 END AS match_level,
             t.config_id AS tc, t.batchcount AS tb FROM t JOIN r ON r.species = t.species)
       SELECT target || '/' || tc || '/' || CAST(tb AS STRING) AS target, run_seq, species, config_id, batchcount, match_level FROM
       (SELECT *, min(match_level) OVER (PARTITION BY target, tc, tb) AS best FROM m) WHERE match_level = best""",
)
def _(v):
    targets = v.model_runs.filter(C("loss") > 0.5).select("species", "config_id", (2 + C("batchcount")).alias("batchcount")).distinct()
    targets = targets.withColumn("target", F.concat_ws("/", "species", "config_id", "batchcount"))
    runs = v.model_runs.filter(C("loss") <= 0.1).select("run_seq", "species", "config_id", "batchcount")
    return joins.partial_match(runs, targets, "target", ["species", "config_id", "batchcount"], ["batchcount", "config_id"])


@query(
    "c21_species_mismatch",
    "score survey",
    "SELECT e.fold AS row_index, e.name AS species, value FROM (SELECT fold, CASE WHEN fold % 2 = 0 THEN species ELSE (SELECT min(species) FROM survey) END AS name, value FROM score) e WHERE name NOT IN (SELECT species FROM survey)",
)
def _(v):
    known = v.survey.agg(F.min("species")).scalar()
    external = v.score.select(C("fold").alias("row_index"), F.when(C("fold") % 2 == 0, C("species")).otherwise(known).alias("species"), "value")
    return joins.species_mismatch(external, v.survey)


@query(
    "c22_select_keys",
    "coef fit_score species_range",
    """SELECT 'coef' AS part, species, estimator, var AS name, rep_idx, split_idx, value FROM coef WHERE estimator IN ('lpm', 'svc')
       UNION ALL SELECT 'score', species, estimator, scorer, rep_idx, split_idx, value FROM fit_score WHERE species IN (SELECT species FROM species_range WHERE huc8 < '02')""",
)
def _(v):
    (coef,) = joins.select_keys([v.coef], "estimator", ["lpm", "svc"])
    (score,) = joins.select_keys([v.fit_score], "species", v.species_range.filter(C("huc8") < "02"))
    tail = ["rep_idx", "split_idx", "value"]
    return coef.select(F.lit("coef").alias("part"), "species", "estimator", C("var").alias("name"), *tail).union(
        score.select(F.lit("score"), "species", "estimator", "scorer", *tail)
    )


@query(
    "c23_boundary_for",
    "boxes crosswalk",
    f"WITH {BOUNDS} SELECT huc2, minx, miny, maxx, maxy FROM bounds WHERE huc2 IN (SELECT substr(huc12, 1, 2) FROM crosswalk)",
)
def _(v):
    return bx.boundary_for(bounds(v), v.crosswalk.select(C("huc12").cast("bigint").alias("huc")), 2)


@query(
    "c24_crosswalk_lookup",
    "crosswalk survey",
    """SELECT DISTINCT s.comid, x.huc12, CASE WHEN x.huc12 IS NULL THEN 'not found' ELSE 'ok' END AS message FROM survey s LEFT JOIN crosswalk x USING (comid)""",
)
def _(v):
    return joins.lookup_many(v.crosswalk, v.survey)


@query(
    "c24_crosswalk_one",
    "crosswalk",
    """SELECT comid, huc12, 'unit' AS message FROM crosswalk WHERE huc12 = '010000000001'
       UNION ALL SELECT '1', (SELECT min(huc12) FROM crosswalk WHERE comid = '1'), 'ok'
       UNION ALL SELECT '50', NULL, 'not found'""",
)
def _(v):
    unit = joins.crosswalk_lookup(v.crosswalk, huc12="010000000001").withColumn("message", F.lit("unit"))
    return unit.unionByName(joins.crosswalk_lookup(v.crosswalk, comid="1")).unionByName(joins.crosswalk_lookup(v.crosswalk, comid="50"))


@query("f01_union_ids", "survey species_range", "SELECT huc8 FROM survey UNION SELECT huc8 FROM species_range")
def _(v):
    return sets.union_ids(v.survey.select("huc8"), v.species_range.select("huc8"))


@query(
    "f02_except",
    "survey species_range",
    """SELECT 'extended' AS kind, NULL AS species, huc8 FROM (SELECT huc8 FROM survey UNION SELECT huc8 FROM species_range EXCEPT SELECT huc8 FROM survey WHERE huc8 < '03')
       UNION ALL SELECT 'unsampled', species, huc8 FROM (SELECT species, huc8 FROM species_range EXCEPT SELECT species, huc8 FROM survey)""",
)
def _(v):
    # The survey is read once: its distinct places are written.
    survey = cut(v.observed.select("species", "huc8").distinct(), "places")
    wide = sets.extended_huc8(survey, v.species_range, survey.filter(C("huc8") < "03"))
    part = wide.select(F.lit("extended").alias("kind"), F.lit(None).cast("string").alias("species"), "huc8")
    return part.union(sets.unsampled_huc8(v.species_range, survey).select(F.lit("unsampled"), "species", "huc8"))


@query("f03_intersect", "survey species_range", "SELECT species, huc8 FROM survey INTERSECT SELECT species, huc8 FROM species_range")
def _(v):
    return sets.shared_ids(v.survey.select("species", "huc8"), v.species_range)


@query(
    "f04_stack",
    "truth survey",
    "SELECT species, comid, huc12, y, NULL AS huc8 FROM truth UNION ALL SELECT species, comid, NULL, NULL, huc8 FROM survey",
)
def _(v):
    return sets.stack([v.truth, v.survey.select("species", "comid", "huc8")])
