"""Checked queries that write tables and read them back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from shoalmap.functions.records import content_id
from shoalmap.operators.aggregates import basic_meta
from shoalmap.plans.registry import R, query, r6
from shoalmap.session import scratch_path
from shoalmap.sources import buckets, files, store
from shoalmap.streaming.upsert import newest, stream_upsert

C = F.col


@query("a01_read_csv_strings", "survey", "SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber, species, comid, huc8 FROM survey")
def _(v):
    path = scratch_path(v.spark, "survey-csv")
    v.survey.write.csv(path, header=True)
    return files.read_csv_strings(v.spark, path)


@query("a02_read_crosswalk", "crosswalk", "SELECT comid, huc12, 'R' || comid AS reachcode, huc12 AS tohuc, CAST(length(comid) AS DOUBLE) AS length FROM crosswalk")
def _(v):
    path = scratch_path(v.spark, "crosswalk")
    wide = v.crosswalk.select(
        C("comid").cast("bigint").alias("COMID"),
        C("huc12").alias("HUC12"),
        F.concat(F.lit("R"), "comid").alias("REACHCODE"),
        C("huc12").alias("TOHUC"),
        F.length("comid").alias("Length"),
        F.lit("unused").alias("GNIS_NAME"),
    )
    wide.write.parquet(path)
    return files.read_crosswalk(v.spark, path)


def _zip(group: pd.DataFrame) -> pd.DataFrame:
    region, block = group["region"].iat[0], group["block"].iat[0]
    wide = group.pivot_table(index="comid", columns="metric", values="value", aggfunc="last").reset_index().fillna("")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("metrics.csv", wide.to_csv(index=False))
    return pd.DataFrame({"path": [f"/in/Metrics_Region{region}_{block}.zip"], "content": [packed.getvalue()]})


@query(
    "a03_read_zip_csv",
    "features crosswalk",
    "SELECT substr(huc12, 1, 2) AS region, comid, var AS metric, coalesce(CAST(x AS STRING), '') AS value FROM features JOIN crosswalk USING (comid)",
)
def _(v):
    # Zip files of at most 500 catchments each, made from the feature table.
    rows = v.features.join(v.crosswalk, "comid").select(
        F.substring("huc12", 1, 2).alias("region"),
        F.floor(C("comid").cast("bigint") / 500).alias("block"),
        "comid",
        C("var").alias("metric"),
        F.coalesce(C("x").cast("string"), F.lit("")).alias("value"),
    )
    zipped = rows.groupBy("region", "block").applyInPandas(_zip, "path string, content binary")
    return files.parse_zip_csv(zipped)


@query(
    "a04_merge_metric_files",
    "",
    """SELECT CAST(c_custkey AS STRING) AS comid, 'balance' AS metric, coalesce(o.top, c_acctbal) AS value FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) o ON o_custkey = c_custkey
       UNION ALL SELECT CAST(c_custkey AS STRING), 'nation', CAST(c_nationkey AS DOUBLE) FROM customer
       UNION ALL SELECT CAST(o_custkey AS STRING), 'orders', CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_custkey""",
)
def _(v):
    first = v.table("customer").select(C("c_custkey").cast("string").alias("comid"), C("c_acctbal").alias("balance"), C("c_nationkey").alias("nation"))
    second = v.table("orders").groupBy(C("o_custkey").cast("string").alias("comid")).agg(F.max("o_totalprice").alias("balance"), F.count(F.lit(1)).alias("orders"))
    return files.merge_metric_files([first, second])


@query(
    "a05_split_meta",
    "metric_raw",
    """SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'CatAreaSqKm' WHEN 1 THEN 'WSPCTFULL' ELSE metric END AS metric, value, CASE WHEN row_id % 3 < 2 THEN 'meta' ELSE 'data' END AS part FROM metric_raw""",
)
def _(v):
    name = F.when(C("row_id") % 3 == 0, "CatAreaSqKm").when(C("row_id") % 3 == 1, "WSPCTFULL").otherwise(C("metric"))
    data, meta = files.split_meta(v.metric_raw.select("row_id", name.alias("metric"), "value"))
    return data.withColumn("part", F.lit("data")).unionByName(meta.withColumn("part", F.lit("meta")))


@query(
    "a06_read_huc8",
    "metric_raw crosswalk species_range",
    """SELECT comid, metric, value, row_id, substr(huc12, 1, 8) AS huc8 FROM metric_raw JOIN crosswalk USING (comid)
       WHERE substr(huc12, 1, 8) IN (SELECT huc8 FROM species_range WHERE species < 'Brand#2')""",
)
def _(v):
    path = scratch_path(v.spark, "by-huc8")
    placed = v.metric_raw.join(v.crosswalk, "comid").withColumn("huc8", F.substring("huc12", 1, 8)).drop("huc12")
    store.write_by_huc8(placed, path)
    return store.read_huc8(v.spark, path, v.species_range.filter(C("species") < "Brand#2"))


@query("a07_verify_sink", "survey", "SELECT count(*) AS written, count(*) AS read_back, TRUE AS ok FROM survey")
def _(v):
    return store.verify_sink(v.survey, scratch_path(v.spark, "verified"))


@query(
    "a08_result_store",
    "coef fit_score",
    """SELECT 'coef' AS name, species, estimator AS key, CASE WHEN estimator = 'svc' THEN -value ELSE value END AS value FROM coef
       UNION ALL SELECT 'score', species, scorer, value FROM fit_score WHERE scorer = 'f1_micro'""",
)
def _(v):
    results = store.ResultStore(v.spark, scratch_path(v.spark, "store"))
    coef = v.coef.withColumnRenamed("estimator", "key").select("species", "key", "value")
    results.write("coef", coef)
    results.write("coef", coef.filter(C("key") == "svc").withColumn("value", -C("value")))
    results.write("score", v.fit_score.withColumnRenamed("scorer", "key").select("species", "key", "value"))
    a = results.read("coef").select(F.lit("coef").alias("name"), "species", "key", "value")
    return a.union(results.read("score", "key", "f1_micro").select(F.lit("score"), "species", "key", "value"))


@query(
    "a13_store_counts",
    "coef fit_score",
    "SELECT 'coef' AS \"table\", count(*) AS n FROM coef UNION ALL SELECT 'score', count(*) FROM fit_score",
)
def _(v):
    results = store.ResultStore(v.spark, scratch_path(v.spark, "counted"))
    results.write("coef", v.coef, "estimator")
    results.write("score", v.fit_score, "scorer")
    return results.counts()


UPDATES = """target AS (SELECT run_seq, species, config_id, loss FROM model_runs WHERE run_seq % 3 <> 0),
       updates AS (SELECT run_seq, species, config_id, loss + 1 AS loss FROM model_runs WHERE run_seq % 2 = 0)"""


@query(
    "a09_upsert",
    "model_runs",
    f"""WITH {UPDATES} SELECT 'overwrite' AS policy, * FROM updates UNION ALL SELECT 'overwrite', * FROM target WHERE run_seq NOT IN (SELECT run_seq FROM updates)
       UNION ALL SELECT 'gen', * FROM target UNION ALL SELECT 'gen', * FROM updates WHERE run_seq NOT IN (SELECT run_seq FROM target)
       UNION ALL SELECT 'append', * FROM updates UNION ALL SELECT 'append', * FROM target t WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.species = t.species AND u.run_seq = t.run_seq)""",
)
def _(v):
    runs = v.model_runs.select("run_seq", "species", "config_id", "loss")
    target = runs.filter(C("run_seq") % 3 != 0)
    updates = runs.filter(C("run_seq") % 2 == 0).withColumn("loss", C("loss") + 1)
    parts = [
        store.upsert(target, updates, keys, policy).select(F.lit(policy).alias("policy"), "run_seq", "species", "config_id", "loss")
        for policy, keys in (("overwrite", ["run_seq"]), ("gen", ["run_seq"]), ("append", ["species", "run_seq"]))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "a09_stream_upsert",
    "model_runs",
    """SELECT species, config_id, run_seq, loss FROM (SELECT *, row_number() OVER (PARTITION BY species, config_id ORDER BY run_seq DESC) AS k FROM model_runs) WHERE k = 1""",
)
def _(v):
    source, sink = scratch_path(v.spark, "updates"), scratch_path(v.spark, "upserted")
    runs = v.model_runs.select("species", "config_id", "run_seq", "loss")
    # Two arrivals: the stream takes one file per batch, the older half of the runs first.
    half = runs.agg(F.percentile_approx("run_seq", 0.5)).scalar()
    runs.filter(C("run_seq") <= half).coalesce(1).write.mode("append").parquet(source)
    runs.filter(C("run_seq") > half).coalesce(1).write.mode("append").parquet(source)
    stream = v.spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query_ = stream_upsert(stream, sink, ["species", "config_id"], "run_seq", "overwrite", scratch_path(v.spark, "progress"))
    query_.awaitTermination()
    return newest(v.spark, sink, query_)


@query(
    "a09_bucket_stream",
    "model_runs",
    """SELECT species, config_id, run_seq, loss FROM (SELECT *, row_number() OVER (PARTITION BY species, config_id ORDER BY run_seq DESC) AS k FROM model_runs) WHERE k = 1""",
)
def _(v):
    """The same updates into a table in buckets, of which a batch rewrites those it touches."""
    source, sink = scratch_path(v.spark, "updates"), scratch_path(v.spark, "buckets")
    runs = v.model_runs.select("species", "config_id", "run_seq", "loss")
    half = runs.agg(F.percentile_approx("run_seq", 0.5)).scalar()
    runs.filter(C("run_seq") > half).coalesce(1).write.mode("append").parquet(source)
    runs.filter(C("run_seq") <= half).coalesce(1).write.mode("append").parquet(source)
    stream = v.spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    buckets.stream_buckets(stream, sink, ["species", "config_id"], "run_seq", "overwrite", scratch_path(v.spark, "progress"), buckets=8).awaitTermination()
    return buckets.read_buckets(v.spark, sink)


@query("a11_cached", "truth", f"SELECT species, count(*) AS n, {R('avg(y)', 'y_mean')} FROM truth GROUP BY species")
def _(v):
    base, top = scratch_path(v.spark, "truth"), scratch_path(v.spark, "meta")
    truth = lambda level: store.cached(v.spark, base, lambda _deeper: v.truth, level)
    meta = lambda level: store.cached(v.spark, top, lambda deeper: basic_meta(truth(deeper)), level)
    meta(1)
    return meta(0).withColumn("y_mean", r6("y_mean"))


@query(
    "a12_species_from_path",
    "",
    r"""SELECT p_partkey, '/runs/species-' || lower(p_name) || '_' || CAST(p_size AS STRING) || '.model' AS path,
       regexp_extract('/runs/species-' || lower(p_name) || '_' || CAST(p_size AS STRING) || '.model', 'species-([(a-z)]+(\s[\-\.a-z]+)+)_', 1) AS species FROM part""",
)
def _(v):
    path = F.concat(F.lit("/runs/species-"), F.lower("p_name"), F.lit("_"), C("p_size").cast("string"), F.lit(".model"))
    return v.table("part").select("p_partkey", path.alias("path"), files.species_from_path(path).alias("species"))


@query("a14_read_boxes", "boxes", "SELECT id, minx, miny, maxx, maxy FROM boxes")
def _(v):
    path = scratch_path(v.spark, "boxes")
    v.boxes.withColumn("wkb", F.lit(b"")).write.parquet(path)
    return files.read_boxes(v.spark, path)


@query(
    "a15_rekey_by_species",
    "model_runs",
    "SELECT sha256(concat_ws('|', species, config_id)) AS run_id, run_seq AS comid, loss AS yhat, species FROM model_runs",
)
def _(v):
    keyed = v.model_runs.withColumn("run_id", content_id("species", "config_id"))
    pred = keyed.select("run_id", C("run_seq").alias("comid"), C("loss").alias("yhat"))
    path = scratch_path(v.spark, "by-species")
    store.rekey_by_species(pred, keyed).hint("rebalance", C("species")).write.partitionBy("species").parquet(path)
    stored = v.spark.read.parquet(path)
    return stored.withColumn("species", C("species").cast("string"))
