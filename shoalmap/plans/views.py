"""The engine's input tables as views over the parquet test tables, for Spark and as SQL text.

Small fixed lists (estimators, repeats, variables) are exploded from arrays, so no view needs a
cross join on the Spark side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalmap.operators.joins import presence_of_pairs
from shoalmap.session import cut

# Fixed values of the test views.
ESTIMATORS = (("lpm", 1), ("logit", 2), ("svc", 3))
VARIABLES = (("PctUrbCat", 1), ("PctAgWs", 2), ("ElevCat", 3), ("BFIWs", 4), ("RdDensCat", 5))
CONSTANT = ("ConstWs", 0)
REPEATS = (0, 1)
SPLITS = (0, 1, 2)
SCORERS = ("f1_micro", "roc_auc_score_micro")


def _pairs(items, name: str):
    return F.inline(F.array(*[F.struct(F.lit(n).alias(name), F.lit(k).alias("_k")) for n, k in items]))


def _values(items):
    return F.explode(F.array(*[F.lit(i) for i in items]))


def _huc8():
    return F.concat(
        F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")
    )


class Views:
    """DataFrames for one scale directory, lazy but for the stored `pairs`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def crosswalk(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .filter(key % 50 != 0)
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.cast("string").alias("comid"),
                F.concat(_huc8(), F.lpad((key % 7).cast("string"), 4, "0")).alias("huc12"),
            )
        )

    @cached_property
    def observed(self) -> DataFrame:
        """The rows of the survey, in which rows may repeat."""
        return (
            self.table("lineitem")
            .filter(F.col("l_returnflag") == "R")
            .join(self.table("orders").filter(F.col("o_custkey") % 3 != 0), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation").filter(F.col("n_nationkey") != 24), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "l_orderkey",
                "l_linenumber",
                F.concat_ws(" ", "p_brand", "p_type").alias("species"),
                F.col("o_custkey").cast("string").alias("comid"),
                _huc8().alias("huc8"),
            )
        )

    @cached_property
    def survey(self) -> DataFrame:
        return self.observed.distinct()

    @cached_property
    def pairs(self) -> DataFrame:
        """Distinct (species, comid, huc8), written once per run: truth and coef both start here."""
        return cut(self.observed.select("species", "comid", "huc8").distinct(), "pairs")

    @cached_property
    def species_range(self) -> DataFrame:
        return (
            self.table("lineitem")
            .filter(F.col("l_discount") == 0.1)
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.when(F.col("p_partkey") % 41 == 0, F.concat(F.lit("Unseen "), "p_brand")).otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("species"), _huc8().alias("huc8"))
            .distinct()
        )

    @cached_property
    def metric_raw(self) -> DataFrame:
        key = F.col("o_orderkey")
        # Some catchments of the survey have no metrics, and some metrics no catchment.
        place = F.col("o_custkey") + F.when(F.col("o_custkey") % 11 == 5, 100_000_000).otherwise(0)
        return self.table("orders").select(
            place.cast("string").alias("comid"),
            F.concat(
                F.lit("Pct"), F.substring("o_orderpriority", 1, 1), F.year("o_orderdate").cast("string"), F.lit("Cat")
            ).alias("metric"),
            F.when(key % 97 == 0, "NA")
            .when(key % 101 == 0, "")
            .otherwise(F.floor("o_totalprice").cast("bigint").cast("string"))
            .alias("value"),
            key.alias("row_id"),
        )

    @cached_property
    def truth(self) -> DataFrame:
        found = presence_of_pairs(self.pairs, crosswalk=self.crosswalk)
        return found.select("species", "huc12", "comid", F.col("presence").alias("y"))

    @cached_property
    def pred(self) -> DataFrame:
        comid = F.col("comid").cast("bigint")
        return (
            self.truth.select("*", _pairs(ESTIMATORS, "estimator"))
            .select("*", _values(REPEATS).alias("rep_idx"))
            .select(
                "species",
                "estimator",
                "huc12",
                "comid",
                "rep_idx",
                ((comid + F.col("rep_idx")) % 3).alias("split_idx"),
                (
                    ((comid * 37 + F.length("species") * 11 + F.col("_k") * 17 + F.col("rep_idx") * 5) % 100)
                    / F.lit(100.0)
                ).alias("yhat"),
                "y",
            )
        )

    @cached_property
    def score(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("string").alias("species"),
            F.col("event_type").alias("estimator"),
            (F.col("event_id") % 4).alias("scorer_id"),
            F.col("event_id").alias("fold"),
            F.when(F.col("event_id") % 499 != 0, F.col("value")).alias("value"),
        )

    @cached_property
    def labels_pred(self) -> DataFrame:
        return self.table("labels").select(
            "doc_id",
            F.col("quality").alias("y"),
            (
                ((F.col("doc_id") * 37 + F.col("toxic") * 13 + F.col("quality") * 29) % 100) / F.lit(100.0)
            ).alias("yhat"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        s, n = F.col("s_suppkey"), F.col("s_nationkey")
        left = n % 5 * 10 + s % 10
        bottom = s % 17 * 2
        return self.table("supplier").select(
            s.cast("string").alias("id"),
            left.cast("double").alias("minx"),
            bottom.cast("double").alias("miny"),
            (left + 1 + s % 3).cast("double").alias("maxx"),
            (bottom + 1 + s % 4).cast("double").alias("maxy"),
        )

    @cached_property
    def features(self) -> DataFrame:
        c, k = F.col("c_custkey"), F.col("_k")
        value = ((c * 31 + k * k * 17) % 101).cast("double") / F.lit(10.0)
        return (
            self.table("customer")
            .select("c_custkey", _pairs((*VARIABLES, CONSTANT), "var"))
            .select(
                c.cast("string").alias("comid"), "var", F.when((c * 7 + k) % 19 != 0, value).alias("x")
            )
        )

    @cached_property
    def coef(self) -> DataFrame:
        return (
            self.pairs.select("species")
            .distinct()
            .select("species", F.inline(F.array(*[F.struct(F.lit(n).alias("estimator"), F.lit(k).alias("_e")) for n, k in ESTIMATORS])))
            .select("*", _pairs(VARIABLES, "var"))
            .select("*", _values(REPEATS).alias("rep_idx"))
            .select("*", _values(SPLITS).alias("split_idx"))
            .select(
                "species",
                "estimator",
                "var",
                "rep_idx",
                "split_idx",
                (
                    (
                        (
                            F.length("species") * 13
                            + F.col("_e") * 7
                            + F.col("_k") * 29
                            + F.col("rep_idx") * 3
                            + F.col("split_idx") * 5
                        )
                        % 41
                        - 20
                    ).cast("double")
                    / F.lit(10.0)
                ).alias("value"),
            )
        )

    @cached_property
    def fit_score(self) -> DataFrame:
        return (
            self.coef.select("species", "estimator", "rep_idx", "split_idx")
            .distinct()
            .select("*", _values(SCORERS).alias("scorer"))
            .select(
                "species",
                "estimator",
                "scorer",
                "rep_idx",
                "split_idx",
                (
                    (
                        (
                            F.length("species") * 11
                            + F.length("estimator") * 17
                            + F.length("scorer") * 3
                            + F.col("rep_idx") * 7
                            + F.col("split_idx")
                        )
                        % 50
                        + 50
                    ).cast("double")
                    / F.lit(100.0)
                ).alias("value"),
            )
        )

    @cached_property
    def model_runs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("run_seq"),
            F.col("user_id").cast("string").alias("species"),
            F.col("event_type").alias("config_id"),
            F.col("ts").alias("when_saved"),
            (F.col("value") / F.lit(500.0)).alias("loss"),
            F.lit(0.25).alias("naiveloss"),
            F.lit(8).alias("batch_n"),
            (1 + F.col("event_id") % 4).alias("batchcount"),
        )


HUC8_SQL = "lpad(CAST(n_regionkey + 1 AS STRING), 2, '0') || lpad(CAST(n_nationkey AS STRING), 6, '0')"

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "crosswalk": (
        (),
        f"""SELECT CAST(c_custkey AS STRING) AS comid,
       {HUC8_SQL} || lpad(CAST(c_custkey % 7 AS STRING), 4, '0') AS huc12
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 0""",
    ),
    "survey": (
        (),
        f"""SELECT DISTINCT l_orderkey, l_linenumber, p_brand || ' ' || p_type AS species,
       CAST(o_custkey AS STRING) AS comid, {HUC8_SQL} AS huc8
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' AND o_custkey % 3 <> 0 AND n_nationkey <> 24""",
    ),
    "species_range": (
        (),
        f"""SELECT DISTINCT CASE WHEN p_partkey % 41 = 0 THEN 'Unseen ' || p_brand ELSE p_brand || ' ' || p_type END AS species, {HUC8_SQL} AS huc8
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE l_discount = 0.1""",
    ),
    "metric_raw": (
        (),
        """SELECT CAST(o_custkey + CASE WHEN o_custkey % 11 = 5 THEN 100000000 ELSE 0 END AS STRING) AS comid,
       'Pct' || substr(o_orderpriority, 1, 1) || CAST(year(o_orderdate) AS STRING) || 'Cat' AS metric,
       CASE WHEN o_orderkey % 97 = 0 THEN 'NA' WHEN o_orderkey % 101 = 0 THEN ''
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS value, o_orderkey AS row_id
FROM orders""",
    ),
    "truth": (
        ("survey", "crosswalk"),
        """SELECT sp.species, x.huc12, site.comid, CAST(s.comid IS NOT NULL AS INTEGER) AS y
FROM (SELECT DISTINCT species, huc8 FROM survey) sp
JOIN (SELECT DISTINCT comid, huc8 FROM survey) site USING (huc8)
JOIN crosswalk x ON x.comid = site.comid
LEFT JOIN (SELECT DISTINCT species, comid FROM survey) s ON s.species = sp.species AND s.comid = site.comid""",
    ),
    "pred": (
        ("truth",),
        """SELECT species, e.estimator, huc12, comid, r.rep_idx,
       (CAST(comid AS BIGINT) + r.rep_idx) % 3 AS split_idx,
       ((CAST(comid AS BIGINT) * 37 + length(species) * 11 + e.k * 17 + r.rep_idx * 5) % 100) / CAST(100 AS DOUBLE) AS yhat, y
FROM truth, (VALUES ('lpm', 1), ('logit', 2), ('svc', 3)) e(estimator, k), (VALUES (0), (1)) r(rep_idx)""",
    ),
    "score": (
        (),
        """SELECT CAST(user_id AS STRING) AS species, event_type AS estimator, event_id % 4 AS scorer_id,
       event_id AS fold, CASE WHEN event_id % 499 = 0 THEN NULL ELSE value END AS value FROM events""",
    ),
    "labels_pred": (
        (),
        """SELECT doc_id, quality AS y,
       ((doc_id * 37 + toxic * 13 + quality * 29) % 100) / CAST(100 AS DOUBLE) AS yhat FROM labels""",
    ),
    "boxes": (
        (),
        """SELECT CAST(s_suppkey AS STRING) AS id,
       CAST(s_nationkey % 5 * 10 + s_suppkey % 10 AS DOUBLE) AS minx, CAST(s_suppkey % 17 * 2 AS DOUBLE) AS miny,
       CAST(s_nationkey % 5 * 10 + s_suppkey % 10 + 1 + s_suppkey % 3 AS DOUBLE) AS maxx,
       CAST(s_suppkey % 17 * 2 + 1 + s_suppkey % 4 AS DOUBLE) AS maxy FROM supplier""",
    ),
    "features": (
        (),
        """SELECT CAST(c_custkey AS STRING) AS comid, v.var,
       CASE WHEN (c_custkey * 7 + v.k) % 19 = 0 THEN NULL
            ELSE CAST((c_custkey * 31 + v.k * v.k * 17) % 101 AS DOUBLE) / CAST(10 AS DOUBLE) END AS x
FROM customer, (VALUES ('PctUrbCat', 1), ('PctAgWs', 2), ('ElevCat', 3), ('BFIWs', 4), ('RdDensCat', 5), ('ConstWs', 0)) v(var, k)""",
    ),
    "coef": (
        ("survey",),
        """SELECT s.species, e.estimator, v.var, r.rep_idx, f.split_idx,
       CAST((length(s.species) * 13 + e.k * 7 + v.k * 29 + r.rep_idx * 3 + f.split_idx * 5) % 41 - 20 AS DOUBLE) / CAST(10 AS DOUBLE) AS value
FROM (SELECT DISTINCT species FROM survey) s, (VALUES ('lpm', 1), ('logit', 2), ('svc', 3)) e(estimator, k),
     (VALUES ('PctUrbCat', 1), ('PctAgWs', 2), ('ElevCat', 3), ('BFIWs', 4), ('RdDensCat', 5)) v(var, k),
     (VALUES (0), (1)) r(rep_idx), (VALUES (0), (1), (2)) f(split_idx)""",
    ),
    "fit_score": (
        ("coef",),
        """SELECT DISTINCT species, estimator, scorer, rep_idx, split_idx,
       CAST((length(species) * 11 + length(estimator) * 17 + length(scorer) * 3 + rep_idx * 7 + split_idx) % 50 + 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS value
FROM coef, (VALUES ('f1_micro'), ('roc_auc_score_micro')) sc(scorer)""",
    ),
    "model_runs": (
        (),
        """SELECT event_id AS run_seq, CAST(user_id AS STRING) AS species, event_type AS config_id, ts AS when_saved,
       value / CAST(500 AS DOUBLE) AS loss, CAST(0.25 AS DOUBLE) AS naiveloss, 8 AS batch_n, 1 + event_id % 4 AS batchcount
FROM events""",
    ),
}


def sql_with(views: tuple[str, ...], body: str) -> str:
    """`body` behind a WITH list of the views it uses and the views those use."""
    chain: list[str] = []

    def add(name: str) -> None:
        needs, _ = SQL_VIEWS[name]
        for need in needs:
            add(need)
        if name not in chain:
            chain.append(name)

    for name in views:
        add(name)
    body = body.strip()
    if not chain:
        return body
    head = ",\n".join(f"{name} AS ({SQL_VIEWS[name][1]})" for name in chain)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
