"""Queries of the subpackage: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.substring_dedup import repeats_digest

    return repeats_digest(table(spark, sf_dir, "documents"))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


@query(
    "op7_warc",
    """
    WITH p AS (
        SELECT page_id, url, coalesce(html, '') AS payload FROM pages
    ), d AS (
        SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p
    ), f AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
    FROM f
    """,
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url_key", "captured")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.quality import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language_model")
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.language_model import score_digest

    return score_digest(table(spark, sf_dir, "documents"))


@query("op4_spotsigs")
def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.spotsigs import edited_digest

    return edited_digest(table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.licenses import document_files, scan

    out = scan(document_files(spark, table(spark, sf_dir, "documents")))
    return out.select("rest.*", "license", "cosine", "origin", "from_directory")


@query("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.feistel import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


@query(
    "op11_resampling",
    r"""
    WITH bits AS (
        SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of
    ), texts AS (
        SELECT true AS own, doc_id, row_number() OVER () AS pos, coalesce(text, '') AS text FROM documents
        UNION ALL SELECT false, NULL, -row_number() OVER (), coalesce(text, '') FROM benchmark
    ), words AS (
        SELECT own, pos, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
    ), counted AS (
        SELECT own, pos, w, count(*) AS n FROM words GROUP BY ALL
    ), hexed AS (
        SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM counted)
    ), bytes AS (
        SELECT w, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2))::BIGINT) AS b FROM hexed
    ), buckets AS (
        SELECT w, xor(list_reduce([4294967295] || b, lambda c, v: xor(c >> 8, crc_of[CAST(1 + (xor(c, v) & 255) AS INTEGER)])), 4294967295) % 10000 AS bucket FROM bytes, bits
    ), per AS (
        SELECT own, pos, bucket, sum(n) AS n FROM counted JOIN buckets USING (w) GROUP BY ALL
    ), totals AS (
        SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM per GROUP BY bucket
    ), whole AS (
        SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals
    ), gained AS (
        SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals, whole
    ), weighed AS (
        SELECT pos, sum(n) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM per JOIN gained USING (bucket) WHERE own GROUP BY pos
    ), scored AS (
        SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM texts LEFT JOIN weighed USING (pos) WHERE own
    ), ranked AS (
        SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST, n_features, weight) AS place,
               count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
    """,
)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_divergence",
    r"""
    WITH docs AS (
        SELECT row_number() OVER () AS pos, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
    ), words AS (
        SELECT pos, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
    ), kept AS (
        SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT pos) >= 10
    ), v AS (
        SELECT lang, count(*) AS v FROM kept GROUP BY ALL
    ), groups AS (
        SELECT DISTINCT lang, source FROM docs
    ), n AS (
        SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
    ), counts AS (
        SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
        FROM groups g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
    ), p AS (
        SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM counts JOIN v USING (lang)
    ), whole AS (
        SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL
    ), q AS (
        SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM whole JOIN v USING (lang)
    ), pair AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
                   FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
        ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
    ), term AS (
        SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
    ), every AS (
        SELECT * FROM pair UNION ALL SELECT * FROM term
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM every QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoalmap.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))
