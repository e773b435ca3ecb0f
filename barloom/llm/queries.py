"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wide_sql import CLUSTERING, CONTAMINATION, DIVERGENCE


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .bpe import digest

    return digest(_read(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls, rules_frame

    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    return judge_urls(_read(spark, sf_dir, "pages"), rules_frame(spark, rules))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learned, predict

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = learned(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import find_secrets

    found = find_secrets(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    found = find_personal_data(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sizes

    return mix_sizes(_read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import export_and_read

    return export_and_read(_read(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exactdedup import exact_duplicates

    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize
    from .media import digest, store

    return digest(materialize(store(_read(spark, sf_dir, "documents")), "media", "zstd"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_read(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import find_contamination

    found = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    found = cluster(_read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_url_filter, op4_langid, op5_secret_scan, op6_pii, op7_mixing, op8_warc, op9_exact_dedup, op10_media, op11_divergence, op12_decontamination, op13_centroids)}

#: Links that pages declare are left out here (the pages of the tables declare none); the tests hold them against a loop.
_URL_SQL = r"""
    WITH RECURSIVE u AS (
        SELECT page_id, coalesce(contains(url, '://'), false) AS good,
               translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query,
               coalesce(regexp_matches(url, '(?s)^.*?://[^?#]*\?'), false) AS asks
        FROM pages),
    n AS (SELECT *, CASE WHEN good THEN host || path || CASE WHEN asks THEN '?' || query ELSE '' END END AS node,
                 regexp_replace(host || path || CASE WHEN asks THEN '?' || array_to_string(list_filter(string_split(query, '&'), lambda x: NOT regexp_matches(x, '^(utm_\w+|gclid|fbclid)=')), '&') ELSE '' END, '[?&]+$', '') AS bare FROM u),
    e AS (SELECT node AS a, bare AS b FROM n WHERE good AND node <> bare),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(node, other) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON r.other = s.a),
    rules(action, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    places AS (SELECT host, path FROM n UNION SELECT regexp_extract(other, '(?s)^([^/?#]*)', 1), regexp_extract(other, '(?s)^[^/?#]*([^?#]*)', 1) FROM reach),
    fits AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
             FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
    class AS (SELECT r.node, bool_or(f.action = 'block') AND NOT coalesce(bool_or(f.action = 'allow'), false) AS blocked
              FROM reach r JOIN fits f ON f.host = regexp_extract(r.other, '(?s)^([^/?#]*)', 1) AND f.path = regexp_extract(r.other, '(?s)^[^/?#]*([^?#]*)', 1) GROUP BY r.node)
    SELECT page_id, n.host, n.path, f.rule, coalesce(f.action, CASE WHEN c.blocked THEN 'block' END, 'allow') AS verdict
    FROM n LEFT JOIN fits f ON n.host = f.host AND n.path = f.path LEFT JOIN class c ON n.node = c.node
"""

SQL = {
    "op3_url_filter": _URL_SQL,
    "op7_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
                     row_number() OVER (ORDER BY source NULLS LAST) AS place, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM s),
        o AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                     sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
        l AS (SELECT *, max(CASE WHEN most > (goal - filled) / open * weight THEN (goal - filled) / open END) OVER () AS level,
                     most <= (goal - filled) / open * weight AS capped FROM o),
        t AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE least(most, level * weight) END AS target FROM l),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate))::INT))::BIGINT AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT h, max(page_id) AS head FROM p WHERE strlen(h) >= 1000 GROUP BY h)
        SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
               CASE WHEN g.head <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.head <> p.page_id THEN g.head END AS refers_to
        FROM p LEFT JOIN g ON p.h = g.h
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op11_divergence": DIVERGENCE,
    "op12_decontamination": CONTAMINATION,
    "op13_centroids": CLUSTERING,
}
