"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, html_text, language, licenses, mixing, near_dup, secret_scan, toxicity, url_filter, vector_search
from veilframe.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def url_fixture(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch times and a dated list, which the tables lack, derived from page ids and hosts.

    Every host, parent domain and host with a first path part that occurs gets dated changes by digits of
    its MD5, as does one whole path in sixteen, of any depth.
    """
    captures = pages.select("page_id", "url", F.timestamp_add("DAY", F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366)).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("fetched_at"))
    host = url_filter.url_host(F.col("url"))
    parts = F.filter(F.split(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), "/"), lambda x: x != "")
    whole = F.concat(host, F.lit("/"), F.array_join(parts, "/"))
    paths = F.filter(F.array(F.concat(host, F.lit("/"), F.get(parts, F.lit(0))), F.when(F.md5(whole).startswith("0"), whole)), lambda x: x.isNotNull() & (host != "") & (F.size(parts) > 0))
    keys = pages.select(F.explode(F.concat(F.array(host, F.regexp_extract(host, r"\.(.+\..+)$", 1)), paths)).alias("key")).where("key <> ''").distinct()
    drawn = keys.withColumn("d", F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int"))
    first = F.col("d") % 200
    changes = F.array(
        F.when(F.col("d") % 3 == 0, F.struct(F.lit("block").alias("action"), first.alias("day"))),
        F.when(F.col("d") % 2 == 0, F.struct(F.lit("remove").alias("action"), (first + 60).alias("day"))),
        F.when(F.col("d") % 5 == 0, F.struct(F.lit("block").alias("action"), (first + 120).alias("day"))),
        F.when(F.col("d") % 7 == 0, F.struct(F.lit("allow").alias("action"), (first + 30).alias("day"))),
    )
    entries = drawn.select("key", F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("c"))
    return captures, entries.select("key", F.col("c.action").alias("action"), F.timestamp_add("DAY", F.col("c.day"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("at"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = url_fixture(table(spark, sf_dir, "pages"))
    found = url_filter.judged(captures, entries)
    seconds = [F.unix_timestamp(c).cast("long").alias(c) for c in ("fetched_at", "rule_since")]
    return found.select("page_id", "url", seconds[0], "verdict", "rule", seconds[1], "n_active")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(coalesce(page_id, 0) % 366 AS INTEGER)) AS ft,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
parts AS (
  SELECT page_id, url, ft, host, string_split(host, '.') AS labels,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM p),
keys AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM p UNION ALL SELECT regexp_extract(host, '\.(.+\..+)$', 1) FROM p
    UNION ALL SELECT host || '/' || segs[1] FROM parts WHERE len(segs) > 0 AND host <> ''
    UNION ALL SELECT k FROM (SELECT host || '/' || array_to_string(segs, '/') AS k FROM parts WHERE len(segs) > 0 AND host <> '') WHERE md5(k) LIKE '0%')
  WHERE key <> ''),
drawn AS (SELECT key, CAST(('0x' || substr(md5(key), 1, 4)) AS INTEGER) AS d FROM keys),
changes AS (
  SELECT key, 1 AS o, 'block' AS action, d % 200 AS day FROM drawn WHERE d % 3 = 0
  UNION ALL SELECT key, 3, 'remove', d % 200 + 60 FROM drawn WHERE d % 2 = 0
  UNION ALL SELECT key, 1, 'block', d % 200 + 120 FROM drawn WHERE d % 5 = 0
  UNION ALL SELECT key, 2, 'allow', d % 200 + 30 FROM drawn WHERE d % 7 = 0),
one AS (SELECT key, day, max_by(action, o) AS action FROM changes GROUP BY key, day),
spans AS (
  SELECT key, action, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS f,
         TIMESTAMP '2024-01-01' + to_days(CAST(lead(day) OVER (PARTITION BY key ORDER BY day) AS INTEGER)) AS t
  FROM one),
cand AS (
  SELECT DISTINCT page_id, url, ft, key FROM (
    SELECT page_id, url, ft, host AS key FROM parts
    UNION ALL SELECT page_id, url, ft, array_to_string(labels[i:], '.') FROM parts, unnest(generate_series(2, len(labels) - 1)) g(i)
    UNION ALL SELECT page_id, url, ft, host || '/' || array_to_string(segs[1:i], '/') FROM parts, unnest(generate_series(1, len(segs))) g(i))
  WHERE key NOT LIKE '/%' AND key <> ''),
act AS (
  SELECT c.page_id, c.url, c.ft, c.key, s.action, s.f FROM cand c JOIN spans s ON c.key = s.key
  WHERE s.action <> 'remove' AND s.f <= c.ft AND (s.t IS NULL OR c.ft < s.t)),
best AS (
  SELECT page_id, url, ft, count(*) AS n, max({'n': length(key), 'key': key, 'action': action, 'f': f}) AS b FROM act GROUP BY ALL)
SELECT p.page_id, p.url, CAST(epoch(p.ft) AS BIGINT) AS fetched_at, coalesce(b.b.action, 'none') AS verdict, b.b.key AS rule,
       CAST(epoch(b.b.f) AS BIGINT) AS rule_since, CAST(coalesce(b.n, 0) AS BIGINT) AS n_active
FROM p LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.url IS NOT DISTINCT FROM b.url AND p.ft = b.ft
"""


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), every=50)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_url_filter, op3_simhash_golay, op4_ivf_pq, op5_toxicity, op6_language, op7_licenses, op8_secrets, op9_html_text, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL}
