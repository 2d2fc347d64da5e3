"""Sources: eligibility, catalog merge, health and fetch statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import Tables
from ..functions.errors import fetch_error
from ..operators import sources as ops
from ..registry import query
from ..sources.readers import catalog
from ..sources.sinks import append_attempts
from ..storage import new_path


@query("eligible_sources", "SELECT id, domain FROM b_sources WHERE is_active AND status = 'approved' AND health <> 'disabled' AND domain IN ('security', 'ai')")
def eligible_sources(t: Tables):
    return ops.eligible(t.sources, ("security", "ai"), t.sources.filter("status = 'approved'")).select("id", "domain")


@query("source_listing", "SELECT id, name, domain, status, health FROM b_sources WHERE is_active AND domain IN ('security', 'ai') ORDER BY domain, name")
def source_listing(t: Tables):
    return t.sources.filter(F.col("is_active") & F.col("domain").isin("security", "ai")).select("id", "name", "domain", "status", "health").orderBy("domain", "name")


@query("source_lookup", "SELECT id, name, domain, authority FROM b_sources WHERE id = 'src4'")
def source_lookup(t: Tables):
    return t.sources.filter("id = 'src4'").select("id", "name", "domain", "authority")


@query("catalog_ids", "SELECT id, bool_or(status = 'approved') AS approved FROM b_sources GROUP BY id")
def catalog_ids(t: Tables):
    return t.sources.groupBy("id").agg(F.bool_or(F.col("status") == "approved").alias("approved"))


@query("source_parsers", """
SELECT id, CASE n % 6 WHEN 0 THEN 'nvd' WHEN 1 THEN 'github' WHEN 2 THEN 'hackernews' WHEN 3 THEN 'rss' WHEN 4 THEN 'api' END AS parser FROM b_sources""")
def source_parsers(t: Tables):
    named = t.sources.withColumn("type", F.element_at(F.array(*map(F.lit, ("NVD feed l1_api", "GitHub l1_api", "hackernews l1_api", "l1_rss", "l1_api", "manual"))), F.col("n") % 6 + 1))
    return named.select("id", ops.parser().alias("parser"))


@query("catalog_upsert", """
WITH c AS (SELECT id, concat('New ', name) AS name, CASE WHEN n % 2 = 0 THEN 'approved' ELSE 'candidate' END AS status FROM b_sources WHERE n % 3 <> 1
  UNION ALL SELECT concat(id, 'x'), concat('Added ', name), 'candidate' FROM b_sources WHERE n % 5 = 0)
SELECT coalesce(s.id, c.id) AS id, CASE WHEN c.id IS NULL THEN s.name ELSE c.name END AS name, CASE WHEN c.id IS NULL THEN s.status ELSE c.status END AS status,
  coalesce(s.health, 'good') AS health, coalesce(s.consecutive_failures, 0) AS consecutive_failures FROM b_sources s FULL JOIN c ON s.id = c.id""")
def catalog_upsert(t: Tables):
    changed = t.sources.filter("n % 3 <> 1").selectExpr("id", "concat('New ', name) AS name", "CASE WHEN n % 2 = 0 THEN 'approved' ELSE 'candidate' END AS status")
    added = t.sources.filter("n % 5 = 0").selectExpr("concat(id, 'x') AS id", "concat('Added ', name) AS name", "'candidate' AS status")
    return ops.upsert_catalog(t.sources.select("id", "name", "status", "health", "consecutive_failures"), changed.unionByName(added))


@query("health_fold", """
WITH r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source_id ORDER BY attempt_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b_fetch_attempts),
l AS (SELECT source_id, max(island) AS island FROM r GROUP BY source_id),
f AS (SELECT r.source_id, l.island, count(*) FILTER (WHERE NOT ok) AS failures, max(attempt_at) AS last_at FROM r JOIN l ON r.source_id = l.source_id AND r.island = l.island GROUP BY ALL),
g AS (SELECT f.source_id, f.last_at, f.failures + CASE WHEN f.island = 0 THEN s.consecutive_failures ELSE 0 END AS n FROM f JOIN b_sources s ON s.id = f.source_id)
SELECT source_id, CAST(n AS BIGINT) AS consecutive_failures, CASE WHEN n >= 3 THEN 'disabled' WHEN n > 0 THEN 'degraded' ELSE 'good' END AS health, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM g""")
def health_fold(t: Tables):
    initial = t.sources.select(F.col("id").alias("source_id"), "consecutive_failures")
    return ops.health_fold(t.attempts, initial).select("source_id", "consecutive_failures", "health", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("fetch_stats", """
SELECT run_id, source_id, CASE WHEN last(ok ORDER BY attempt_at, event_id) THEN 'succeeded' ELSE 'failed' END AS status, CAST(sum(n_items) AS BIGINT) AS items, round(last(duration_ds ORDER BY attempt_at, event_id) / 10, 3) AS duration_s,
  last(error ORDER BY attempt_at, event_id) AS error FROM b_fetch_attempts GROUP BY ALL""")
def fetch_stats(t: Tables):
    return ops.fetch_stats(t.attempts, ("run_id", "source_id"))


@query("feed_gate", """
WITH l AS (SELECT source_id, arg_max(ok, (attempt_at, event_id)) AS ok, arg_max(n_items, (attempt_at, event_id)) AS n FROM b_fetch_attempts GROUP BY source_id),
k AS (SELECT l.*, coalesce(s.type = 'internal_api', FALSE) AS skip FROM l LEFT JOIN b_sources s ON s.id = l.source_id)
SELECT count(*) FILTER (WHERE NOT skip AND ok AND n > 0) AS ok, count(*) FILTER (WHERE NOT skip AND ok AND n <= 0) AS empty, count(*) FILTER (WHERE NOT skip AND NOT ok) AS failed, count(*) FILTER (WHERE skip) AS skipped, count(*) FILTER (WHERE NOT skip AND ok AND n > 0) >= 3 AS passed FROM k""")
def feed_gate(t: Tables):
    return ops.feed_gate(t.attempts, 3, t.sources)


@query("fetch_error_classes", """
SELECT event_id, CASE failure WHEN 'timeout' THEN 'source_timeout' WHEN 'status' THEN CASE WHEN http_status IN (401, 403) THEN 'source_auth_error' ELSE 'source_http_error' END WHEN 'transport' THEN 'source_http_error' WHEN 'parse' THEN 'source_parse_error' END AS error FROM b_fetch_attempts""")
def fetch_error_classes(t: Tables):
    return t.attempts.select("event_id", fetch_error(F.col("failure"), F.col("http_status")).alias("error"))


@query("fetch_log", "SELECT source_id, count(*) AS attempts, CAST(sum(CAST(round(duration_ds / 10 * 1000) AS BIGINT)) AS BIGINT) AS milliseconds FROM b_fetch_attempts GROUP BY source_id")
def fetch_log(t: Tables):
    """Attempts are appended to the log, and the log is read."""
    path = new_path(t.spark, "log")
    append_attempts(t.attempts.select("source_id", "ok", "n_items", "error", (F.col("duration_ds") / 10 + 0.0001).alias("duration_s")), path)
    milliseconds = F.round(F.col("duration_s") * 1000).cast("long")
    return t.spark.read.parquet(path).groupBy("source_id").agg(F.count("*").alias("attempts"), F.sum(milliseconds).alias("milliseconds"))


@query("catalog_scan", """
SELECT id, CASE WHEN n % 4 = 0 THEN '' ELSE name END AS name, domain, type, url, authority, 'none' AS auth_mode, CASE WHEN n % 3 = 0 THEN 'candidate' ELSE status END AS status, TRUE AS is_active, CASE WHEN n % 4 = 0 THEN 'name,fetch_strategy' ELSE 'fetch_strategy' END AS missing FROM b_sources""")
def catalog_scan(t: Tables):
    """A catalog file, a JSON array, is written from the sources and read with its defaults."""
    entry = F.struct(F.concat(F.lit(" "), "id").alias("id"), F.when(F.col("n") % 4 != 0, F.col("name")).alias("name"), "domain", "type", "url", "authority", F.when(F.col("n") % 3 != 0, F.col("status")).alias("status"))
    path = new_path(t.spark, "catalog")
    t.sources.agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(path)
    return catalog(t.spark, path).select("id", F.coalesce("name", F.lit("")).alias("name"), "domain", "type", "url", "authority", "auth_mode", "status", "is_active", "missing")


@query("fetch_errors", "SELECT error, count(*) AS n FROM b_fetch_attempts WHERE NOT ok GROUP BY error")
def fetch_errors(t: Tables):
    return t.attempts.filter("NOT ok").groupBy("error").agg(F.count("*").alias("n"))


@query("table_quality", """
SELECT count(*) AS n, count(*) FILTER (WHERE id IS NULL OR trim(id) = '') AS missing_id, count(*) FILTER (WHERE name IS NULL OR trim(name) = '') AS missing_name,
  count(*) FILTER (WHERE domain NOT IN ('security', 'ai')) AS bad_domain, count(*) FILTER (WHERE health NOT IN ('good', 'degraded')) AS bad_health FROM b_sources""")
def table_quality(t: Tables):
    return ops.table_quality(t.sources, ("id", "name"), {"domain": ("security", "ai"), "health": ("good", "degraded")})


@query("domain_cap", """
SELECT batch_id, pos, source_id, domain, arrival FROM (
  SELECT r.batch_id, r.pos, r.source_id, s.domain, CAST(row_number() OVER (PARTITION BY s.domain ORDER BY r.batch_id, r.pos) AS INT) AS arrival FROM b_raw_items r JOIN b_sources s ON s.id = r.source_id) WHERE arrival <= 10""")
def domain_cap(t: Tables):
    joined = t.raw_items.join(t.sources.select(F.col("id").alias("source_id"), "domain"), "source_id")
    return ops.cap_per_domain(joined, 10, ("batch_id", "pos")).select("batch_id", "pos", "source_id", "domain", "arrival")
