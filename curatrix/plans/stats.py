"""Statistics over items, scores and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import TODAY, Tables
from ..functions import scores
from ..functions.times import iso
from ..operators import stats as ops
from ..registry import query
from ..sources import retention
from ..storage import new_path


@query("day_rollup", f"""
SELECT domain, CAST(count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}') AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}' AND insight_score >= 75) AS BIGINT) AS high_value,
  CAST(count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}' AND stage1_error IS NOT NULL) AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}') - count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{TODAY}' - 1) AS BIGINT) AS delta
FROM b_items WHERE domain IN ('security', 'ai') AND source_id IN (SELECT id FROM b_sources)
  AND fetched_at >= DATE '{TODAY}' - 1 AND fetched_at < DATE '{TODAY}' + 1
GROUP BY domain""")
def day_rollup(t: Tables):
    return ops.day_rollup(ops.visible_items(t.items, t.sources, ("security", "ai")), TODAY)


@query("source_health_rollup", """
SELECT CAST(count(*) FILTER (WHERE status = 'approved') AS BIGINT) AS approved, CAST(count(*) FILTER (WHERE status = 'candidate') AS BIGINT) AS candidate,
  CAST(count(*) FILTER (WHERE health = 'good') AS BIGINT) AS good, CAST(count(*) FILTER (WHERE health = 'degraded') AS BIGINT) AS degraded,
  CAST(count(*) FILTER (WHERE health = 'disabled') AS BIGINT) AS disabled
FROM b_sources WHERE is_active AND domain IN ('security', 'ai')""")
def source_health_rollup(t: Tables):
    return ops.health_rollup(t.sources.filter(F.col("is_active") & F.col("domain").isin("security", "ai")))


@query("category_counts", "SELECT category, count(*) AS n FROM b_items WHERE category IS NOT NULL GROUP BY category")
def category_counts(t: Tables):
    return ops.counts(t.items, "category")


@query("confidence_counts", "SELECT confidence, count(*) AS n FROM b_items WHERE confidence IS NOT NULL GROUP BY confidence")
def confidence_counts(t: Tables):
    return ops.counts(t.items, "confidence")


@query("confidence_shares", """
SELECT round(count(*) FILTER (WHERE confidence = 'confirmed') * 1.0 / nullif(count(confidence), 0), 6) AS confirmed,
  round(count(*) FILTER (WHERE confidence = 'firm') * 1.0 / nullif(count(confidence), 0), 6) AS firm,
  round(count(*) FILTER (WHERE confidence = 'tentative') * 1.0 / nullif(count(confidence), 0), 6) AS tentative FROM b_items""")
def confidence_shares(t: Tables):
    return ops.confidence_shares(t.items)


@query("score_histogram", """
SELECT b.bucket, CAST(count(i.id) AS BIGINT) AS n FROM (SELECT CAST(unnest(range(20)) AS INT) AS bucket) b
LEFT JOIN b_items i ON CAST(floor(least(greatest(i.insight_score, 0), 99) / 5) AS INT) = b.bucket AND i.insight_score IS NOT NULL GROUP BY b.bucket""")
def score_histogram(t: Tables):
    return ops.histogram(t.items)


_RETENTION = "CASE WHEN insight_score < 10 THEN 'delete' WHEN insight_score < 30 THEN '5_days' WHEN insight_score < 50 THEN '10_days' WHEN insight_score < 75 THEN '30_days' ELSE 'permanent' END"


@query("retention_counts", f"SELECT {_RETENTION} AS retention, count(*) AS n FROM b_items WHERE insight_score IS NOT NULL GROUP BY 1")
def retention_counts(t: Tables):
    return ops.retention_counts(t.items)


@query("retention_from_histogram", f"SELECT {_RETENTION} AS retention, CAST(count(*) AS BIGINT) AS n FROM b_items WHERE insight_score IS NOT NULL GROUP BY 1")
def retention_from_histogram(t: Tables):
    return ops.retention_from_histogram(ops.histogram(t.items))


@query("retention_shares", f"""
SELECT {_RETENTION} AS retention, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM b_items), 6) AS ratio
FROM b_items WHERE insight_score IS NOT NULL GROUP BY 1""")
def retention_shares(t: Tables):
    return ops.retention_shares(t.items)


@query("score_cuts", """
SELECT CAST(count(*) FILTER (WHERE insight_score >= 30) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE insight_score >= 75) AS BIGINT) AS stage2,
  CAST(count(*) FILTER (WHERE coalesce(insight_score, 0) < 30) AS BIGINT) AS dropped FROM b_items""")
def score_cuts(t: Tables):
    return ops.score_cuts(t.items)


@query("score_range", "SELECT id, insight_score FROM b_items WHERE insight_score >= 40 AND insight_score < 60")
def score_range(t: Tables):
    return ops.score_range(t.items, 40, 60).select("id", "insight_score")


@query("item_summary", """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE domain = 'security') AS BIGINT) AS security, CAST(count(*) FILTER (WHERE domain = 'ai') AS BIGINT) AS ai,
  CAST(count(*) FILTER (WHERE domain = 'finance') AS BIGINT) AS finance, CAST(count(*) FILTER (WHERE insight_score >= 75) AS BIGINT) AS high_value,
  CAST(count(*) FILTER (WHERE confidence = 'confirmed') AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE confidence = 'firm') AS BIGINT) AS firm,
  CAST(count(*) FILTER (WHERE confidence = 'tentative') AS BIGINT) AS tentative FROM b_items""")
def item_summary(t: Tables):
    return ops.item_summary(t.items)


@query("category_matrix", """
WITH m AS (SELECT category, CASE WHEN insight_score < 10 THEN '0-9' WHEN insight_score < 30 THEN '10-29' WHEN insight_score < 50 THEN '30-49' WHEN insight_score < 75 THEN '50-74' ELSE '75-100' END AS band
  FROM b_items WHERE category IS NOT NULL AND category <> 'other' AND insight_score IS NOT NULL),
c AS (SELECT category, band, count(*) AS n FROM m GROUP BY ALL)
SELECT category, CAST(coalesce(sum(n) FILTER (WHERE band = '0-9'), 0) AS BIGINT) AS b0_9, CAST(coalesce(sum(n) FILTER (WHERE band = '10-29'), 0) AS BIGINT) AS b10_29,
  CAST(coalesce(sum(n) FILTER (WHERE band = '30-49'), 0) AS BIGINT) AS b30_49, CAST(coalesce(sum(n) FILTER (WHERE band = '50-74'), 0) AS BIGINT) AS b50_74,
  CAST(coalesce(sum(n) FILTER (WHERE band = '75-100'), 0) AS BIGINT) AS b75_100, (SELECT greatest(1, max(n)) FROM c) AS max_n FROM c GROUP BY category""")
def category_matrix(t: Tables):
    return ops.category_matrix(t.items)


@query("category_list", """
SELECT category, count(*) AS n, arg_min(domain, doc_id) AS domain, max(count(*)) OVER () AS max_n FROM b_items WHERE category IS NOT NULL GROUP BY category""")
def category_list(t: Tables):
    return ops.category_list(t.items, "doc_id")


@query("source_today", f"SELECT source_id, count(*) AS n FROM b_items WHERE fetched_at >= DATE '{TODAY}' GROUP BY source_id")
def source_today(t: Tables):
    return ops.source_today(t.items, TODAY)


@query("source_spark", f"""
WITH days AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 13, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT source_id, CAST(fetched_at AS DATE) AS day, count(*) AS n FROM b_items GROUP BY ALL),
t AS (SELECT source_id, count(*) AS n FROM b_items WHERE fetched_at >= DATE '{TODAY}' GROUP BY source_id)
SELECT s.id, s.name, s.domain, s.type, s.url, s.authority, s.status, s.health, s.consecutive_failures, s.is_active, strftime(any_value(s.last_fetch_at), '%Y-%m-%dT%H:%M:%S+00:00') AS last_fetch_at, any_value(s.last_fetch_status) AS last_fetch_status, any_value(coalesce(t.n, 0)) AS today_items, string_agg(CAST(coalesce(c.n, 0) AS VARCHAR), ',' ORDER BY days.day) AS spark
FROM b_sources s CROSS JOIN days LEFT JOIN c ON c.source_id = s.id AND c.day = days.day LEFT JOIN t ON t.source_id = s.id
WHERE s.is_active GROUP BY s.id, s.name, s.domain, s.type, s.url, s.authority, s.status, s.health, s.consecutive_failures, s.is_active""")
def source_spark(t: Tables):
    views = ops.source_views(t.sources.filter("is_active"), t.items, TODAY)
    return views.select("id", "name", "domain", "type", "url", "authority", "status", "health", "consecutive_failures", "is_active", iso(F.col("last_fetch_at")).alias("last_fetch_at"), "last_fetch_status", F.col("today").alias("today_items"), F.array_join("spark", ",").alias("spark")).orderBy("domain", "name")


@query("source_summary", f"""
WITH c AS (SELECT source_id, CAST(fetched_at AS DATE) AS day, count(*) AS n FROM b_items WHERE fetched_at >= DATE '{TODAY}' - 13 AND fetched_at < DATE '{TODAY}' + 1 GROUP BY ALL)
SELECT CAST(count(*) FILTER (WHERE status = 'approved') AS BIGINT) AS approved, CAST(count(*) FILTER (WHERE status = 'candidate') AS BIGINT) AS candidate,
  CAST(count(*) FILTER (WHERE health = 'good') AS BIGINT) AS good, CAST(count(*) FILTER (WHERE health = 'degraded') AS BIGINT) AS degraded, CAST(count(*) FILTER (WHERE health = 'disabled') AS BIGINT) AS disabled,
  greatest(1, (SELECT max(n) FROM c)) AS max_spark FROM b_sources""")
def source_summary(t: Tables):
    return ops.source_summary(t.sources, t.items, TODAY)


@query("analysis_backlog", "SELECT id, stage1_error FROM b_items WHERE analysis_stage = 0")
def analysis_backlog(t: Tables):
    return t.items.filter("analysis_stage = 0").select("id", "stage1_error")


@query("expiry", """
SELECT id, CASE WHEN insight_score < 10 THEN 'delete' WHEN insight_score < 30 THEN '5_days' WHEN insight_score < 50 THEN '10_days' WHEN insight_score < 75 THEN '30_days' WHEN insight_score IS NOT NULL THEN 'permanent' END AS retention,
  strftime(CASE WHEN insight_score < 10 THEN stage1_analyzed_at WHEN insight_score < 30 THEN stage1_analyzed_at + to_days(5) WHEN insight_score < 50 THEN stage1_analyzed_at + to_days(10)
    WHEN insight_score < 75 THEN stage1_analyzed_at + to_days(30) END, '%Y-%m-%d %H:%M:%S') AS expires FROM b_items""")
def expiry(t: Tables):
    at = scores.expires_at(F.col("insight_score"), F.col("stage1_analyzed_at"))
    return t.items.select("id", scores.retention_bucket(F.col("insight_score")).alias("retention"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("retention_delete", f"""
WITH e AS (SELECT id, CASE WHEN insight_score < 10 THEN stage1_analyzed_at WHEN insight_score < 30 THEN stage1_analyzed_at + to_days(5) WHEN insight_score < 50 THEN stage1_analyzed_at + to_days(10)
    WHEN insight_score < 75 THEN stage1_analyzed_at + to_days(30) END AS x FROM b_items)
SELECT id FROM e WHERE x IS NULL OR x >= TIMESTAMP '{TODAY} 00:00:00'""")
def retention_delete(t: Tables):
    dated = t.items.withColumn("expires_at", scores.expires_at(F.col("insight_score"), F.col("stage1_analyzed_at")))
    return ops.retain(dated, f"{TODAY} 00:00:00").select("id")


_EXPIRING = """e AS (SELECT id, CASE WHEN insight_score < 10 THEN stage1_analyzed_at WHEN insight_score < 30 THEN stage1_analyzed_at + to_days(5) WHEN insight_score < 50 THEN stage1_analyzed_at + to_days(10)
    WHEN insight_score < 75 THEN stage1_analyzed_at + to_days(30) END AS x FROM b_items)"""
#: A cutoff within a day, so that one folder is written anew.
_CUTOFF = "2024-01-20 09:30:00"


def _placed(t: Tables) -> str:
    path = new_path(t.spark, "by-expiry")
    retention.write_by_expiry(t.items.select("id", "insight_score", "stage1_analyzed_at").withColumn("expires_at", scores.expires_at(F.col("insight_score"), F.col("stage1_analyzed_at"))), path)
    return path


@query("retention_by_folder", f"WITH {_EXPIRING} SELECT id FROM e WHERE x IS NULL OR x >= TIMESTAMP '{_CUTOFF}'")
def retention_by_folder(t: Tables):
    """What is left of a table that lies by the day of expiry, after its expired folders were dropped."""
    path = _placed(t)
    retention.drop_expired(t.spark, path, _CUTOFF)
    return retention.read_by_expiry(t.spark, path).select("id")


@query("retention_deleted", f"WITH {_EXPIRING} SELECT strftime(x, '%Y-%m-%d') AS day, count(*) AS deleted FROM e WHERE x < TIMESTAMP '{_CUTOFF}' GROUP BY 1")
def retention_deleted(t: Tables):
    """How many items each day lost, by the footers of the files that went."""
    return retention.drop_expired(t.spark, _placed(t), _CUTOFF)
