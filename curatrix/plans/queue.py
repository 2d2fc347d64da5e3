"""The queue of deep reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import NOW, Tables
from ..operators import queue as ops
from ..registry import query

_STAMP = "'%Y-%m-%d %H:%M:%S'"
_WANT = """x AS (SELECT regexp_extract(advisory_text, '(?i)(GHSA(-[0-9a-z]{4}){3})', 1) AS g, * FROM b_candidates WHERE domain = 'security'),
wide AS (SELECT 'GHSA' || lower(substr(g, 5)) AS subject, id AS item_id, insight_score, doc_id FROM x WHERE g <> '' AND coalesce(insight_score, 0) >= 50)"""


def _shown(q):
    return q.select("subject", "item_id", "status", F.date_format("claimed_at", "yyyy-MM-dd HH:mm:ss").alias("claimed_at"), "worker_id", "attempt_count")


@query("queue_candidates", f"WITH {_WANT} SELECT subject, item_id, insight_score FROM wide ORDER BY coalesce(insight_score, 0) DESC, doc_id LIMIT 20")
def queue_candidates(t: Tables):
    return ops.candidates(t.table("b_candidates"), 50).select("subject", "item_id", "insight_score")


@query("queue_enqueue", f"""WITH {_WANT}, w AS (SELECT * FROM wide ORDER BY coalesce(insight_score, 0) DESC, doc_id LIMIT 20), l AS (SELECT subject, arg_max(item_id, doc_id) AS new_item FROM w GROUP BY subject)
SELECT coalesce(q.subject, l.subject) AS subject, CASE WHEN q.subject IS NULL OR (q.status = 'failed' AND l.subject IS NOT NULL) THEN l.new_item ELSE q.item_id END AS item_id,
  CASE WHEN q.subject IS NULL OR (q.status = 'failed' AND l.subject IS NOT NULL) THEN 'queued' ELSE q.status END AS status, strftime(q.claimed_at, {_STAMP}) AS claimed_at, q.worker_id, coalesce(q.attempt_count, 0) AS attempt_count
FROM b_deep_queue q FULL JOIN l ON l.subject = q.subject""")
def queue_enqueue(t: Tables):
    return _shown(ops.enqueue(t.queue.drop("doc_id"), ops.candidates(t.table("b_candidates"), 50), NOW))


@query("queue_stale", f"""
WITH o AS (SELECT *, status = 'running' AND claimed_at < TIMESTAMP '{NOW}' - to_hours(6) AS old FROM b_deep_queue)
SELECT subject, item_id, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN NOT coalesce(old, false) THEN strftime(claimed_at, {_STAMP}) END AS claimed_at, CASE WHEN NOT coalesce(old, false) THEN worker_id END AS worker_id, attempt_count FROM o""")
def queue_stale(t: Tables):
    return _shown(ops.reset_stale(t.queue, NOW))


@query("queue_claim", f"""
WITH c AS (SELECT subject FROM b_deep_queue WHERE status IN ('queued', 'failed') ORDER BY created_at, subject LIMIT 10)
SELECT q.subject, item_id, CASE WHEN c.subject IS NOT NULL THEN 'running' ELSE status END AS status, CASE WHEN c.subject IS NOT NULL THEN '{NOW}' ELSE strftime(claimed_at, {_STAMP}) END AS claimed_at,
  CASE WHEN c.subject IS NOT NULL THEN 'w9' ELSE worker_id END AS worker_id, attempt_count + CASE WHEN c.subject IS NOT NULL THEN 1 ELSE 0 END AS attempt_count FROM b_deep_queue q LEFT JOIN c ON c.subject = q.subject""")
def queue_claim(t: Tables):
    return _shown(ops.claim(t.queue, "w9", NOW, 10, retry_failed=True))


@query("queue_finalise", f"""
SELECT subject, item_id, CASE WHEN status = 'running' THEN CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'not_qualified' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN status <> 'running' THEN strftime(claimed_at, {_STAMP}) END AS claimed_at, CASE WHEN status <> 'running' THEN worker_id END AS worker_id, attempt_count FROM b_deep_queue""")
def queue_finalise(t: Tables):
    outcome = F.element_at(F.array(*map(F.lit, ("ok", "empty", "not_qualified", "failed"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _shown(ops.finalise(t.queue, t.queue.select("subject", outcome.alias("outcome"))))


@query("queue_tally", "SELECT status, count(*) AS n FROM b_deep_queue GROUP BY status")
def queue_tally(t: Tables):
    return t.queue.groupBy("status").agg(F.count("*").alias("n"))


@query("report_pending", "SELECT 'GHSA-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 5, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 4) AS stem FROM documents WHERE doc_id % 22 = 0 OR doc_id % 33 = 1 EXCEPT SELECT subject FROM b_deep_queue")
def report_pending(t: Tables):
    h = F.md5(F.col("doc_id").cast("string"))
    stem = F.concat(F.lit("GHSA-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 4), F.lit("-"), F.substring(h, 9, 4))
    names = t.table("documents").filter("doc_id % 22 = 0 OR doc_id % 33 = 1").select(stem.alias("stem")).distinct()
    return ops.pending(names, t.queue)


@query("report_upsert", "SELECT subject, CASE WHEN doc_id % 2 = 0 THEN 'report ' || doc_id ELSE NULL END AS report_md, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE status END AS status FROM b_deep_queue")
def report_upsert(t: Tables):
    stored = t.queue.select("subject", F.lit(None).cast("string").alias("report_md"), "status")
    new = t.queue.filter("doc_id % 2 = 0")
    reports = new.selectExpr("subject", "concat('draft ', doc_id) AS report_md", "'empty' AS status", "1 AS pos").unionByName(new.selectExpr("subject", "concat('report ', doc_id) AS report_md", "'ok' AS status", "2 AS pos"))
    return ops.upsert_reports(stored, reports)
