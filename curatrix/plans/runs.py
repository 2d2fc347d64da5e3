"""Runs: windows, progress, status, documents and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import NOW, Tables
from ..operators import runs as ops
from ..operators.digest import file_name
from ..operators.sources import fetch_stats
from ..registry import query
from ..sources.readers import posts_in
from ..sources.sinks import append_runs, write_text_files
from ..storage import new_path

_DIGEST = """CASE WHEN digest_security = 'succeeded' OR digest_ai = 'succeeded' THEN CASE WHEN digest_security = 'failed' OR digest_ai = 'failed' THEN 'partial' ELSE 'succeeded' END ELSE 'failed' END"""


@query("run_window", f"SELECT strftime(coalesce(max(window_end) FILTER (WHERE status = 'succeeded'), TIMESTAMP '{NOW}' - to_hours(24)), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(TIMESTAMP '{NOW}', '%Y-%m-%d %H:%M:%S') AS window_end FROM b_runs WHERE started_at <= TIMESTAMP '{NOW}'")
def run_window(t: Tables):
    window = ops.run_window(t.runs.filter(F.col("started_at") <= F.lit(NOW).cast("timestamp_ntz")), NOW)
    return window.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in window.columns))


@query("digest_status", f"SELECT id, {_DIGEST} AS digest_status FROM b_runs")
def digest_status(t: Tables):
    results = t.runs.select("id", F.explode(F.array("digest_security", "digest_ai")).alias("status"))
    return ops.digest_status(results, "id")


@query("run_cards", """
SELECT id, sources_ok AS fetched_ok, sources_total AS fetched_total, sources_failed AS fetched_failed,
  CASE WHEN stage1_total = 0 THEN 'pending' WHEN stage1_ok = 0 THEN 'fail' WHEN stage1_failed > 0 THEN 'warn' ELSE 'ok' END AS stage1_state,
  CASE WHEN stage2_total = 0 THEN 'pending' WHEN stage2_ok = 0 THEN 'fail' WHEN stage2_failed > 0 THEN 'warn' ELSE 'ok' END AS stage2_state FROM b_runs""")
def run_cards(t: Tables):
    running = F.col("status") == "running"
    return t.runs.select("id", F.col("sources_ok").alias("fetched_ok"), F.col("sources_total").alias("fetched_total"), F.col("sources_failed").alias("fetched_failed"), *(ops.step_state(F.col(f"{k}_total"), F.col(f"{k}_ok"), F.col(f"{k}_failed"), running).alias(f"{k}_state") for k in ("stage1", "stage2")))


@query("run_sources", """
SELECT CAST(a.day AS VARCHAR) AS day, a.source_id, coalesce(s.name, a.source_id) AS name, a.items, a.ok, a.failed FROM (
  SELECT CAST(attempt_at AS DATE) AS day, source_id, CAST(sum(n_items) AS BIGINT) AS items, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed FROM b_fetch_attempts GROUP BY ALL) a
LEFT JOIN b_sources s ON s.id = a.source_id""")
def run_sources(t: Tables):
    by = t.attempts.groupBy(F.to_date("attempt_at").cast("string").alias("day"), "source_id").agg(F.sum("n_items").alias("items"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return by.join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left").withColumn("name", F.coalesce("name", "source_id"))


@query("run_listing", "SELECT id, status FROM b_runs ORDER BY started_at DESC LIMIT 10")
def run_listing(t: Tables):
    return t.runs.orderBy(F.desc("started_at"), "id").limit(10).select("id", "status")


@query("model_usage", "SELECT id, stage1_ok, stage2_ok FROM (SELECT * FROM b_runs ORDER BY started_at DESC LIMIT 4) ORDER BY started_at")
def model_usage(t: Tables):
    return t.runs.orderBy(F.desc("started_at")).limit(4).orderBy("started_at").select("id", "stage1_ok", "stage2_ok")


@query("active_run", "SELECT id, status FROM b_runs ORDER BY (status = 'running') DESC, started_at DESC LIMIT 1")
def active_run(t: Tables):
    return t.runs.orderBy(F.desc(F.col("status") == "running"), F.desc("started_at")).limit(1).select("id", "status")


@query("run_extremes", "SELECT min(id) FILTER (WHERE status = 'running') AS oldest_running, arg_max(id, window_end) FILTER (WHERE status = 'succeeded') AS latest_succeeded FROM b_runs")
def run_extremes(t: Tables):
    c = F.col("status")
    return t.runs.agg(F.min_by(F.when(c == "running", F.col("id")), F.when(c == "running", F.col("started_at"))).alias("oldest_running"), F.max_by(F.when(c == "succeeded", F.col("id")), F.when(c == "succeeded", F.col("window_end"))).alias("latest_succeeded"))


@query("stale_runs", """
SELECT id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-02-10 00:00:00' - to_hours(12) THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-02-10 00:00:00' - to_hours(12) THEN 'stale_timeout' END AS error,
  status = 'running' AND started_at >= TIMESTAMP '2024-02-10 00:00:00' - to_hours(12) AS blocks FROM b_runs""")
def stale_runs(t: Tables):
    return ops.stale(t.runs, "2024-02-10 00:00:00").select("id", "status", "error", "blocks")


def _digest_results(t: Tables):
    """What each run says of its two digests."""
    name = lambda d: F.concat(F.lit(f"intelligence-{d}-"), F.col("day").cast("string"), F.lit(".md"))
    one = lambda d: F.struct(F.lit(d).alias("domain"), F.col(f"digest_{d}").alias("status"), F.col(f"digest_{d}_id").alias("digest_id"), F.when(F.col(f"digest_{d}") == "succeeded", name(d)).alias("hexo_path"), F.lit(None).cast("string").alias("oss_url"), F.when(F.col(f"digest_{d}") == "failed", "digest_error").alias("error"))
    return t.runs.select(F.col("id").alias("run_id"), F.explode(F.array(one("security"), one("ai"))).alias("x")).select("run_id", "x.*")


def _documents(t: Tables):
    """The runs' documents. Every run was also started with a source that never answered."""
    started = t.attempts.groupBy("run_id").agg(F.array_append(F.collect_set("source_id"), F.lit("silent")).alias("source_ids"))
    runs = t.runs.join(started.withColumnRenamed("run_id", "id"), "id", "left")
    return ops.stats_document(runs, fetch_stats(t.attempts, ("run_id", "source_id")), _digest_results(t))


def _text(value: str) -> str:
    return f"""coalesce('"' || {value} || '"', 'null')"""


_DIGEST_JSON = "'{{\"status\":\"' || digest_{d} || '\",\"digest_id\":' || " + _text("digest_{d}_id") + " || ',\"hexo_path\":' || " + _text("CASE WHEN digest_{d} = 'succeeded' THEN 'intelligence-{d}-' || CAST(r.day AS VARCHAR) || '.md' END") + " || ',\"oss_url\":null,\"error\":' || " + _text("CASE WHEN digest_{d} = 'failed' THEN 'digest_error' END") + " || '}}'"
_DOCUMENTS = f"""s AS (SELECT run_id, source_id, CASE WHEN last(ok ORDER BY attempt_at, event_id) THEN 'succeeded' ELSE 'failed' END AS status, CAST(sum(n_items) AS BIGINT) AS items, round(last(duration_ds ORDER BY attempt_at, event_id) / 10, 3) AS duration_s, last(error ORDER BY attempt_at, event_id) AS error FROM b_fetch_attempts GROUP BY ALL
  UNION ALL SELECT DISTINCT run_id, 'silent', 'pending', 0, 0.0, NULL FROM b_fetch_attempts),
m AS (SELECT run_id, string_agg('"' || source_id || '":{{"status":"' || status || '","items":' || items || ',"duration_s":' || CAST(CAST(duration_s AS DOUBLE) AS VARCHAR) || coalesce(',"error":"' || error || '"', '') || '}}', ',' ORDER BY source_id) AS body FROM s GROUP BY run_id),
doc AS (SELECT r.id, '{{"sources":{{' || m.body || '}},"stage1":{{"total":' || stage1_total || ',"succeeded":' || stage1_ok || ',"failed":' || stage1_failed || '}},"stage2":{{"total":' || stage2_total || ',"succeeded":' || stage2_ok || ',"failed":' || stage2_failed
  || '}},"dedup_skipped":' || dedup_skipped || ',"retention_deleted":' || retention_deleted || ',"digest":{{"status":"' || {_DIGEST} || '","security":' || {_DIGEST_JSON.format(d="security")} || ',"ai":' || {_DIGEST_JSON.format(d="ai")} || '}}}}' AS stats_json FROM b_runs r JOIN m ON m.run_id = r.id)"""


@query("run_stats_document", f"WITH {_DOCUMENTS} SELECT id, stats_json FROM doc")
def run_stats_document(t: Tables):
    return _documents(t)


#: The rules on what the documents hold: every source counts, those of a run that never answered are not done; of stage one and two, what succeeded.
_TOLD = f"""q AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status IN ('succeeded', 'failed', 'skipped')) AS done, count(*) FILTER (WHERE status = 'succeeded') AS ok, count(*) FILTER (WHERE status = 'failed') AS bad FROM s GROUP BY run_id),
p AS (SELECT r.id, round(CAST(0.3 AS DOUBLE) * (q.done / q.total) + CAST(0.4 AS DOUBLE) * CASE WHEN stage1_total = 0 THEN 0 ELSE stage1_ok / stage1_total END + CAST(0.2 AS DOUBLE) * CASE WHEN stage2_total = 0 THEN 0 ELSE stage2_ok / stage2_total END + CAST(0.1 AS DOUBLE) * CASE WHEN {_DIGEST} IN ('succeeded', 'partial') THEN 1 ELSE 0 END, 2) AS progress,
  CASE WHEN r.status = 'failed' OR q.ok = 0 OR (stage1_total > 0 AND stage1_ok = 0) OR {_DIGEST} = 'failed' THEN 'failed' WHEN q.bad > 0 OR stage1_failed > 0 OR stage2_failed > 0 OR {_DIGEST} = 'partial' THEN 'partial' WHEN {_DIGEST} = 'succeeded' THEN 'succeeded' ELSE 'partial' END AS final_status
  FROM b_runs r JOIN q ON q.run_id = r.id)"""


@query("run_progress", f"WITH {_DOCUMENTS}, {_TOLD} SELECT id, progress FROM p")
def run_progress(t: Tables):
    return ops.from_documents(_documents(t)).select("id", "progress")


@query("run_status", f"WITH {_DOCUMENTS}, {_TOLD} SELECT id, final_status FROM p")
def run_status(t: Tables):
    runs = t.runs.select("id", "status").join(_documents(t), "id")
    return ops.status_from_documents(runs, F.when(F.col("status") == "failed", "error"), F.lit(True))


@query("run_document_sources", f"WITH {_DOCUMENTS} SELECT run_id AS id, source_id, status, items, CAST(duration_s AS DOUBLE) AS duration_s, error FROM s")
def run_document_sources(t: Tables):
    return ops.document_sources(_documents(t))


@query("run_views", f"WITH {_DOCUMENTS}, {_TOLD} SELECT r.id, r.kind, r.status, " + ", ".join(f"strftime(r.{c}, '%Y-%m-%dT%H:%M:%S+00:00') AS {c}" for c in ("window_start", "window_end", "started_at", "finished_at")) + ", p.progress, doc.stats_json FROM b_runs r JOIN p ON p.id = r.id LEFT JOIN doc ON doc.id = r.id")
def run_views(t: Tables):
    return ops.view(t.runs.join(_documents(t), "id", "left"))


@query("run_lookup", "SELECT id, kind, status FROM b_runs WHERE id = 'run-2024-01-05'")
def run_lookup(t: Tables):
    return t.runs.filter("id = 'run-2024-01-05'").select("id", "kind", "status")


@query("runs_finished", """
SELECT id, CASE WHEN status = 'running' THEN 'succeeded' ELSE status END AS status, strftime(CASE WHEN status = 'running' THEN TIMESTAMP '2024-02-10 00:00:00' ELSE finished_at END, '%Y-%m-%d %H:%M:%S') AS finished_at, CASE WHEN status = 'running' THEN '{}' END AS stats_json FROM b_runs""")
def runs_finished(t: Tables):
    """Runs are appended as they start; the one that is still running ends."""
    path = new_path(t.spark, "runs")
    none = F.lit(None).cast("string")
    append_runs(t.runs.select("id", "status", "finished_at", none.alias("stats_json"), none.alias("error_json")), path)
    log = t.spark.read.parquet(path)
    ends = log.filter("status = 'running'").select("id", F.lit("succeeded").alias("status"), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz").alias("finished_at"), F.lit("{}").alias("stats_json"), none.alias("error_json"))
    return ops.finish(log, ends).select("id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), "stats_json")


def _domain_errors(d: str, made: str) -> str:
    return f"""CASE WHEN {made} IS NULL THEN 'missing_digest:{d}' END, CASE WHEN {made} IS NOT NULL AND digest_{d} <> 'succeeded' THEN 'digest_not_succeeded:{d}' END, CASE WHEN {made} IS NOT NULL AND digest_{d}_id <> {made} THEN 'digest_id_mismatch:{d}' END"""


_AUDIT = f"""i AS (SELECT run_id, count(*) AS items, count(*) FILTER (WHERE analysis_stage >= 1) AS analysed FROM b_items GROUP BY 1),
d AS (SELECT run_id, count(DISTINCT domain) AS digests, max(id) FILTER (WHERE domain = 'security') AS sid, max(id) FILTER (WHERE domain = 'ai') AS aid FROM b_digests WHERE n_items > 1 GROUP BY 1)
SELECT l.id, l.status, coalesce(items, 0) AS items, coalesce(analysed, 0) AS analysed, coalesce(digests, 0) AS digests,
  concat_ws(',', CASE WHEN l.status <> 'succeeded' THEN 'run_status_' || l.status END, CASE WHEN coalesce(items, 0) < 30 THEN 'items_below_min:' || coalesce(items, 0) || '<30' END, CASE WHEN coalesce(analysed, 0) < 20 THEN 'analyzed_below_min:' || coalesce(analysed, 0) || '<20' END,
    CASE WHEN coalesce(digests, 0) < 2 THEN 'digests_below_min:' || coalesce(digests, 0) || '<2' END, {_domain_errors("security", "sid")}, {_domain_errors("ai", "aid")}) AS errors
FROM l LEFT JOIN i ON i.run_id = l.id LEFT JOIN d ON d.run_id = l.id"""


def _audited(t: Tables, runs):
    digests = t.table("b_digests").select("run_id", "domain", "id", (F.col("n_items") > 1).alias("has_content"))
    return ops.audit(runs, t.items, digests, _digest_results(t), 30, 20, 2)


@query("run_audit", f"WITH l AS (SELECT * FROM b_runs WHERE finished_at IS NOT NULL ORDER BY finished_at DESC, id LIMIT 1), {_AUDIT}")
def run_audit(t: Tables):
    return _audited(t, ops.latest_finished(t.runs))


@query("run_audits", f"WITH l AS (SELECT * FROM b_runs WHERE finished_at IS NOT NULL), {_AUDIT}")
def run_audits(t: Tables):
    return _audited(t, t.runs.filter("finished_at IS NOT NULL"))


def _post(d: str, made: str) -> str:
    return f"CASE WHEN strpos({made}, '-1') > 0 AND {made} LIKE '%0:{d}' THEN 'missing_hexo_file:intelligence-{d}-' || split_part({made}, ':', 1) || '.md' END"


@query("run_audits_posts", f"WITH l AS (SELECT * FROM b_runs WHERE finished_at IS NOT NULL), {_AUDIT}".replace(_domain_errors("security", "sid"), f"{_domain_errors('security', 'sid')}, {_post('security', 'sid')}").replace(_domain_errors("ai", "aid"), f"{_domain_errors('ai', 'aid')}, {_post('ai', 'aid')}"))
def run_audits_posts(t: Tables):
    """The posts folder lacks the digests of days whose number ends in a zero, in months or days that have a one after a dash."""
    digests = t.table("b_digests")
    path = new_path(t.spark, "posts")
    kept = digests.filter(~(F.col("id").contains("-1") & F.split("id", ":")[0].endswith("0")))
    write_text_files(kept.select(file_name(F.col("domain"), F.col("day")).alias("file"), F.col("id").alias("content")), path)
    found = digests.select("run_id", "domain", "id", "day", (F.col("n_items") > 1).alias("has_content"))
    return ops.audit(t.runs.filter("finished_at IS NOT NULL"), t.items, found, _digest_results(t), 30, 20, 2, posts=posts_in(t.spark, path))


@query("run_totals", """
SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n_items) AS BIGINT) AS collected, count(DISTINCT source_id) FILTER (WHERE NOT ok) AS failed_sources FROM (SELECT *, CAST(attempt_at AS DATE) AS day FROM b_fetch_attempts) GROUP BY day""")
def run_totals(t: Tables):
    return t.attempts.groupBy(F.to_date("attempt_at").cast("string").alias("day")).agg(F.sum("n_items").alias("collected"), F.count_distinct(F.when(~F.col("ok"), F.col("source_id"))).alias("failed_sources"))
