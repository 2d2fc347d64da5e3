"""Tables of the feed model, derived from the shared test tables by one SQL text for Spark and DuckDB.

The only difference between the dialects is how minutes are added and what a timestamp without a zone is called.
"""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The instant at which ingest, runs and queue look at the tables, and the day that the statistics show.
NOW, TODAY = "2024-01-16 12:00:00", "2024-01-05"

_SHARED_TABLES = ("documents", "pages", "events")

#: By name; ``{ts}`` is the timestamp type's name, ``{min:x}`` x minutes as an interval.
TEMPLATES = {
    "b_sources": """
SELECT id, n, concat('Feed ', CAST(n AS STRING)) AS name,
  CASE n % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'ai' WHEN 2 THEN 'security' ELSE 'finance' END AS domain,
  CASE n % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'authoritative' ELSE 'regular' END AS authority,
  CASE WHEN n % 7 = 6 THEN 'candidate' ELSE 'approved' END AS status,
  CASE WHEN n % 10 = 9 THEN 'disabled' WHEN n % 5 = 3 THEN 'degraded' ELSE 'good' END AS health,
  CASE WHEN n % 10 = 9 THEN 3 WHEN n % 5 = 3 THEN 1 ELSE 0 END AS consecutive_failures,
  n <> 13 AS is_active, CASE n % 6 WHEN 5 THEN 'internal_api' WHEN 3 THEN 'rss' ELSE 'api' END AS type, concat('https://', id, '.example.org/feed') AS url,
  {ts} '2024-01-15 00:00:00' + {min:n * 7} AS last_fetch_at, CASE WHEN n % 5 = 3 THEN 'source_timeout' ELSE 'succeeded' END AS last_fetch_status
FROM (SELECT DISTINCT source AS id, CAST(substr(source, 4) AS INT) AS n FROM documents) s""",
    "b_items": """
SELECT concat(d.source, ':', CAST(d.doc_id AS STRING)) AS id, d.doc_id, d.source AS source_id, s.domain, s.authority,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE CAST((d.doc_id * 31 + d.n_chars * 7) % 101 AS INT) END AS insight_score,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE CASE d.doc_id % 9 WHEN 0 THEN 'vulnerability' WHEN 1 THEN 'exploit' WHEN 2 THEN 'research'
    WHEN 3 THEN 'product' WHEN 4 THEN 'engineering' WHEN 5 THEN 'tool' WHEN 6 THEN 'incident' WHEN 7 THEN 'discussion' ELSE 'other' END END AS category,
  substr(d.text, 1, 80) AS title, d.text AS content_text,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE concat('about ', substr(d.text, 1, 40)) END AS summary_zh,
  concat('https://', d.source, '.example.org/item/', CAST(d.doc_id AS STRING)) AS canonical_url,
  {ts} '2024-01-01 00:00:00' + {min:(d.doc_id * 43) % 43200} AS published_at,
  {ts} '2024-01-01 00:00:00' + {min:(d.doc_id * 43) % 43200 + 60} AS fetched_at,
  {ts} '2024-01-01 00:00:00' + {min:(d.doc_id * 43) % 43200 + 70} AS stage1_analyzed_at,
  CASE WHEN d.doc_id % 17 = 0 THEN 0 WHEN (d.doc_id * 31 + d.n_chars * 7) % 101 < 75 THEN 1 ELSE 2 END AS analysis_stage,
  CASE WHEN d.doc_id % 17 = 0 THEN 'model_parse_error' END AS stage1_error,
  CAST(d.doc_id % 4 AS INT) AS n_occ,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN (s.authority = 'official' AND d.doc_id % 4 >= 1) OR d.doc_id % 4 >= 2 THEN 'confirmed'
    WHEN s.authority = 'official' OR d.doc_id % 4 = 1 THEN 'firm' ELSE 'tentative' END AS confidence,
  CASE d.doc_id % 5 WHEN 0 THEN 'growing' WHEN 1 THEN 'stable' WHEN 2 THEN 'emerging' END AS trend_signal,
  CASE WHEN (d.doc_id * 31 + d.n_chars * 7) % 101 >= 75 AND d.doc_id % 17 <> 0 THEN concat('act on ', CAST(d.doc_id AS STRING)) END AS action_suggestion,
  CASE WHEN (d.doc_id * 31 + d.n_chars * 7) % 101 >= 75 AND d.doc_id % 17 <> 0 THEN concat('because ', CAST(d.doc_id AS STRING)) END AS recommendation_reason,
  concat('author ', CAST(d.doc_id % 50 AS STRING)) AS author, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE split(concat('t', CAST(d.doc_id % 7 AS STRING), ',u'), ',') END AS tags,
  CASE WHEN d.doc_id % 17 = 0 THEN 'unknown' WHEN d.doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS credibility,
  CASE WHEN d.doc_id % 17 <> 0 THEN 'model-1' END AS stage1_model, CASE WHEN d.doc_id % 17 <> 0 THEN 'maker' END AS stage1_provider, CASE WHEN d.doc_id % 17 <> 0 THEN 'v1' END AS stage1_prompt_version,
  CASE WHEN (d.doc_id * 31 + d.n_chars * 7) % 101 >= 75 AND d.doc_id % 17 <> 0 THEN 'model-2' END AS stage2_model,
  concat('run-', CAST(CAST({ts} '2024-01-01 00:00:00' + {min:(d.doc_id * 43) % 43200 + 60} AS DATE) AS STRING)) AS run_id
FROM documents d JOIN b_sources s ON d.source = s.id""",
    "b_raw_items": r"""
SELECT batch_id, page_id AS pos, source_id, title, canonical_url, content_text, CAST(page_id AS STRING) AS native_id, concat('by ', CAST(page_id % 9 AS STRING)) AS author,
  {ts} '2024-01-01 00:00:00' + {min:(page_id * 61) % 40000} AS published_at, {ts} '2024-01-16 12:00:00' + {min:batch_id * 60} AS fetched_at
FROM (
  SELECT 1 AS batch_id, page_id, concat('src', CAST(page_id % 20 AS STRING)) AS source_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS canonical_url, html AS content_text FROM pages
  UNION ALL
  SELECT 2, page_id, concat('src', CAST((page_id + 1) % 20 AS STRING)), CASE WHEN page_id % 9 = 0 THEN '' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END, concat('HTTP', substr(url, 5)), CASE WHEN page_id % 9 = 0 THEN '' ELSE html END FROM pages WHERE page_id % 3 = 0
  UNION ALL
  SELECT 3, page_id, CASE WHEN page_id % 15 = 0 THEN 'lost' ELSE concat('src', CAST(page_id % 20 AS STRING)) END, regexp_extract(html, '<title>(.*?)</title>', 1), url, html FROM pages WHERE page_id % 5 = 0) r""",
    "b_fetch_attempts": """
SELECT event_id, concat('src', CAST(user_id % 20 AS STRING)) AS source_id, ts AS attempt_at, event_type <> 'error' AS ok,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS n_items,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'source_timeout' WHEN 1 THEN 'source_auth_error' WHEN 2 THEN 'source_http_error' ELSE 'source_parse_error' END END AS error,
  CAST(event_id % 300 AS BIGINT) AS duration_ds, concat('run-', CAST(CAST(ts AS DATE) AS STRING)) AS run_id,
  CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'status' WHEN 2 THEN 'status' WHEN 3 THEN 'transport' ELSE 'parse' END END AS failure,
  CASE WHEN event_type = 'error' AND event_id % 5 IN (1, 2) THEN CAST(400 + event_id % 7 AS INT) END AS http_status
FROM events""",
    "b_runs": """
SELECT day, concat('run-', CAST(day AS STRING)) AS id, 'daily' AS kind, rn, n_runs, CAST(day AS {tstype}) - {min:1440} AS window_start, CAST(rn * 3 AS BIGINT) AS dedup_skipped, CAST(rn % 5 AS BIGINT) AS retention_deleted,
  CASE WHEN rn % 4 IN (0, 3) THEN concat(CAST(day AS STRING), CASE WHEN rn % 6 = 0 THEN ':other' ELSE ':security' END) END AS digest_security_id, CASE WHEN rn % 3 = 0 THEN concat(CAST(day AS STRING), ':ai') END AS digest_ai_id,
  CASE WHEN rn = n_runs THEN 'running' WHEN rn % 7 = 0 THEN 'failed' WHEN rn % 5 = 0 THEN 'partial' ELSE 'succeeded' END AS status,
  CAST(day AS {tstype}) AS started_at, CASE WHEN rn < n_runs THEN CAST(day AS {tstype}) + {min:30} END AS finished_at, CAST(day AS {tstype}) AS window_end,
  sources_total, sources_ok, sources_failed, stage1_total, stage1_failed, stage1_total - stage1_failed AS stage1_ok,
  stage2_total, stage2_failed, stage2_total - stage2_failed AS stage2_ok,
  CASE rn % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS digest_security,
  CASE rn % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'skipped' ELSE 'failed' END AS digest_ai
FROM (
  SELECT g.*, CAST(row_number() OVER (ORDER BY day) AS INT) AS rn, CAST(count(*) OVER () AS INT) AS n_runs FROM (
    SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id % 20) AS sources_total,
      count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id % 20 END) AS sources_ok,
      count(DISTINCT user_id % 20) - count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id % 20 END) AS sources_failed,
      CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS stage1_total,
      CAST(sum(CASE WHEN event_type IN ('view', 'click') AND event_id % 40 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stage1_failed,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS stage2_total,
      CAST(sum(CASE WHEN event_type = 'purchase' AND event_id % 25 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stage2_failed
    FROM events GROUP BY CAST(ts AS DATE)) g) r""",
    "b_model_responses": """
SELECT doc_id, CAST(doc_id % 6 AS INT) AS variant,
  CASE doc_id % 6
    WHEN 0 THEN concat('{{"category":"research","tags":["a"," b ",""],"summary_zh":"s', k, '","insight_score":', v, ',"credibility":"high"}}')
    WHEN 1 THEN concat('```json', chr(10), '{{"category":" Tool ","tags":[],"summary_zh":" s', k, ' ","insight_score":', v, ',"credibility":"LOW"}}', chr(10), '```')
    WHEN 2 THEN concat('Here it is: {{"category":"product","tags":["x"],"summary_zh":"s', k, '","insight_score":', v, ',"credibility":"medium"}} done')
    WHEN 3 THEN concat('{{"category":"incident","tags":["y"],"summary_zh":"s', k, '","insight_score":130,"credibility":"high"}}')
    WHEN 4 THEN concat('{{"category":"incident","tags":["y"],"summary_zh":"s', k, '","credibility":"high"}}')
    ELSE concat('{{"category":"nonsense","tags":["z"],"summary_zh":"s', k, '","insight_score":', v, ',"credibility":"none"}}') END AS raw,
  CASE WHEN doc_id % 7 = 0 THEN concat('{{"recommendation_reason":"r', k, '","trend_signal":"stable"}}')
    ELSE concat('{{"recommendation_reason":"r', k, '","trend_signal":"', CASE WHEN doc_id % 2 = 0 THEN 'growing' ELSE 'surging' END, '","action_suggestion":"a', k, '"}}') END AS raw2,
  CAST((doc_id * 31 + n_chars * 7) % 101 AS INT) AS score
FROM (SELECT doc_id, n_chars, CAST(doc_id AS STRING) AS k, CAST((doc_id * 31 + n_chars * 7) % 101 AS STRING) AS v FROM documents) m""",
    "b_occurrences": """
SELECT i.id AS item_id, k.k, concat('src', CAST((s.n + k.k * 3) % 25 AS STRING)) AS source_id, concat(i.canonical_url, '?v=', CAST(k.k AS STRING)) AS url
FROM b_items i JOIN b_sources s ON i.source_id = s.id JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k ON k.k <= i.n_occ""",
    "b_deep_queue": """
SELECT concat('GHSA-', substr(h, 1, 4), '-', substr(h, 5, 4), '-', substr(h, 9, 4)) AS subject, concat(source, ':', CAST(doc_id AS STRING)) AS item_id, doc_id,
  CASE doc_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'ok' ELSE 'empty' END AS status,
  CASE WHEN doc_id % 5 = 1 THEN {ts} '2024-01-16 00:00:00' + {min:doc_id % 720} END AS claimed_at,
  CASE WHEN doc_id % 5 = 1 THEN concat('w', CAST(doc_id % 3 AS STRING)) END AS worker_id,
  CAST(doc_id % 3 AS INT) AS attempt_count, {ts} '2024-01-01 00:00:00' + {min:doc_id % 20000} AS created_at
FROM (SELECT doc_id, source, md5(CAST(doc_id AS STRING)) AS h FROM documents WHERE doc_id % 11 = 0) q""",
    "b_candidates": """
SELECT i.*, CASE WHEN doc_id % 11 IN (0, 3) THEN concat('see GHSA-', upper(substr(md5(CAST(doc_id AS STRING)), 1, 4)), '-', substr(md5(CAST(doc_id AS STRING)), 5, 4), '-', substr(md5(CAST(doc_id AS STRING)), 9, 4), ' now') ELSE title END AS advisory_text
FROM b_items i""",
    "b_digests": """
SELECT concat(CAST(day AS STRING), ':', domain) AS id, concat('run-', CAST(day AS STRING)) AS run_id, day, domain, CAST(count(*) AS BIGINT) AS n_items,
  CAST(sum(CASE WHEN insight_score >= 75 THEN 1 ELSE 0 END) AS BIGINT) AS n_high
FROM (SELECT CAST(stage1_analyzed_at + {min:480} AS DATE) AS day, domain, insight_score FROM b_items WHERE insight_score >= 40 AND analysis_stage >= 1) x
GROUP BY day, domain""",
}


def sql(name: str, dialect: str) -> str:
    """The binding's text for ``spark`` or ``duckdb``."""
    minutes = "make_interval(0, 0, 0, 0, 0, CAST({} AS INT), 0)" if dialect == "spark" else "to_minutes(CAST({} AS BIGINT))"
    text = re.sub(r"\{min:(.*?)\}", lambda m: minutes.format(m[1]), TEMPLATES[name])
    text = text.replace("{tstype}", "TIMESTAMP_NTZ" if dialect == "spark" else "TIMESTAMP")
    text = text.replace("{ts}", "TIMESTAMP_NTZ" if dialect == "spark" else "TIMESTAMP")
    return text.replace("{{", "{").replace("}}", "}")


def used(text: str) -> list[str]:
    """Bindings that a text needs, in the order in which they build on each other."""
    found: list[str] = []

    def need(t: str) -> None:
        for name in TEMPLATES:
            if name not in found and re.search(rf"\b{name}\b", t):
                need(TEMPLATES[name])
                found.append(name)

    need(text)
    return [n for n in found]


def with_bindings(text: str) -> str:
    """A DuckDB query with the bindings it uses ahead of it."""
    parts = ", ".join(f"{n} AS ({sql(n, 'duckdb')})" for n in used(text))
    if not parts:
        return text
    body = text.strip()
    return f"WITH {parts}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts} {body}"


class Tables:
    """The shared tables of a folder and the bindings on them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TEMPLATES:
                text = sql(name, "spark")
                needs = [n for n in (*TEMPLATES, *_SHARED_TABLES) if n != name and re.search(rf"\b{n}\b", text)]
                for n in needs:
                    text = re.sub(rf"\b{n}\b", "{" + n + "}", text)
                if name == "b_model_responses":  # its text holds braces of JSON
                    self._made[name] = self._by_view(name)
                else:
                    self._made[name] = self.spark.sql(text, **{n: self.table(n) for n in needs})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def _by_view(self, name: str) -> DataFrame:
        view = f"curatrix_documents_{uuid.uuid4().hex}"  # its own: other tables of the session stay apart
        self.table("documents").createTempView(view)
        try:
            return self.spark.sql(re.sub(r"\bdocuments\b", view, sql(name, "spark")))
        finally:
            self.spark.catalog.dropTempView(view)

    @cached_property
    def sources(self) -> DataFrame:
        return self.table("b_sources")

    @cached_property
    def items(self) -> DataFrame:
        return self.table("b_items")

    @cached_property
    def raw_items(self) -> DataFrame:
        return self.table("b_raw_items")

    @cached_property
    def attempts(self) -> DataFrame:
        return self.table("b_fetch_attempts")

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("b_runs")

    @cached_property
    def responses(self) -> DataFrame:
        return self.table("b_model_responses")

    @cached_property
    def queue(self) -> DataFrame:
        return self.table("b_deep_queue")
