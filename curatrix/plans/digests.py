"""Digests: selection, highlights, markdown and listings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..bindings import Tables
from ..operators import digest as ops
from ..registry import query
from ..sources import sinks
from ..storage import new_path

_RANK = "CASE confidence WHEN 'confirmed' THEN 3 WHEN 'firm' THEN 2 WHEN 'tentative' THEN 1 ELSE 0 END"
_C = "c AS (SELECT CAST(stage1_analyzed_at + to_hours(8) AS DATE) AS day, *, insight_score >= 75 AS high FROM b_items WHERE analysis_stage >= 1 AND insight_score >= 40)"
_ORDER = f"insight_score DESC, {_RANK} DESC, title, id"


def _day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@query("digest_counts", f"WITH {_C} SELECT CAST(day AS VARCHAR) AS day, domain, count(*) AS n_items, count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE NOT high) AS n_lower FROM c GROUP BY ALL")
def digest_counts(t: Tables):
    return _day(ops.digest_counts(ops.digest_items(t.items)))


@query("digest_highlights", f"""WITH {_C}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, domain, category ORDER BY {_ORDER}) AS INT) AS rank FROM c WHERE high)
SELECT CAST(day AS VARCHAR) AS day, domain, category, rank, id, insight_score FROM r WHERE rank <= 5""")
def digest_highlights(t: Tables):
    return _day(ops.highlights(ops.digest_items(t.items))).select("day", "domain", "category", "rank", "id", "insight_score")


@query("digest_highlight_items", f"""WITH {_C}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, domain, category ORDER BY {_ORDER}) AS INT) AS rank FROM c WHERE high)
SELECT CAST(r.day AS VARCHAR) AS day, r.domain, r.category, r.rank, i.id, i.title, s.name FROM r JOIN b_items i ON i.id = r.id JOIN b_sources s ON s.id = i.source_id WHERE rank <= 5""")
def digest_highlight_items(t: Tables):
    """A digest's highlights, stored as ordered id lists, joined back to items and sources."""
    stored = ops.highlights(ops.digest_items(t.items)).groupBy("day", "domain", "category").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("item_ids"))
    listed = stored.select("day", "domain", "category", F.posexplode("item_ids").alias("at", "id")).withColumn("rank", F.col("at") + 1)
    named = t.items.select("id", "title", "source_id").join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    return _day(listed.join(named, "id").select("day", "domain", "category", "rank", "id", "title", "name"))


@query("digest_lower", f"""WITH {_C} SELECT CAST(day AS VARCHAR) AS day, domain, id, CAST(row_number() OVER (PARTITION BY day, domain ORDER BY {_ORDER}) AS INT) AS rank FROM c WHERE NOT high""")
def digest_lower(t: Tables):
    return _day(ops.lower_value(ops.digest_items(t.items))).select("day", "domain", "id", "rank")


_FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY day, domain ORDER BY doc_id, id) AS rank FROM c WHERE high)"


@query("digest_overview_input", f"""WITH {_C}, {_FIRST}, k AS (SELECT DISTINCT day, domain FROM c)
SELECT CAST(k.day AS VARCHAR) AS day, k.domain, k.domain AS asked_domain, count(f.id) AS n, coalesce(string_agg(f.title || '|' || f.category || '|' || coalesce(f.summary_zh, '-') || '|' || f.insight_score || '|' || coalesce(f.action_suggestion, '-'), chr(10) ORDER BY f.rank), '') AS items
FROM k LEFT JOIN f ON f.day = k.day AND f.domain = k.domain AND f.rank <= 20 GROUP BY k.day, k.domain""")
def digest_overview_input(t: Tables):
    """One request a digest; its payload is read back field by field."""
    made = ops.overview_requests(ops.digest_items(t.items))
    body = F.from_json("payload", "domain string, items array<struct<title:string,category:string,summary_zh:string,insight_score:int,action_suggestion:string>>")
    shown = lambda x: F.concat(x["title"], F.lit("|"), x["category"], F.lit("|"), F.coalesce(x["summary_zh"], F.lit("-")), F.lit("|"), x["insight_score"], F.lit("|"), F.coalesce(x["action_suggestion"], F.lit("-")))
    return _day(made.withColumn("b", body).select("day", "domain", F.col("b.domain").alias("asked_domain"), F.size("b.items").cast("long").alias("n"), F.array_join(F.transform("b.items", shown), "\n").alias("items")))


#: When the digests of the queries are made.
GENERATED = "2024-01-16 12:00:00"


def overview_scorer(payload: str) -> str:
    """A stand-in for a model: what it says names the first item; asked for a digest of eleven to fourteen items it never keeps the contract, of
    sixteen or more only at the second time."""
    body = json.loads(payload[payload.index("{") :])
    n = len(body["items"])
    if 11 <= n <= 14 or n > 15 and payload[0] == "{":
        return '{"overview": 7}'
    return json.dumps({"overview_zh": f"{body['domain']}: {n}, first [{body['items'][0]['title'] if n else ''}]."})


@query("digest_overviews", f"""WITH {_C}, {_FIRST}, k AS (SELECT DISTINCT day, domain FROM c), n AS (SELECT k.day, k.domain, count(f.id) AS n, coalesce(max(f.title) FILTER (WHERE f.rank = 1), '') AS title FROM k LEFT JOIN f ON f.day = k.day AND f.domain = k.domain AND f.rank <= 20 GROUP BY k.day, k.domain)
SELECT day || ':' || domain AS id, domain || ': ' || n || ', first [' || title || '].' AS overview FROM n WHERE n NOT BETWEEN 11 AND 14""")
def digest_overviews(t: Tables):
    return ops.overviews(ops.digest_items(t.items), overview_scorer, 4)


def _totals(t: Tables):
    collected = t.attempts.groupBy(F.to_date("attempt_at").alias("day")).agg(F.sum("n_items").alias("collected"), F.count_distinct(F.when(~F.col("ok"), F.col("source_id"))).alias("failed_sources"))
    analyzed = t.items.filter("analysis_stage >= 1").groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("analyzed"))
    return collected.join(analyzed, "day", "full_outer")


_LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ops.LABELS.items()) + " END"


#: A digest's overview: what the stand-in says, or, where it breaks the contract, a sentence of the digest's counts.
_COUNTED = "'今日共采集 ' || CAST(coalesce(k.collected, 0) AS BIGINT) || ' 条情报，高价值 ' || n.high || ' 条。'"
_SUMMARY = f"CASE WHEN coalesce(o.n, 0) BETWEEN 11 AND 14 THEN {_COUNTED} ELSE n.domain || ': ' || coalesce(o.n, 0) || ', first [' || coalesce(o.title, '') || '].' END"
_MARKDOWN = f"""WITH {_C}, {_FIRST},
o AS (SELECT day, domain, count(*) AS n, max(title) FILTER (WHERE rank = 1) AS title FROM f WHERE rank <= 20 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day, domain, category ORDER BY {_ORDER}) AS rank FROM c WHERE high),
g AS (SELECT day, domain, category, string_agg('- **' || title || '**' || chr(10) || '  - score: ' || insight_score || chr(10) || '  - source: ' || source_id
  || coalesce(chr(10) || '  - summary: ' || nullif(summary_zh, ''), '') || coalesce(chr(10) || '  - action: ' || nullif(action_suggestion, ''), '') || chr(10) || chr(10), '' ORDER BY rank) AS body FROM r WHERE rank <= 5 GROUP BY ALL),
h AS (SELECT day, domain, string_agg('### ' || {_LABEL} || chr(10) || chr(10) || body, '' ORDER BY category) AS t FROM g GROUP BY ALL),
l AS (SELECT day, domain, string_agg('- ' || title || ' (score ' || insight_score || ')', chr(10) ORDER BY {_ORDER}) AS t FROM c WHERE NOT high GROUP BY ALL),
k AS (SELECT CAST(attempt_at AS DATE) AS day, sum(n_items) AS collected, count(DISTINCT source_id) FILTER (WHERE NOT ok) AS failed FROM b_fetch_attempts GROUP BY 1),
a AS (SELECT CAST(fetched_at AS DATE) AS day, count(*) AS analyzed FROM b_items WHERE analysis_stage >= 1 GROUP BY 1),
n AS (SELECT day, domain, count(*) FILTER (WHERE high) AS high FROM c GROUP BY ALL)
SELECT CAST(n.day AS VARCHAR) AS day, n.domain, 'intelligence-' || n.domain || '-' || n.day || '.md' AS file,
  '---' || chr(10) || 'title: ' || CASE n.domain WHEN 'security' THEN '安全情报日报' WHEN 'ai' THEN 'AI 情报日报' ELSE '情报日报' END || ' · ' || n.day || chr(10) || 'date: {GENERATED}' || chr(10) || 'tags:' || chr(10) || '  - intelligence' || chr(10) || '  - ' || n.domain || chr(10)
  || 'categories:' || chr(10) || '  - 情报日报' || chr(10) || '---' || chr(10) || chr(10) || '## Overview' || chr(10) || chr(10)
  || {_SUMMARY} || chr(10) || chr(10) || '## High Value' || chr(10) || chr(10) || coalesce(h.t, '暂无高价值情报。' || chr(10) || chr(10)) || '## Lower-value Mentions' || chr(10) || chr(10) || coalesce(l.t, '暂无。')
  || chr(10) || chr(10) || '## Stats' || chr(10) || chr(10) || '- Collected: ' || CAST(coalesce(k.collected, 0) AS BIGINT) || chr(10) || '- Analyzed: ' || coalesce(a.analyzed, 0) || chr(10) || '- High value: ' || n.high || chr(10) || '- Failed sources: ' || coalesce(k.failed, 0) || chr(10) AS content
FROM n LEFT JOIN h ON h.day = n.day AND h.domain = n.domain LEFT JOIN l ON l.day = n.day AND l.domain = n.domain LEFT JOIN k ON k.day = n.day LEFT JOIN a ON a.day = n.day LEFT JOIN o ON o.day = n.day AND o.domain = n.domain"""


@query("digest_markdown", _MARKDOWN.replace(_SUMMARY, _COUNTED))
def digest_markdown(t: Tables):
    """Digests that no model was asked for."""
    return _day(ops.render(ops.digest_items(t.items), _totals(t), GENERATED).select("day", "domain", "file", "content"))


@query("digest_markdown_overview", _MARKDOWN)
def digest_markdown_overview(t: Tables):
    return _rendered(t)


def _rendered(t: Tables):
    chosen = ops.digest_items(t.items)
    said = ops.overviews(chosen, overview_scorer, 4)
    return _day(ops.render(chosen, _totals(t), GENERATED, said).select("day", "domain", "file", "content"))


@query("digest_files", f"SELECT file, sha256(content) AS content_sha256 FROM ({_MARKDOWN})")
def digest_files(t: Tables):
    """The files as a site would find them, each under its name."""
    path = new_path(t.spark, "posts")
    sinks.write_text_files(_rendered(t), path)
    files = t.spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.sha2("value", 256).alias("content_sha256"))


@query("digest_job", f"""SELECT day, domain, sha256(CASE WHEN domain = 'ai' THEN content || 'again' ELSE content END) AS content_sha256, 'digests/' || day || '/' || domain || '.md' AS backup_key,
  'https://files.example.org/digests/' || day || '/' || domain || '.md' AS url, 'uploaded' AS backup FROM ({_MARKDOWN})""")
def digest_job(t: Tables):
    """Digests are stored, one domain's are stored again, and an uploader gets their files, keys and URLs."""
    path, made = new_path(t.spark, "digests"), _rendered(t)
    sinks.write_digests(made, path)
    again = made.withColumn("content", F.when(F.col("domain") == "ai", F.concat("content", F.lit("again"))).otherwise(F.col("content")))
    placed = sinks.digest_job(again, path, lambda d: d.withColumn("backup", F.lit("uploaded")), base_url="https://files.example.org")
    kept = t.spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "domain", F.sha2("content", 256).alias("content_sha256"))
    return placed.drop("file").join(kept, ["day", "domain"])


@query("digest_listing", "SELECT id, CAST(day AS VARCHAR) AS day, domain, n_items, n_high, 'intelligence-' || domain || '-' || day || '.md' AS path FROM b_digests WHERE domain IN ('security', 'ai') ORDER BY day DESC, domain LIMIT 20")
def digest_listing(t: Tables):
    seen = t.table("b_digests").filter(F.col("domain").isin("security", "ai")).orderBy(F.desc("day"), "domain").limit(20)
    return seen.select("id", F.col("day").cast("string").alias("day"), "domain", "n_items", "n_high", ops.file_name(F.col("domain"), F.col("day")).alias("path"))


@query("digest_latest", "SELECT domain, arg_max(id, day) AS id FROM b_digests GROUP BY domain")
def digest_latest(t: Tables):
    return t.table("b_digests").groupBy("domain").agg(F.max_by("id", "day").alias("id"))
