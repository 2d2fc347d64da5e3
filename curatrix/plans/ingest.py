"""Ingest: canonical URLs, first sightings and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import NOW, Tables
from ..functions.urls import canonicalize_url, dedup_hash
from ..operators import ingest as ops
from ..registry import query
from ..sources.items_table import ItemsTable
from ..storage import new_path


def _canonical(url: str) -> str:
    """The same rules as SQL for plain URLs (no escapes, no path parameters), which the pages have."""
    q = f"regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1)"
    keys = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'source', 'fbclid', 'gclid'"
    kept = f"list_sort(list_filter(string_split({q}, '&'), lambda p: contains(p, '=') AND split_part(p, '=', 2) <> '' AND lower(split_part(p, '=', 1)) NOT IN ({keys})))"
    path = f"regexp_replace(regexp_extract({url}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"lower(regexp_extract({url}, '^([^:]+://[^/?#]*)', 1)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"


_TRIMMED = "regexp_replace(r.content_text, '^\\s+|\\s+$', '', 'g')"
_NORM = f"""n AS (SELECT r.batch_id, r.pos, r.source_id, s.domain, s.authority, CASE WHEN trim(r.title) = '' THEN substr({_TRIMMED}, 1, 200) ELSE trim(r.title) END AS title, {_canonical('r.canonical_url')} AS url, r.native_id, r.published_at,
  {_TRIMMED} AS content, strftime(r.fetched_at, '%Y-%m-%dT%H:%M:%S+00:00') AS seen_at,
  CASE WHEN s.id IS NULL THEN 'unknown_source' WHEN trim(r.title) = '' AND {_TRIMMED} = '' THEN 'empty' WHEN r.published_at > TIMESTAMP '{NOW}' + to_days(7) THEN 'future' END AS reason
  FROM b_raw_items r LEFT JOIN b_sources s ON s.id = r.source_id),
h AS (SELECT *, substr(sha256(url), 1, 32) AS hash, source_id || ':' || native_id AS id FROM n)"""


def _normal(t: Tables):
    return ops.normalize(t.raw_items, t.sources, NOW)


@query("canonical_urls", f"SELECT page_id, {_canonical('url')} AS canonical FROM pages")
def canonical_urls(t: Tables):
    return t.table("pages").select("page_id", canonicalize_url(F.col("url")).alias("canonical"))


@query("normalised_items", f"WITH {_NORM} SELECT batch_id, pos, id, source_id, domain, title, url AS canonical_url, hash AS dedup_hash, sha256(content) AS content_sha256 FROM h WHERE reason IS NULL")
def normalised_items(t: Tables):
    return _normal(t).filter("reject_reason IS NULL").select("batch_id", "pos", "id", "source_id", "domain", "title", "canonical_url", "dedup_hash", F.sha2("content_text", 256).alias("content_sha256"))


@query("text_identities", """
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS body, trim(regexp_replace(lower(substr(text, 1, 40)), '\\s+', ' ', 'g')) AS head FROM documents)
SELECT doc_id, substr(sha256(head || '|' || substr(body, 1, 500)), 1, 32) AS dedup_hash FROM n""")
def text_identities(t: Tables):
    """Items without a URL are known by their title and the start of their content."""
    none = F.lit(None).cast("string")
    return t.table("documents").select("doc_id", dedup_hash(none, F.substring("text", 1, 40), F.col("text"), F.col("source")).alias("dedup_hash"))


@query("rejects", f"WITH {_NORM} SELECT batch_id, coalesce(reason, 'ok') AS outcome, count(*) AS n FROM h GROUP BY ALL")
def rejects(t: Tables):
    return _normal(t).groupBy("batch_id", F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("dedup_winners", f"WITH {_NORM} SELECT batch_id, pos, source_id, hash AS dedup_hash FROM h WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY batch_id, pos, source_id) = 1")
def dedup_winners(t: Tables):
    return ops.winners(_normal(t).filter("reject_reason IS NULL")).select("batch_id", "pos", "source_id", "dedup_hash")


@query("dedup_counts", f"""WITH {_NORM}, k AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY batch_id, pos, source_id) AS nth, first_value(source_id) OVER (PARTITION BY hash ORDER BY batch_id, pos, source_id) AS owner FROM h WHERE reason IS NULL)
SELECT batch_id, count(*) FILTER (WHERE nth = 1) AS inserted, count(*) FILTER (WHERE nth > 1 AND source_id <> owner) AS sighted, count(*) FILTER (WHERE nth > 1 AND source_id = owner) AS repeated FROM k GROUP BY batch_id""")
def dedup_counts(t: Tables):
    rows = _normal(t).filter("reject_reason IS NULL")
    first = ops.winners(rows).select("dedup_hash", F.col("source_id").alias("owner"), F.struct("batch_id", "pos", "source_id").alias("first"))
    marked = rows.join(first, "dedup_hash").withColumn("is_first", F.struct("batch_id", "pos", "source_id") == F.col("first"))
    same = F.col("source_id") == F.col("owner")
    return marked.groupBy("batch_id").agg(F.count_if("is_first").alias("inserted"), F.count_if(~F.col("is_first") & ~same).alias("sighted"), F.count_if(~F.col("is_first") & same).alias("repeated"))


_MERGED = f"""WITH {_NORM}, k AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY batch_id, pos, source_id) AS nth FROM h WHERE reason IS NULL),
w AS (SELECT * FROM k WHERE nth = 1),
s AS (SELECT k.hash, k.source_id, min(k.nth) AS nth, arg_min(k.seen_at, k.nth) AS seen_at FROM k JOIN w ON w.hash = k.hash AND w.source_id <> k.source_id GROUP BY ALL),
a AS (SELECT hash, string_agg(source_id || '@' || seen_at, ',' ORDER BY nth) AS seen, CAST(count(*) AS INT) AS n FROM s GROUP BY hash)"""
_MERGED_ITEMS = f"""{_MERGED}
SELECT w.hash AS dedup_hash, w.id, w.source_id, w.title, sha256(w.content) AS content_sha256, coalesce(a.seen, '') AS seen FROM w LEFT JOIN a ON a.hash = w.hash"""


def shown(merged):
    seen = F.array_join(F.transform("also_seen_in", lambda s: F.concat(s["source_id"], F.lit("@"), s["seen_at"])), ",")
    return merged.select("dedup_hash", "id", "source_id", "title", F.sha2("content_text", 256).alias("content_sha256"), seen.alias("seen"))


@query("merged_items", _MERGED_ITEMS)
def merged_items(t: Tables):
    return shown(ops.merge_items(_normal(t)))


@query("merged_confidence", f"""{_MERGED}
SELECT w.hash AS dedup_hash, CASE WHEN w.batch_id = 1 THEN CASE WHEN (w.authority = 'official' AND coalesce(a.n, 0) >= 1) OR coalesce(a.n, 0) >= 2 THEN 'confirmed' WHEN w.authority = 'official' OR a.n = 1 THEN 'firm' ELSE 'tentative' END END AS confidence
FROM w LEFT JOIN a ON a.hash = w.hash""")
def merged_confidence(t: Tables):
    """Items of the first batch are at stage 2 when the others come: their confidence follows the new sightings."""
    first = ops.merge_items(_normal(t).filter("batch_id = 1")).withColumn("analysis_stage", F.lit(2))
    return ops.merge_items(_normal(t).filter("batch_id > 1"), first).select("dedup_hash", "confidence")


@query("merged_incrementally", _MERGED_ITEMS)
def merged_incrementally(t: Tables):
    """The three batches one after the other give what all of them give at once."""
    stored = None
    for k in (1, 2, 3):
        stored = ops.merge_items(_normal(t).filter(F.col("batch_id") == k), stored)
    return shown(stored)


@query("merged_in_layers", _MERGED_ITEMS)
def merged_in_layers(t: Tables):
    """The batches one after the other into a table of buckets, which is compacted on the way; the first batch comes twice."""
    table = ItemsTable(t.spark, new_path(t.spark, "items"), buckets=4, most_layers=2)
    for k in (1, 1, 2, 3):
        table.merge(_normal(t).filter(F.col("batch_id") == k))
    return shown(table.read())


@query("ingest_tallies", f"""WITH {_NORM}, k AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY hash, reason IS NULL ORDER BY batch_id, pos, source_id) END AS nth FROM h)
SELECT CAST(batch_id AS VARCHAR) AS token, count(*) AS landed, count(*) FILTER (WHERE reason = 'unknown_source') AS unknown_source, count(*) FILTER (WHERE reason = 'empty') AS empty, count(*) FILTER (WHERE reason = 'future') AS future,
  count(*) FILTER (WHERE nth = 1) AS inserted, count(*) FILTER (WHERE nth > 1) AS duplicates FROM k GROUP BY batch_id""")
def ingest_tallies(t: Tables):
    """What three merges counted while they wrote; a batch that comes again under its name is not merged."""
    table = ItemsTable(t.spark, new_path(t.spark, "items"), buckets=4)
    for k in (1, 2, 2, 3):
        table.merge(_normal(t).filter(F.col("batch_id") == k), token=str(k))
    get = lambda k: F.col("tallies")[k]
    return table.tallies().select("token", get("landed").alias("landed"), *(get(f"reject_{r}").alias(r) for r in ops.REASONS), get("inserted").alias("inserted"), get("duplicates").alias("duplicates"))


@query("keyword_filter", "SELECT page_id FROM pages WHERE contains(lower(url), 'blog') OR contains(lower(url), '/en/1')")
def keyword_filter(t: Tables):
    return t.table("pages").filter(ops.has_keyword(("Blog", "/en/1"), "url")).select("page_id")


@query("since_filter", "SELECT batch_id, pos, source_id FROM b_raw_items WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-01-10 00:00:00'")
def since_filter(t: Tables):
    return t.raw_items.filter(ops.not_before(F.col("published_at"), "2024-01-10 00:00:00")).select("batch_id", "pos", "source_id")
