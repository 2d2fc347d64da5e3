"""Listings of items: filters, search and pages. Limits are the page sizes of the feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import Tables
from ..functions import scores
from ..operators import listing as ops
from ..operators.stats import visible_items
from ..registry import query
from ..sources import layout
from ..storage import new_path

_KEY = "coalesce(insight_score, -1)"
_SEEN = "domain IN ('security', 'ai') AND source_id IN (SELECT id FROM b_sources)"


def _seen(t: Tables):
    return visible_items(t.items, t.sources, ("security", "ai"))


@query("items_page", f"SELECT id, insight_score FROM b_items WHERE {_SEEN} ORDER BY {_KEY} DESC, id LIMIT 51")
def items_page(t: Tables):
    return ops.page(_seen(t), 50).select("id", "insight_score")


@query("items_page_after", f"SELECT id, insight_score FROM b_items WHERE {_SEEN} AND ({_KEY} < 60 OR ({_KEY} = 60 AND id > 'src1:0')) ORDER BY {_KEY} DESC, id LIMIT 51")
def items_page_after(t: Tables):
    return ops.page(_seen(t), 50, ops.cursor(60, "src1:0")).select("id", "insight_score")


def _laid_out(t: Tables, file_rows: int = 2000) -> str:
    path = new_path(t.spark, "layout")
    layout.write_layout(_seen(t).select("id", "insight_score", "category", "title"), path, file_rows)
    return path


@query("layout_page", f"SELECT id, insight_score FROM b_items WHERE {_SEEN} AND ({_KEY} < 60 OR ({_KEY} = 60 AND id > 'src1:0')) ORDER BY {_KEY} DESC, id LIMIT 51")
def layout_page(t: Tables):
    """A page of a table that lies in the listing's order, from one or two of its files."""
    return layout.page(t.spark, _laid_out(t, 100), 50, ops.cursor(60, "src1:0")).select("id", "insight_score")


@query("layout_page_filtered", f"SELECT id, insight_score FROM b_items WHERE {_SEEN} AND category = 'tool' ORDER BY {_KEY} DESC, id LIMIT 21")
def layout_page_filtered(t: Tables):
    return layout.page(t.spark, _laid_out(t, 100), 20, filters=lambda d: ops.filtered(d, category="tool")).select("id", "insight_score")


@query("layout_lookup", f"SELECT id, title, category, insight_score FROM b_items WHERE {_SEEN} AND id = 'src0:0'")
def layout_lookup(t: Tables):
    return layout.lookup(t.spark, _laid_out(t), "src0:0").select("id", "title", "category", "insight_score")


_HAY = "lower(concat_ws(chr(10), title, summary_zh, content_text))"


@query("items_search", f"""
SELECT id, CAST(len(string_split({_HAY}, 'the')) - 1 + len(string_split({_HAY}, 'of the')) - 1 AS BIGINT) AS relevance FROM b_items
WHERE {_SEEN} AND contains({_HAY}, 'of the') AND NOT contains({_HAY}, '%%%')
ORDER BY relevance DESC, {_KEY} DESC, id LIMIT 21""")
def items_search(t: Tables):
    return ops.page(ops.search(_seen(t), 'the +"of the" -%%%'), 20).select("id", "relevance")


@query("items_filtered", f"""
SELECT id, category, insight_score, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published FROM b_items
WHERE {_SEEN} AND domain = 'security' AND category = 'research' AND insight_score >= 20 AND analysis_stage = 1
  AND published_at >= TIMESTAMP '2024-01-05 00:00:00' AND published_at <= TIMESTAMP '2024-01-25 00:00:00'""")
def items_filtered(t: Tables):
    found = ops.filtered(_seen(t), "security", category="research", min_score=20, stage=1, since="2024-01-05 00:00:00", until="2024-01-25 00:00:00")
    return found.select("id", "category", "insight_score", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("items_dashboard", """
SELECT id, insight_score FROM b_items WHERE coalesce(insight_score, 0) >= 30 AND domain = 'ai'
  AND (contains(lower(title), 'the') OR contains(coalesce(summary_zh, ''), 'The'))""")
def items_dashboard(t: Tables):
    return ops.dashboard(t.items, "ai", 10, "The").select("id", "insight_score")


@query("item_lookup", f"SELECT id, title, category, insight_score FROM b_items WHERE {_SEEN} AND id = 'src0:0'")
def item_lookup(t: Tables):
    return _seen(t).filter(F.col("id") == "src0:0").select("id", "title", "category", "insight_score")


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
_EXPIRES = """CASE WHEN insight_score < 10 THEN stage1_analyzed_at WHEN insight_score < 30 THEN stage1_analyzed_at + to_days(5) WHEN insight_score < 50 THEN stage1_analyzed_at + to_days(10) WHEN insight_score < 75 THEN stage1_analyzed_at + to_days(30) END"""


@query("item_view", f"""
WITH o AS (SELECT item_id, string_agg(source_id || '@' || url, ',' ORDER BY source_id, url) AS seen FROM b_occurrences GROUP BY item_id)
SELECT id, source_id, domain, title, canonical_url, author, {_ISO.format("published_at")} AS published_at, {_ISO.format("fetched_at")} AS fetched_at, coalesce(o.seen, '') AS also_seen_in, category, array_to_string(tags, ',') AS tags, summary_zh, insight_score,
  credibility, confidence, trend_signal, recommendation_reason, action_suggestion, analysis_stage, stage1_model, stage1_provider, stage1_prompt_version, {_ISO.format("stage1_analyzed_at")} AS stage1_analyzed_at, stage2_model,
  CAST(NULL AS VARCHAR) AS stage2_provider, CAST(NULL AS VARCHAR) AS stage2_prompt_version, CAST(NULL AS VARCHAR) AS stage2_analyzed_at, {_ISO.format(_EXPIRES)} AS expires_at
FROM b_items LEFT JOIN o ON o.item_id = id""")
def item_view(t: Tables):
    seen = t.table("b_occurrences").groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("source_id", "url"))).alias("also_seen_in"))
    items = t.items.withColumn("expires_at", scores.expires_at(F.col("insight_score"), F.col("stage1_analyzed_at"))).join(seen, "id", "left")
    places = F.array_join(F.transform("also_seen_in", lambda s: F.concat(s["source_id"], F.lit("@"), s["url"])), ",")
    return ops.view(items).withColumns({"also_seen_in": F.coalesce(places, F.lit("")), "tags": F.array_join("tags", ",")})


@query("occurrence_sources", "SELECT o.item_id, o.k, s.id AS source_id, s.name, o.url FROM b_occurrences o JOIN b_sources s ON o.source_id = s.id")
def occurrence_sources(t: Tables):
    known = t.sources.select(F.col("id").alias("source_id"), "name")
    return t.table("b_occurrences").join(known, "source_id").select("item_id", "k", "source_id", "name", "url")
