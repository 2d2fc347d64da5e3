"""Scoring: response contracts and their application."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..bindings import Tables
from ..functions import contracts, scores
from ..operators import scoring as ops
from ..registry import query

_S1 = """s1 AS (SELECT doc_id, variant, variant <> 4 AS ok, CASE variant WHEN 0 THEN 'research' WHEN 1 THEN 'tool' WHEN 2 THEN 'product' WHEN 3 THEN 'incident' WHEN 5 THEN 'other' END AS category,
  CASE variant WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN 'y' WHEN 5 THEN 'z' END AS tags, CASE WHEN variant <> 4 THEN 's' || doc_id END AS summary_zh,
  CASE variant WHEN 3 THEN 100 WHEN 4 THEN NULL ELSE score END AS insight_score, CASE variant WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 5 THEN 'unknown' END AS credibility,
  CASE WHEN variant = 4 THEN 'model_parse_error' END AS error FROM b_model_responses)"""


def _stage1(t: Tables):
    return contracts.extract_objects(t.responses).withColumn("outcome", contracts.parse_stage1(F.col("payload")))


@query("response_contract_s1", f"WITH {_S1} SELECT doc_id, category, tags, summary_zh, CAST(insight_score AS INT) AS insight_score, credibility, error FROM s1")
def response_contract_s1(t: Tables):
    o = F.col("outcome")
    return _stage1(t).select("doc_id", o["category"].alias("category"), F.array_join(o["tags"], ",").alias("tags"), *(o[c].alias(c) for c in ("summary_zh", "insight_score", "credibility", "error")))


@query("response_contract_s2", """
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'r' || doc_id END AS recommendation_reason, CASE WHEN doc_id % 7 <> 0 THEN 'a' || doc_id END AS action_suggestion,
  CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN 'growing' END AS trend_signal, CASE WHEN doc_id % 7 = 0 THEN 'model_parse_error' END AS error FROM b_model_responses""")
def response_contract_s2(t: Tables):
    parsed = contracts.extract_objects(t.responses, "raw2").withColumn("o", contracts.parse_stage2(F.col("payload"), F.lit("firm")))
    return parsed.select("doc_id", *(F.col("o")[c].alias(c) for c in ("recommendation_reason", "action_suggestion", "trend_signal", "error")))


@query("prepared_content", r"""
SELECT id, length(coalesce(content_text, '')) > 4000 AS truncated,
  sha256(CASE WHEN length(content_text) > 4000 THEN substr(content_text, 1, 3000) || chr(10) || chr(10) || '...[truncated]...' || chr(10) || chr(10) || right(content_text, 500) ELSE coalesce(content_text, '') END) AS content_sha256 FROM b_items""")
def prepared_content(t: Tables):
    c = contracts.prepare_content(F.col("content_text"))
    return t.items.select("id", c["truncated"].alias("truncated"), F.sha2(c["text"], 256).alias("content_sha256"))


@query("apply_outcomes", f"""WITH {_S1}, a AS (SELECT i.id, CAST(s1.insight_score AS INT) AS insight_score, s1.category, s1.tags, s1.credibility, s1.error, i.authority, i.n_occ, CASE WHEN s1.ok THEN 1 ELSE 0 END AS stage, m.doc_id,
    coalesce(s1.insight_score >= 75, FALSE) AS due, coalesce(s1.insight_score >= 75, FALSE) AND m.doc_id % 7 <> 0 AS deep
  FROM b_items i JOIN b_model_responses m ON m.doc_id = i.doc_id JOIN s1 ON s1.doc_id = i.doc_id)
SELECT id, insight_score, category, tags, credibility, error AS stage1_error, 'small' AS stage1_model, '2024-02-01 00:00:00' AS stage1_at, CASE WHEN due THEN 'large' END AS stage2_model, CASE WHEN due THEN '2024-02-02 00:00:00' END AS stage2_at,
  CASE WHEN due AND NOT deep THEN 'model_parse_error' END AS stage2_error, CASE WHEN deep THEN 'r' || doc_id END AS recommendation_reason, CASE WHEN deep THEN 2 ELSE stage END AS analysis_stage,
  CASE WHEN deep THEN CASE WHEN (authority = 'official' AND n_occ >= 1) OR n_occ >= 2 THEN 'confirmed' WHEN authority = 'official' OR n_occ = 1 THEN 'firm' ELSE 'tentative' END END AS confidence,
  strftime(CASE WHEN insight_score < 10 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN insight_score < 30 THEN TIMESTAMP '2024-02-06 00:00:00' WHEN insight_score < 50 THEN TIMESTAMP '2024-02-11 00:00:00' WHEN insight_score < 75 THEN TIMESTAMP '2024-03-02 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS expires FROM a""")
def apply_outcomes(t: Tables):
    blank = t.items.select("id", "doc_id", "authority", "n_occ", F.lit(None).cast("string").alias("confidence"), F.lit(0).alias("analysis_stage"))
    keys = t.items.select("doc_id", "id")
    first = _stage1(t).select("doc_id", "outcome", F.lit("small").alias("model")).join(keys, "doc_id").select("id", "outcome", "model")
    scored = ops.apply_stage1(blank, first, "2024-02-01 00:00:00")
    due = scored.filter(F.col("insight_score") >= ops.STAGE2_FROM).select("id", "doc_id", "authority", "n_occ")
    answers = contracts.extract_objects(t.responses.select("doc_id", "raw2"), "raw2").join(due, "doc_id")
    second = answers.select("id", contracts.parse_stage2(F.col("payload"), scores.derive_confidence(F.col("authority"), F.col("n_occ"))).alias("outcome"), F.lit("large").alias("model"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return ops.apply_stage2(scored, second, "2024-02-02 00:00:00").select(
        "id", "insight_score", "category", F.array_join("tags", ",").alias("tags"), "credibility", "stage1_error", "stage1_model", stamp("stage1_analyzed_at").alias("stage1_at"), "stage2_model", stamp("stage2_analyzed_at").alias("stage2_at"),
        "stage2_error", "recommendation_reason", "analysis_stage", "confidence", stamp("expires_at").alias("expires"))


@query("overview_contract", """
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'o' || doc_id END AS overview_zh, CASE WHEN doc_id % 4 IN (2, 3) THEN 'model_parse_error' END AS error FROM b_model_responses""")
def overview_contract(t: Tables):
    """Plain and fenced answers are good; a number instead of a string, or another field's name, is an error."""
    key = F.col("doc_id").cast("string")
    texts = [F.concat(F.lit('{"overview_zh":" o'), key, F.lit(' "}')), F.concat(F.lit('```json\n{"overview_zh":"o'), key, F.lit('"}\n```')), F.concat(F.lit('{"overview_zh":'), key, F.lit("}")), F.concat(F.lit('{"overview":"o'), key, F.lit('"}'))]
    raw = t.responses.select("doc_id", F.element_at(F.array(*texts), (F.col("doc_id") % 4 + 1).cast("int")).alias("raw"))
    o = contracts.parse_overview(F.col("payload"))
    return contracts.extract_objects(raw).select("doc_id", o["overview_zh"].alias("overview_zh"), o["error"].alias("error"))


_CUT = "CASE WHEN length(i.content_text) > 4000 THEN substr(i.content_text, 1, 3000) || chr(10) || chr(10) || '...[truncated]...' || chr(10) || chr(10) || right(i.content_text, 500) ELSE coalesce(i.content_text, '') END"


@query("stage1_requests", f"""
SELECT i.id, i.title, i.canonical_url, s.name AS source_name, s.authority AS source_authority, strftime(i.published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, sha256({_CUT}) AS content_sha256, length(i.content_text) > 4000 AS truncated
FROM b_items i LEFT JOIN b_sources s ON s.id = i.source_id""")
def stage1_requests(t: Tables):
    """The payloads, read back field by field."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    asked = ops.stage1_requests(t.items, t.sources)
    return asked.select("id", *(get(k).alias(k) for k in ("title", "canonical_url", "source_name", "source_authority", "published_at")), F.sha2(get("content_text"), 256).alias("content_sha256"), (get("content_truncated") == "true").alias("truncated"))


@query("stage2_requests", """
SELECT i.id, i.category, array_to_string(i.tags, ',') AS tags, i.summary_zh, i.insight_score, i.credibility, s.name AS source_name, s.authority AS source_authority, i.n_occ AS sightings
FROM b_items i LEFT JOIN b_sources s ON s.id = i.source_id WHERE i.insight_score >= 75""")
def stage2_requests(t: Tables):
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    seen = t.table("b_occurrences").groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("source_id", "url"))).alias("also_seen_in"))
    asked = ops.stage2_requests(t.items.filter(F.col("insight_score") >= ops.STAGE2_FROM).join(seen, "id", "left"), t.sources)
    tags = F.array_join(F.from_json(get("tags"), "array<string>"), ",")
    return asked.select("id", *(get(k).alias(k) for k in ("category", "summary_zh", "credibility", "source_name", "source_authority")), get("insight_score").cast("int").alias("insight_score"), tags.alias("tags"), F.coalesce(F.json_array_length(get("also_seen_in")), F.lit(0)).alias("sightings"))


def rule_scorer(payload: str) -> str:
    """A deterministic stand-in for a model: the score follows the length of the content; some first answers are broken."""
    text = payload[payload.index("{") :]
    item = json.loads(text)
    n = len(item["content_text"])
    if n % 5 == 0 and payload[0] == "{":
        return "no object here"
    return json.dumps({"category": "tool" if n % 2 else "research", "tags": [item["source_name"]], "summary_zh": item["title"][:20].strip() or "-", "insight_score": n % 101, "credibility": "low"})


@query("scored_items", """
SELECT id, CAST(length(CASE WHEN length(content_text) > 4000 THEN substr(content_text, 1, 3000) || '123456789012345678901' || right(content_text, 500) ELSE content_text END) % 101 AS INT) AS insight_score, CAST(NULL AS VARCHAR) AS error FROM b_items""")
def scored_items(t: Tables):
    found = ops.score(ops.stage1_requests(t.items, t.sources), rule_scorer, 4, contracts.parse_stage1)
    return found.select("id", F.col("outcome.insight_score").alias("insight_score"), F.col("outcome.error").alias("error"))


@query("score_tally", f"""WITH {_S1} SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE insight_score >= 75) AS stage2_total FROM s1""")
def score_tally(t: Tables):
    o = F.col("outcome")
    return _stage1(t).agg(F.count("*").alias("total"), F.count_if(o["error"].isNull()).alias("succeeded"), F.count_if(o["error"].isNotNull()).alias("failed"), F.count_if(o["insight_score"] >= 75).alias("stage2_total"))
