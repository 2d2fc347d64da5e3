"""Listing, searching and paging of items."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.times import iso

#: What a listing shows of an item: neither its content nor its errors.
SHOWN = ("id", "source_id", "domain", "title", "canonical_url", "author", "published_at", "fetched_at", "also_seen_in", "category", "tags", "summary_zh", "insight_score", "credibility", "confidence", "trend_signal",
         "recommendation_reason", "action_suggestion", "analysis_stage", *(f"stage{k}_{c}" for k in (1, 2) for c in ("model", "provider", "prompt_version", "analyzed_at")), "expires_at")


def view(items: DataFrame) -> DataFrame:
    """The listing's columns, times in ISO form; columns that the table lacks are null."""
    times = ("published_at", "fetched_at", "stage1_analyzed_at", "stage2_analyzed_at", "expires_at")
    return items.select(*(F.lit(None).cast("string").alias(c) if c not in items.columns else iso(F.col(c)).alias(c) if c in times else F.col(c) for c in SHOWN))


def filtered(items: DataFrame, domain: str = "all", category: str | None = None, min_score: int | None = None, stage: int | None = None, confidence: str | None = None, trend: str | None = None, source_id: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Optional predicates, all pushed to the scan; times are inclusive."""
    out = items if domain == "all" else items.filter(F.col("domain") == domain)
    for column, value in (("category", category), ("analysis_stage", stage), ("confidence", confidence), ("trend_signal", trend), ("source_id", source_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if min_score is not None:
        out = out.filter(F.col("insight_score") >= min_score)
    if since:
        out = out.filter(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        out = out.filter(F.col("published_at") <= F.lit(until).cast("timestamp_ntz"))
    return out


def dashboard(items: DataFrame, domain: str | None = None, min_score: int = 0, text: str = "", show_low: bool = False) -> DataFrame:
    """The dashboard's filter: no score counts as 0; the title is searched without case, the summary with it."""
    score = F.coalesce("insight_score", F.lit(0))
    out = items.filter(score >= (min_score if show_low else max(min_score, scores.LOW)))
    if domain:
        out = out.filter(F.col("domain") == domain)
    if text:
        out = out.filter(F.lower("title").contains(text.lower()) | F.coalesce("summary_zh", F.lit("")).contains(text))
    return out


def _terms(search: str) -> tuple[list[str], list[str], list[str]]:
    """Optional, required and excluded terms: ``+must``, ``-not``, ``"a phrase"``, others optional."""
    some, must, never = [], [], []
    for sign, phrase, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', search.lower()):
        if term := phrase or word:
            {"+": must, "-": never}.get(sign, some).append(term)
    return some, must, never


def _hits(haystack: Column, term: str) -> Column:
    """How often a term stands in a text, from what its removal takes away."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(term), F.lit("")))) / len(term)).cast("int")


def search(items: DataFrame, text: str, fields: tuple[str, ...] = ("title", "summary_zh", "content_text")) -> DataFrame:
    """Items that match, with ``relevance``, the number of hits of the terms looked for. A defined subset of boolean search on substrings."""
    some, must, never = _terms(text)
    haystack = F.lower(F.concat_ws("\n", *fields))
    out = items.withColumn("relevance", sum((_hits(haystack, t) for t in some + must), F.lit(0)).cast("long"))
    for term in must:
        out = out.filter(haystack.contains(term))
    for term in never:
        out = out.filter(~haystack.contains(term))
    return out.filter(F.col("relevance") > 0) if some and not must else out


def cursor(score: int | None, item_id: str, relevance: int | None = None) -> str:
    """Opaque page token; no score is -1, which is also how rows are ordered and compared."""
    body = {"score": -1 if score is None else score, "id": item_id} | ({} if relevance is None else {"relevance": relevance})
    return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")


def parse_cursor(token: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))


def page(items: DataFrame, limit: int, after: str | None = None) -> DataFrame:
    """The next ``limit`` items and one more, if there is one, by (relevance, score, id)."""
    ranked = "relevance" in items.columns
    key = F.coalesce("insight_score", F.lit(-1))
    out = items
    if after:
        at = parse_cursor(after)
        past: Column = (key < at["score"]) | ((key == at["score"]) & (F.col("id") > at["id"]))
        if ranked:
            past = (F.col("relevance") < at["relevance"]) | ((F.col("relevance") == at["relevance"]) & past)
        out = out.filter(past)
    return out.orderBy(*([F.desc("relevance")] if ranked else []), key.desc(), F.asc("id")).limit(limit + 1)
