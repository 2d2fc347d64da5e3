"""The response contracts of the two scoring stages and of the digest overview."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import strip

#: What a response may say.
CATEGORIES = ("vulnerability", "exploit", "research", "product", "engineering", "tool", "incident", "discussion", "other")
CREDIBILITIES = ("high", "medium", "low", "unknown")
TRENDS = ("emerging", "growing", "stable", "declining")
MOST_TAGS, MOST_CHARS, HEAD_CHARS, TAIL_CHARS = 12, 4000, 3000, 500
MARKER = "\n\n...[truncated]...\n\n"
PARSE_ERROR = "model_parse_error"


def prepare_content(text: Column) -> Column:
    """Struct (text, truncated): a long text keeps its head, a marker and its tail."""
    text = F.coalesce(text, F.lit(""))
    long = F.length(text) > MOST_CHARS
    cut = F.concat(F.substring(text, 1, HEAD_CHARS), F.lit(MARKER), F.right(text, F.lit(TAIL_CHARS)))
    return F.struct(F.when(long, cut).otherwise(text).alias("text"), long.alias("truncated"))


def strip_fence(raw: Column) -> Column:
    """The inside of a fenced block, if the whole response is one."""
    inner = F.regexp_extract(raw, r"(?s)^\s*```[A-Za-z]*\s*\n?(.*?)\s*```\s*$", 1)
    return F.when(raw.rlike(r"(?s)^\s*```.*```\s*$"), inner).otherwise(strip(raw))


def _scan(text: str | None) -> str | None:
    """The first object that can be decoded anywhere in a text."""
    decoder, at = json.JSONDecoder(), 0
    while text and (at := text.find("{", at)) >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(found, dict):
            return json.dumps(found)
        at += 1
    return None


def extract_objects(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """``responses`` with ``payload``, the JSON object of each response or null.

    Clean and fenced responses are read natively; only the rest goes through Arrow to a scan for the first object in the text.
    """

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(payload=rows[raw].map(_scan).astype(object).where(lambda x: x.notna(), None))

    inner = strip_fence(F.col(raw))
    is_object = inner.startswith("{") & F.is_valid_utf8(inner) & F.try_parse_json(inner).isNotNull()
    marked = responses.withColumn("payload", F.when(is_object, inner))
    clean, rest = marked.filter("payload IS NOT NULL"), marked.filter("payload IS NULL")
    return clean.unionByName(rest.mapInPandas(scanned, marked.schema))


def _field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def _one_of(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    value = F.lower(strip(value))
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def _required(payload: Column, name: str) -> Column:
    """A field that must be a string of JSON and say something; a number, a list or an object doesn't count."""
    parsed = F.try_parse_json(payload)
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.nullif(strip(F.try_variant_get(parsed, f"$.{name}", "string")), F.lit("")))


def parse_stage1(payload: Column) -> Column:
    """Struct (category, tags, summary_zh, insight_score, credibility, error).

    The score must be a finite number (no boolean); it is rounded half to even and clamped. Without it, or without a
    summary, or with tags that are no list, there is an error and nothing else.
    """
    raw = _field(payload, "insight_score")
    boolean = raw.isin("true", "false")
    number = F.when(~boolean, raw.try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e300)
    score = F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(number, 0))).cast("int"))
    summary = _required(payload, "summary_zh")
    listed = F.coalesce(_field(payload, "tags"), F.lit("[]"))
    tags = F.from_json(F.when(listed.startswith("["), listed), "array<string>")
    tags = F.slice(F.filter(F.transform(tags, strip), lambda t: t != ""), 1, MOST_TAGS)
    ok = payload.isNotNull() & score.isNotNull() & summary.isNotNull() & tags.isNotNull()
    return F.struct(
        F.when(ok, _one_of(_field(payload, "category"), CATEGORIES, "other")).alias("category"), F.when(ok, tags).alias("tags"), F.when(ok, summary).alias("summary_zh"),
        F.when(ok, score).alias("insight_score"), F.when(ok, _one_of(_field(payload, "credibility"), CREDIBILITIES, "unknown")).alias("credibility"), F.when(~ok, F.lit(PARSE_ERROR)).alias("error"),
    )


def parse_stage2(payload: Column, confidence: Column) -> Column:
    """Struct (recommendation_reason, action_suggestion, trend_signal, confidence, error). The confidence is ours, not the model's."""
    reason, action = _required(payload, "recommendation_reason"), _required(payload, "action_suggestion")
    ok = payload.isNotNull() & reason.isNotNull() & action.isNotNull()
    return F.struct(F.when(ok, reason).alias("recommendation_reason"), F.when(ok, action).alias("action_suggestion"), F.when(ok, _one_of(_field(payload, "trend_signal"), TRENDS, None)).alias("trend_signal"), F.when(ok, confidence).alias("confidence"), F.when(~ok, F.lit(PARSE_ERROR)).alias("error"))


def parse_overview(payload: Column) -> Column:
    """Struct (overview_zh, error)."""
    text = _required(payload, "overview_zh")
    return F.struct(text.alias("overview_zh"), F.when(text.isNull(), F.lit(PARSE_ERROR)).alias("error"))
