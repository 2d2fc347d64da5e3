"""Daily digests: selection, highlights, markdown and its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.contracts import parse_overview
from ..functions.times import digest_date
from .scoring import score

#: Category labels and texts of the digest.
LABELS = {"vulnerability": "漏洞披露", "exploit": "武器化 / PoC", "research": "研究分析", "product": "产品发布", "engineering": "工程实践", "tool": "工具项目", "incident": "安全事件", "discussion": "社区讨论", "other": "其他"}
TITLES = {"security": "安全情报日报", "ai": "AI 情报日报"}
OTHER_TITLE, CATEGORIES_LINE, NO_HIGH, NO_LOW = "情报日报", "情报日报", "暂无高价值情报。", "暂无。"
SUMMARY = ("今日共采集 ", " 条情报，高价值 ", " 条。")


def label(category: Column) -> Column:
    out = category
    for name, text in LABELS.items():
        out = F.when(category == name, F.lit(text)).otherwise(out)
    return out


def digest_items(items: DataFrame) -> DataFrame:
    """Analysed items with a candidate's score, their digest day, and whether they are high-value."""
    chosen = items.filter(f"analysis_stage >= 1 AND insight_score >= {scores.CANDIDATE}")
    return chosen.select(digest_date(F.col("stage1_analyzed_at")).alias("day"), "domain", "id", "doc_id", "title", "source_id", F.coalesce("category", F.lit("other")).alias("category"), "summary_zh", "insight_score", "confidence", "action_suggestion",
                         (F.col("insight_score") >= scores.HIGH_VALUE).alias("high"))


def _order() -> list[Column]:
    return [F.desc("insight_score"), scores.confidence_rank(F.col("confidence")).desc(), F.asc("title"), F.asc("id")]


def highlights(chosen: DataFrame, n: int = 5) -> DataFrame:
    """The best n high-value items of each day, domain and category, with their rank; ranking stops at n in each partition."""
    rank = F.row_number().over(Window.partitionBy("day", "domain", "category").orderBy(*_order()))
    return chosen.filter("high").withColumn("rank", rank).filter(F.col("rank") <= n)


def lower_value(chosen: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("day", "domain").orderBy(*_order()))
    return chosen.filter("NOT high").withColumn("rank", rank)


#: What a model reads of a high-value item for the overview.
OVERVIEW_FIELDS = ("title", "category", "summary_zh", "insight_score", "action_suggestion")


def digest_id(day: Column, domain: Column) -> Column:
    return F.concat(day.cast("string"), F.lit(":"), domain)


def overview_requests(chosen: DataFrame, n: int = 20) -> DataFrame:
    """(id, day, domain, payload): one request for each digest, with its first n high-value items in order of arrival; a digest without any asks with
    an empty list. Fields that are null are in the payload."""
    rank = F.row_number().over(Window.partitionBy("day", "domain").orderBy("doc_id", "id"))
    first = chosen.filter("high").withColumn("rank", rank).filter(F.col("rank") <= n)
    items = first.groupBy("day", "domain").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*OVERVIEW_FIELDS).alias("item")))).alias("items"))
    every = chosen.select("day", "domain").distinct().join(items, ["day", "domain"], "left")
    listed = F.coalesce(F.transform("items", lambda x: x["item"]), F.array().cast(items.schema["items"].dataType.elementType["item"].dataType.simpleString().join(("array<", ">"))))
    body = F.to_json(F.struct("domain", listed.alias("items")), {"ignoreNullFields": "false"})
    return every.select(digest_id(F.col("day"), F.col("domain")).alias("id"), "day", "domain", body.alias("payload"))


def overviews(chosen: DataFrame, scorer: Callable[[str], str], concurrency: int = 1, log: str | None = None, prompt_version: str = "", n: int = 20) -> DataFrame:
    """(id, overview) of each digest whose response, or its repair, keeps the contract: the scorer is asked once a digest, not once an item."""
    outcomes = score(overview_requests(chosen, n).select("id", "payload"), scorer, concurrency, parse_overview, log=log, prompt_version=prompt_version)
    return outcomes.filter("outcome.error IS NULL").select("id", F.col("outcome.overview_zh").alias("overview"))


def digest_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("day", "domain").agg(F.count("*").alias("n_items"), F.count_if("high").alias("n_high"), F.count_if(~F.col("high")).alias("n_lower"))


def file_name(domain: Column, day: Column) -> Column:
    return F.concat(F.lit("intelligence-"), domain, F.lit("-"), day.cast("string"), F.lit(".md"))


def render(chosen: DataFrame, totals: DataFrame, generated_at: str, overview: DataFrame | None = None, n: int = 5) -> DataFrame:
    """One markdown text per day and domain: id, day, domain, title, summary, n_items, n_high, content and file.

    totals: day, collected, analyzed, failed_sources. overview: optional (id, overview); a digest without one has a sentence of its counts.
    A digest names every item of its day below the high-value bound, so a text grows with its day's items.
    """
    h = highlights(chosen, n)
    lines = [F.concat(F.lit("- **"), F.col("title"), F.lit("**")), F.concat(F.lit("  - score: "), F.col("insight_score")), F.concat(F.lit("  - source: "), F.col("source_id")), F.concat(F.lit("  - summary: "), F.nullif("summary_zh", F.lit(""))), F.concat(F.lit("  - action: "), F.nullif("action_suggestion", F.lit("")))]
    block = F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))
    groups = h.groupBy("day", "domain", "category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("text")))), lambda x: x["text"]), "").alias("body"))
    high = groups.groupBy("day", "domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category", F.concat(F.lit("### "), label(F.col("category")), F.lit("\n\n"), F.col("body")).alias("text")))), lambda x: x["text"]), "").alias("high_text"))
    low_line = F.concat(F.lit("- "), F.col("title"), F.lit(" (score "), F.col("insight_score"), F.lit(")"))
    low = lower_value(chosen).groupBy("day", "domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", low_line.alias("text")))), lambda x: x["text"]), "\n").alias("low_text"))
    rows = digest_counts(chosen).join(high, ["day", "domain"], "left").join(low, ["day", "domain"], "left").join(totals, "day", "left").na.fill(0, ["collected", "analyzed", "failed_sources"])
    rows = rows.withColumn("id", digest_id(F.col("day"), F.col("domain")))
    rows = rows.join(overview, "id", "left") if overview is not None else rows.withColumn("overview", F.lit(None).cast("string"))
    title = F.lit(OTHER_TITLE)
    for domain, text in TITLES.items():
        title = F.when(F.col("domain") == domain, F.lit(text)).otherwise(title)
    day = F.col("day").cast("string")
    title = F.concat(title, F.lit(" · "), day)
    counted = F.concat(F.lit(SUMMARY[0]), F.col("collected"), F.lit(SUMMARY[1]), F.col("n_high"), F.lit(SUMMARY[2]))
    summary = F.coalesce(F.nullif("overview", F.lit("")), counted)
    at = F.date_format(F.lit(generated_at).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    content = F.concat(
        F.lit("---\ntitle: "), title, F.lit("\ndate: "), at, F.lit("\ntags:\n  - intelligence\n  - "), F.col("domain"), F.lit(f"\ncategories:\n  - {CATEGORIES_LINE}\n---\n\n## Overview\n\n"), summary, F.lit("\n\n## High Value\n\n"),
        F.coalesce("high_text", F.lit(NO_HIGH + "\n\n")), F.lit("## Lower-value Mentions\n\n"), F.coalesce("low_text", F.lit(NO_LOW)),
        F.lit("\n\n## Stats\n\n- Collected: "), F.col("collected"), F.lit("\n- Analyzed: "), F.col("analyzed"), F.lit("\n- High value: "), F.col("n_high"), F.lit("\n- Failed sources: "), F.col("failed_sources"), F.lit("\n"))
    return rows.select("id", "day", "domain", title.alias("title"), summary.alias("summary"), "n_items", "n_high", content.alias("content"), file_name(F.col("domain"), F.col("day")).alias("file"))
