"""From raw items to the items table: normalising, first sightings, and the keyed merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import derive_confidence
from ..functions.times import iso
from ..functions.urls import canonicalize_url, dedup_hash, item_id, strip


def not_before(at: Column, since: str) -> Column:
    """A time filter that lets items without a time pass."""
    return at.isNull() | (at >= F.lit(since).cast("timestamp_ntz"))


def has_keyword(keywords: tuple[str, ...], *fields: str) -> Column:
    """Any keyword as a substring of the fields, whatever the case; no keywords let all pass."""
    if not keywords:
        return F.lit(True)
    text = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(False)
    for k in keywords:
        out = out | text.contains(k.lower())
    return out


#: Why an item is rejected.
REASONS = ("unknown_source", "empty", "future")


def normalize(raw: DataFrame, sources: DataFrame, now: str, ahead_days: int = 7) -> DataFrame:
    """Raw items with their source's domain and authority, trimmed fields, canonical URL, hash, id and ``reject_reason`` (null: good).
    Where raw items don't say when they were fetched or by whom they are, that is ``now`` and nobody.

    The sources are a catalog of some dozens and joined by broadcast only as Spark's threshold allows.
    """
    known = sources.select(F.col("id").alias("source_id"), "domain", "authority")
    joined = raw.join(known, "source_id", "left")
    title, content = F.coalesce(strip(F.col("title")), F.lit("")), F.coalesce(strip(F.col("content_text")), F.lit(""))
    hashed = dedup_hash(F.col("canonical_url"), F.col("title"), F.col("content_text"), F.col("source_id"))
    far = F.col("published_at") > F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(ahead_days))
    fetched = F.coalesce("fetched_at", F.lit(now).cast("timestamp_ntz")) if "fetched_at" in raw.columns else F.lit(now).cast("timestamp_ntz")
    author = F.col("author") if "author" in raw.columns else F.lit(None).cast("string")
    reason = F.when(F.col("domain").isNull(), "unknown_source").when((title == "") & (content == ""), "empty").when(far, "future")
    return joined.select("batch_id", "pos", "source_id", "domain", "authority", F.when(title == "", F.substring(content, 1, 200)).otherwise(title).alias("title"), content.alias("content_text"),
                         canonicalize_url(F.col("canonical_url")).alias("canonical_url"), hashed.alias("dedup_hash"), item_id(F.col("source_id"), F.col("native_id"), hashed).alias("id"), author.alias("author"), "published_at", fetched.alias("fetched_at"), reason.alias("reject_reason"))


def winners(items: DataFrame) -> DataFrame:
    """The first item of each dedup_hash by (batch_id, pos, source_id)."""
    rank = F.row_number().over(Window.partitionBy("dedup_hash").orderBy("batch_id", "pos", "source_id"))
    return items.withColumn("nth", rank).filter("nth = 1").drop("nth")


#: What is known of an item from its first sighting, and the type of the later ones.
FACTS = ("id", "source_id", "domain", "authority", "title", "content_text", "canonical_url", "author", "published_at", "fetched_at")
OCCURRENCES = "array<struct<source_id:string,url:string,seen_at:string>>"


def merge_items(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The items table after a batch: new hashes insert, known ones from other sources add a sighting each (the first of its
    source and URL, with its time) and refresh the confidence of items at stage 2, the same source counts as a duplicate only.

    stored: the table as this function returns it; None for an empty one. Merging a batch twice changes nothing more.
    """
    facts = FACTS
    own = F.struct("source_id", F.col("canonical_url").alias("url"), iso(F.col("fetched_at")).alias("seen_at"))
    rows = batch.filter("reject_reason IS NULL")
    seen = rows.select("dedup_hash", *facts, F.lit(1).alias("is_new"), F.lit(0).alias("analysis_stage"), F.lit(None).cast("string").alias("confidence"), F.struct("batch_id", "pos", "source_id").alias("at"), F.array(own).alias("seen"))
    if stored is not None:
        first = F.struct(F.lit(-1).alias("batch_id"), F.lit(-1).cast("long").alias("pos"), F.lit("").alias("source_id"))
        old = stored.select("dedup_hash", *facts, F.lit(0).alias("is_new"), "analysis_stage", "confidence", first.alias("at"), F.concat(F.array(own), "also_seen_in").alias("seen"))
        seen = seen.withColumn("at", F.col("at").cast("struct<batch_id:int,pos:bigint,source_id:string>")).unionByName(old)
    order = F.struct("is_new", "at")
    # Sightings are made distinct by (hash, source, URL) before they are gathered, so a hot hash gathers no more than its sources and URLs.
    each = seen.select("dedup_hash", "is_new", "at", F.posexplode("seen").alias("k", "s")).groupBy("dedup_hash", F.col("s.source_id").alias("source_id"), F.col("s.url").alias("url")).agg(F.min(F.struct("is_new", "at", "k", F.col("s.seen_at").alias("seen_at"))).alias("first"))
    gathered = each.groupBy("dedup_hash").agg(F.array_sort(F.collect_list(F.struct("first", "source_id", "url"))).alias("all"))
    best = seen.groupBy("dedup_hash").agg(F.min_by(F.struct(*facts, "analysis_stage", "confidence"), order).alias("x"), F.count("*").alias("n"))
    rows = best.join(gathered, "dedup_hash").select("dedup_hash", "x.*", "n", "all")
    others = F.transform(F.filter("all", lambda s: s["source_id"] != F.col("source_id")), lambda s: F.struct(s["source_id"].alias("source_id"), s["url"].alias("url"), s["first"]["seen_at"].alias("seen_at")))
    rows = rows.withColumn("also_seen_in", others)
    fresh = F.when(F.col("analysis_stage") < 2, F.col("confidence")).otherwise(derive_confidence(F.col("authority"), F.size("also_seen_in")))
    return rows.select("dedup_hash", *facts, "analysis_stage", fresh.alias("confidence"), "also_seen_in")
