"""Source catalog, fetch attempts and source health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENUMS = {"domain": ("security", "ai", "finance"), "authority": ("official", "authoritative", "regular"), "status": ("approved", "candidate", "disabled"), "health": ("good", "degraded", "disabled")}
#: Failures in a row at which a source is disabled.
DISABLED_AFTER = 3


def eligible(sources: DataFrame, domains: tuple[str, ...], approved: DataFrame) -> DataFrame:
    """Active, approved, not disabled, of the domains, and among the catalog's approved ids."""
    return sources.filter(F.col("is_active") & (F.col("status") == "approved") & (F.col("health") != "disabled") & F.col("domain").isin(*domains)).join(approved.select("id").distinct(), "id", "left_semi")


def parser(name: str = "name", kind: str = "type"):
    """Which reader a source goes to: the first rule that fits; null for none."""
    what = F.lower(F.concat_ws(" ", name, kind))
    rules = (("nvd", "nvd"), ("github", "github"), ("hackernews", "hackernews"), ("l1_rss", "rss"), ("l1_api", "api"))
    out = F.lit(None).cast("string")
    for mark, reader in reversed(rules):
        out = F.when(what.contains(mark), reader).otherwise(out)
    return out


def upsert_catalog(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Configured columns come from the catalog; health, failures and last fetch stay. Sources not in the catalog stay as they are."""
    configured = [c for c in catalog.columns if c != "id"]
    new = catalog.select("id", *(F.col(c).alias(f"new_{c}") for c in configured), F.lit(True).alias("configured"))
    both = sources.join(new, "id", "full_outer")
    kept = {"health": F.lit("good"), "consecutive_failures": F.lit(0)}
    columns = [F.when(F.col("configured"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in configured else F.coalesce(F.col(c), kept[c]).alias(c) if c in kept else F.col(c) for c in sources.columns]
    return both.select(*columns)


def health_fold(attempts: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Each source's failures since its last success, in order of (attempt_at, event_id), and the health that follows.

    initial: optional (source_id, consecutive_failures) before the first attempt; it counts while no attempt succeeded. Two
    aggregates, the last success and what came after it, so that a source with most of the log is combined before any shuffle.
    """
    order = F.struct("attempt_at", "event_id")
    good = attempts.filter("ok").groupBy("source_id").agg(F.max(order).alias("last_ok"))
    after = F.col("last_ok").isNull() | (order > F.col("last_ok"))
    last = attempts.join(good, "source_id", "left").groupBy("source_id").agg(F.count_if(~F.col("ok") & after).alias("failures"), F.max_by("error", order).alias("error"), F.max("attempt_at").alias("last_at"), F.any_value(F.col("last_ok").isNull()).alias("never"))
    if initial is not None:
        last = last.join(initial.withColumnRenamed("consecutive_failures", "before"), "source_id", "left").withColumn("failures", F.col("failures") + F.when(F.col("never"), F.coalesce("before", F.lit(0))).otherwise(0))
    health = F.when(F.col("failures") >= DISABLED_AFTER, "disabled").when(F.col("failures") > 0, "degraded").otherwise("good")
    return last.select("source_id", F.col("failures").cast("long").alias("consecutive_failures"), health.alias("health"), F.coalesce("error", F.lit("succeeded")).alias("last_status"), "last_at")


def fetch_stats(attempts: DataFrame, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Per source, and per run where ``by`` names one: the last attempt's status, seconds (to three places) and error, and all items."""
    last = F.struct("attempt_at", "event_id")
    return attempts.groupBy(*by).agg(
        F.max_by(F.when(F.col("ok"), "succeeded").otherwise("failed"), last).alias("status"), F.sum("n_items").alias("items"),
        F.max_by(F.round(F.col("duration_ds") / 10, 3), last).alias("duration_s"), F.max_by("error", last).alias("error"))


def feed_gate(attempts: DataFrame, least_ok: int, sources: DataFrame | None = None, include_internal: bool = False) -> DataFrame:
    """ok, empty or failed sources by their last attempt, how many were left out, and whether enough are ok.

    sources: optional (id, type); those of type ``internal_api`` are left out unless asked for.
    """
    last = attempts.groupBy("source_id").agg(F.max_by(F.struct("ok", "n_items"), F.struct("attempt_at", "event_id")).alias("x"))
    skip = F.lit(False)
    if sources is not None and not include_internal:
        last = last.join(sources.select(F.col("id").alias("source_id"), "type"), "source_id", "left")
        skip = F.coalesce(F.col("type") == "internal_api", F.lit(False))
    state = F.when(skip, "skipped").when(~F.col("x.ok"), "failed").when(F.col("x.n_items") > 0, "ok").otherwise("empty")
    return last.agg(*(F.count_if(state == s).alias(s) for s in ("ok", "empty", "failed", "skipped"))).withColumn("passed", F.col("ok") >= least_ok)


def table_quality(table: DataFrame, required: tuple[str, ...], enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows, and how many break each rule; one pass."""
    return table.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull() | (F.trim(F.col(c)) == "")).alias(f"missing_{c}") for c in required), *(F.count_if(~F.coalesce(F.col(c), F.lit("")).isin(*v)).alias(f"bad_{c}") for c, v in enums.items()))


def cap_per_domain(items: DataFrame, cap: int, order: tuple[str, ...]) -> DataFrame:
    """The first ``cap`` items of each domain in order of arrival; ranking stops at the cap in each partition."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    return items.withColumn("arrival", rank).filter(F.col("arrival") <= cap)
