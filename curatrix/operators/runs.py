"""Runs: windows, progress, status and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso
from .digest import file_name


def run_window(runs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """From the end of the latest succeeded run, or else ``hours`` ago, to now. One row, also without runs."""
    end = F.lit(now).cast("timestamp_ntz")
    last = F.max(F.when(F.col("status") == "succeeded", F.col("window_end")))
    return runs.agg(F.coalesce(last, end - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("window_start"), end.alias("window_end"))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


#: States in which a source is done.
DONE = ("succeeded", "failed", "skipped")


def progress(sources_done: Column, sources: Column, s1_done: Column, s1: Column, s2_done: Column, s2: Column, digest: Column) -> Column:
    """Share of a run that is done: sources 0.3, stage one 0.4, stage two 0.2 (of both, what succeeded), digest 0.1."""
    done = F.when(digest.isin("succeeded", "partial"), 1.0).otherwise(0.0)
    return F.round(0.3 * ratio(sources_done, sources) + 0.4 * ratio(s1_done, s1) + 0.2 * ratio(s2_done, s2) + 0.1 * done, 2)


def digest_status(results: DataFrame, key: str) -> DataFrame:
    """One status from the domains' results (columns key, status; a null status is no result)."""
    known = results.groupBy(key).agg(F.count("status").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "skipped")))
    return known.select(key, status_of(F.col("n"), F.col("succeeded"), F.col("failed"), F.col("skipped")).alias("digest_status"))


def status_of(n: Column, succeeded: Column, failed: Column, skipped: Column) -> Column:
    return (F.when(n == 0, "pending").when((succeeded > 0) & (failed > 0), "partial").when(succeeded > 0, "succeeded")
            .when((skipped == n) | (failed > 0), "failed").otherwise("pending"))


def final_status(fatal: Column, cleaned: Column, src_ok: Column, src_failed: Column, s1_total: Column, s1_ok: Column, s1_failed: Column, s2_failed: Column, digest: Column) -> Column:
    """Rules in order: what fails a run, then what makes it partial; it succeeds only with its digest."""
    return (F.when(fatal.isNotNull() | ~cleaned | (src_ok == 0), "failed").when((s1_total > 0) & (s1_ok == 0), "failed").when(digest == "failed", "failed")
            .when((src_failed > 0) | (s1_failed > 0) | (s2_failed > 0) | (digest == "partial"), "partial").when(digest == "succeeded", "succeeded").otherwise("partial"))


def with_digest(runs: DataFrame) -> DataFrame:
    """Runs with the status of both domains' digests."""
    both = F.array("digest_security", "digest_ai")
    n = lambda s: F.size(F.filter(both, lambda x: x == s))
    return runs.withColumn("digest_status", status_of(F.size(F.array_compact(both)), n("succeeded"), n("failed"), n("skipped")))


def stale(runs: DataFrame, now: str, hours: int = 12) -> DataFrame:
    """Running runs older than ``hours`` fail as ``stale_timeout``; ``blocks`` marks those that are young and make a new run skip."""
    old = F.col("started_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    running = F.col("status") == "running"
    return runs.withColumn("blocks", running & ~old).withColumn("error", F.when(running & old, "stale_timeout")).withColumn("status", F.when(running & old, "failed").otherwise(F.col("status")))


def step_state(total: Column, ok: Column, failed: Column, running: Column) -> Column:
    return F.when(total == 0, "pending").when(ok + failed < total, F.when(running, "running").otherwise("warn")).when(ok == 0, "fail").when(failed > 0, "warn").otherwise("ok")


#: What a run's document says of a source before its result, and of a digest.
PENDING = {"status": "pending", "items": 0, "duration_s": 0.0}
DIGEST_FIELDS = ("status", "digest_id", "hexo_path", "oss_url", "error")


def stats_document(runs: DataFrame, results: DataFrame, digests: DataFrame) -> DataFrame:
    """(id, stats_json): one JSON document a run, an entry for each source (pending without a result), the stages' tallies, counters and
    the digests.

    runs: id, source_ids (those that the run was started with; a result of any other counts too), stage1_ and stage2_ total, ok and failed,
    dedup_skipped, retention_deleted. results: run_id, source_id, status, items, duration_s, error (null: left out). digests: run_id,
    domain and DIGEST_FIELDS, of which those that are null are in the document, as a domain without a result is.
    """
    started = runs.select(F.col("id").alias("run_id"), F.explode("source_ids").alias("source_id")).distinct()
    entries = started.join(results, ["run_id", "source_id"], "full_outer")
    entries = entries.select("run_id", "source_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in PENDING.items()), "error")
    body = F.struct("source_id", F.struct("status", "items", "duration_s", "error"))
    by_source = entries.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(body))).alias("sources"))  # as many as there are sources
    told = F.struct(*DIGEST_FIELDS)
    n = lambda s: F.count_if(F.col("status") == s)
    by_digest = digests.groupBy("run_id").agg(status_of(F.count("status"), n("succeeded"), n("failed"), n("skipped")).alias("status"), *(F.any_value(F.when(F.col("domain") == d, told), True).alias(d) for d in ("security", "ai")))
    stage = lambda k: F.struct(F.col(f"{k}_total").alias("total"), F.col(f"{k}_ok").alias("succeeded"), F.col(f"{k}_failed").alias("failed"))
    rows = runs.join(by_source.withColumnRenamed("run_id", "id"), "id", "left").join(by_digest.withColumnRenamed("run_id", "id").withColumnRenamed("status", "digest_status"), "id", "left")
    digest = F.struct(F.coalesce("digest_status", F.lit("pending")).alias("status"), F.col("security"), F.col("ai"))
    sources = F.to_json(F.coalesce("sources", F.create_map().cast("map<string,struct<status:string,items:bigint,duration_s:double,error:string>>")))
    rest = F.to_json(F.struct(stage("stage1").alias("stage1"), stage("stage2").alias("stage2"), "dedup_skipped", "retention_deleted", digest.alias("digest")), {"ignoreNullFields": "false"})
    return rows.select("id", F.concat(F.lit('{"sources":'), sources, F.lit(","), F.substring(rest, F.lit(2), F.length(rest))).alias("stats_json"))


def document_sources(runs: DataFrame) -> DataFrame:
    """(id, source_id, status, items, duration_s, error): the entries of sources in the stored documents of runs (id, stats_json)."""
    docs = runs.select("id", F.try_parse_json("stats_json").alias("doc")).select("id", F.try_variant_get("doc", "$.sources", "variant").alias("sources"))
    walked = runs.sparkSession.sql("SELECT d.id, s.key AS source_id, s.value FROM {docs} d, LATERAL variant_explode(d.sources) s", docs=docs)
    get = lambda k, t: F.try_variant_get("value", f"$.{k}", t).alias(k)
    return walked.select("id", "source_id", get("status", "string"), get("items", "bigint"), get("duration_s", "double"), get("error", "string"))


def from_documents(runs: DataFrame) -> DataFrame:
    """(id, progress, and what decides a run's status) of runs (id, stats_json), all of it read from the stored documents.

    A document that is null or no JSON says nothing: no progress, no sources. Only successes of the two stages count as progress.
    """
    state = F.col("status")
    tally = document_sources(runs).groupBy(F.col("id").alias("of_id")).agg(F.count("*").alias("sources"), F.count_if(state.isin(*DONE)).alias("sources_done"), F.count_if(state == "succeeded").alias("sources_ok"), F.count_if(state == "failed").alias("sources_failed"))
    doc = F.try_parse_json("stats_json")
    number = lambda stage, k: F.coalesce(F.try_variant_get(doc, f"$.{stage}.{k}", "bigint"), F.lit(0)).alias(f"{stage}_{k}")
    told = runs.select("id", *(number(stage, k) for stage in ("stage1", "stage2") for k in ("total", "succeeded", "failed")), F.try_variant_get(doc, "$.digest.status", "string").alias("digest_status"))
    rows = told.join(tally, F.col("id") == F.col("of_id"), "left").drop("of_id").na.fill(0, ["sources", "sources_done", "sources_ok", "sources_failed"])
    c = F.col
    done = progress(c("sources_done"), c("sources"), c("stage1_succeeded"), c("stage1_total"), c("stage2_succeeded"), c("stage2_total"), F.coalesce("digest_status", F.lit("")))
    return rows.withColumn("progress", done)


def status_from_documents(runs: DataFrame, fatal: Column, cleaned: Column) -> DataFrame:
    """(id, final_status) by the stored documents. fatal, cleaned: columns of the runs, an error or null and whether the clean-up ended."""
    c = F.col
    rows = from_documents(runs).join(runs.select(c("id").alias("of_id"), fatal.alias("fatal"), cleaned.alias("cleaned")), c("id") == c("of_id"))
    return rows.select("id", final_status(c("fatal"), c("cleaned"), c("sources_ok"), c("sources_failed"), c("stage1_total"), c("stage1_succeeded"), c("stage1_failed"), c("stage2_failed"), F.coalesce("digest_status", F.lit(""))).alias("final_status"))


def finish(stored: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with the end of those in ``finished`` (id, status, finished_at, stats_json, error_json); one that is not stored is an error of the
    caller's and stays out."""
    ends = finished.select("id", *(F.col(c).alias(f"new_{c}") for c in ("status", "finished_at", "stats_json", "error_json")), F.lit(True).alias("ended"))
    return stored.join(ends, "id", "left").select(*(F.when(F.col("ended"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in ends.columns else F.col(c) for c in stored.columns))


def view(runs: DataFrame) -> DataFrame:
    """What an API shows of a run (its progress comes from its document)."""
    times = ("window_start", "window_end", "started_at", "finished_at")
    done = from_documents(runs).select(F.col("id").alias("of_id"), "progress")
    return runs.join(done, F.col("id") == F.col("of_id")).select("id", "kind", "status", *(iso(F.col(c)).alias(c) for c in times), "progress", "stats_json")


def latest_finished(runs: DataFrame) -> DataFrame:
    return runs.filter("finished_at IS NOT NULL").orderBy(F.desc("finished_at"), "id").limit(1)


def audit(runs: DataFrame, items: DataFrame, digests: DataFrame, results: DataFrame, least_items: int, least_analysed: int, least_digests: int, domains: tuple[str, ...] = ("security", "ai"), accepted: tuple[str, ...] = ("succeeded",), posts: DataFrame | None = None) -> DataFrame:
    """Each of the runs (id, status) with its evidence and its error codes, in a fixed order; without any run one row that says so.

    items: run_id, analysis_stage; digests: run_id, domain, id, has_content; results: what the run's document says of its digests,
    run_id, domain, status, digest_id. A digest counts only with content. posts: optional table of the posts folder (file), in which each
    digest (column day) must have its file.
    """
    found = items.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("items"), F.count_if(F.col("analysis_stage") >= 1).alias("analysed"))
    file = file_name(F.col("domain"), F.col("day")) if posts is not None else F.lit(None).cast("string")
    made = digests.filter("has_content").select(F.col("run_id").alias("id"), "domain", F.col("id").alias("made_id"), file.alias("post"))
    if posts is not None:
        there = posts.select(F.col("file").alias("of_post")).distinct()
        made = made.join(there, F.col("post") == F.col("of_post"), "left").withColumn("post", F.when(F.col("of_post").isNull(), F.col("post"))).drop("of_post")
    made = made.withColumnRenamed("post", "lost_post")
    told = results.select(F.col("run_id").alias("id"), "domain", F.col("status").alias("told_status"), F.col("digest_id").alias("told_id"))
    both = made.join(told, ["id", "domain"], "full_outer").groupBy("id")
    pick = lambda c, d: F.max(F.when(F.col("domain") == d, F.col(c))).alias(f"{c}_{d}")
    evidence = both.agg(F.count_distinct(F.when(F.col("made_id").isNotNull(), F.col("domain"))).alias("digests"), *(pick(c, d) for d in domains for c in ("made_id", "told_status", "told_id", "lost_post")))
    row = runs.select("id", "status").join(found, "id", "left").join(evidence, "id", "left").na.fill(0, ["items", "analysed", "digests"])
    few = lambda name, n, least: F.when(n < least, F.concat(F.lit(f"{name}_below_min:"), n, F.lit(f"<{least}")))
    errors = [F.when(~F.col("status").isin(*accepted), F.concat(F.lit("run_status_"), "status")), few("items", F.col("items"), least_items), few("analyzed", F.col("analysed"), least_analysed), few("digests", F.col("digests"), least_digests)]
    for d in domains:
        there = F.col(f"made_id_{d}").isNotNull()
        errors += [F.when(~there, F.lit(f"missing_digest:{d}")), F.when(there & ~F.coalesce(F.col(f"told_status_{d}") == "succeeded", F.lit(False)), F.lit(f"digest_not_succeeded:{d}")),
                   F.when(there & (F.coalesce(F.col(f"told_id_{d}"), F.lit("")) != "") & (F.col(f"told_id_{d}") != F.col(f"made_id_{d}")), F.lit(f"digest_id_mismatch:{d}")), F.concat(F.lit("missing_hexo_file:"), F.col(f"lost_post_{d}"))]
    judged = row.select("id", "status", "items", "analysed", "digests", F.array_join(F.array_compact(F.array(*errors)), ",").alias("errors"))
    none = runs.agg(F.count("*").alias("n")).filter("n = 0").select(*(F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in ("id", "status")), *(F.lit(0).cast("long").alias(c) for c in ("items", "analysed", "digests")), F.lit("no_finished_run").alias("errors"))
    return judged.unionByName(none)
