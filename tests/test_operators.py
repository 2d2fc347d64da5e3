"""Rules of the stateful operators on small tables."""

from __future__ import annotations

import collections
import json
import os
import subprocess
import sys

import pytest
from conftest import ROOT, SMALL
from pyspark.sql import functions as F

from curatrix.bindings import NOW, Tables
from curatrix.operators import digest, ingest, links, listing, queue, runs, scoring, sources
from curatrix.sources import layout, readers, retention, sinks
from curatrix.sources.items_table import ItemsTable
from curatrix.streaming import rollups
from curatrix.streaming.ingest import RAW, ingest_stream, read_items


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SMALL)


def rows(df):
    return sorted(map(str, df.collect()))


def test_merge_is_idempotent(t):
    batch = ingest.normalize(t.raw_items, t.sources, NOW)
    once = ingest.merge_items(batch)
    assert rows(once) == rows(ingest.merge_items(batch, once))


def test_sightings_and_confidence(spark):
    raw = spark.createDataFrame([(1, 0, "a", "T", "http://e.org/x", None, "1", None), (1, 1, "b", "T", "http://e.org/x/", None, "2", None), (2, 0, "b", "T", "http://e.org/x?ref=1", None, "3", None), (2, 1, "a", "T", "HTTP://e.org/x", None, "4", None), (2, 2, "z", "T", "http://e.org/y", None, "5", None), (2, 3, "a", " ", None, "", "6", None)],
                                "batch_id int, pos long, source_id string, title string, canonical_url string, content_text string, native_id string, published_at timestamp_ntz")
    known = spark.createDataFrame([("a", "ai", "official"), ("b", "ai", "regular")], "id string, domain string, authority string")
    normal = ingest.normalize(raw, known, NOW)
    assert {r.reject_reason: r["count"] for r in normal.groupBy("reject_reason").count().collect()} == {None: 4, "unknown_source": 1, "empty": 1}
    merged = ingest.merge_items(normal).collect()
    assert len(merged) == 1 and merged[0].id == "a:1" and [tuple(s) for s in merged[0].also_seen_in] == [("b", "http://e.org/x", "2024-01-16T12:00:00+00:00")]
    second = ingest.merge_items(normal, ingest.merge_items(normal).withColumn("analysis_stage", F.lit(2)))
    assert second.first().confidence == "confirmed"


def test_first_sighting_keeps_its_time(spark):
    raw = spark.createDataFrame([(1, 0, "a", "T", "http://e.org/x", "1", "2024-01-01 00:00:00"), (1, 1, "b", "T", "http://e.org/x", "2", "2024-01-02 00:00:00"), (2, 0, "b", "T", "http://e.org/x/", "2", "2024-01-03 00:00:00"), (2, 1, "c", "T", "http://e.org/x", "3", "2024-01-04 00:00:00")],
                                "batch_id int, pos long, source_id string, title string, canonical_url string, native_id string, fetched_at string").withColumns({"fetched_at": F.col("fetched_at").cast("timestamp_ntz"), "content_text": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp_ntz")})
    known = spark.createDataFrame([(s, "ai", "regular") for s in "abc"], "id string, domain string, authority string")
    normal = ingest.normalize(raw, known, NOW)
    for merged in (ingest.merge_items(normal), ingest.merge_items(normal.filter("batch_id = 2"), ingest.merge_items(normal.filter("batch_id = 1")))):
        assert [(s.source_id, s.seen_at) for s in merged.first().also_seen_in] == [("b", "2024-01-02T00:00:00+00:00"), ("c", "2024-01-04T00:00:00+00:00")]


def test_layers_of_buckets(spark, t, tmp_path):
    """As the merge of whole tables; stored layers are not exchanged, and another session finds the table by its folder."""
    table = ItemsTable(spark, str(tmp_path / "items"), buckets=3, most_layers=9)
    assert table.read() is None
    normal = ingest.normalize(t.raw_items, t.sources, NOW)
    expected = None
    for k in (1, 2, 3):
        table.merge(normal.filter(F.col("batch_id") == k))
        expected = ingest.merge_items(normal.filter(F.col("batch_id") == k), expected)
        assert rows(table.read().select(*expected.columns)) == rows(expected)
    before = rows(table.read())
    table.merge(normal.filter("batch_id = 2"))
    assert rows(table.read()) == before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (table.read(), table.touched(normal.filter("batch_id = 3"))):
            tree = plan._jdf.queryExecution().executedPlan().toString()
            lines = tree.split("\n")
            assert sum("Scan parquet spark_catalog.default.items_" in x for x in lines) >= 3, tree
            for k, line in enumerate(lines):
                if "Scan parquet spark_catalog.default.items_" in line:
                    depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
                    above = []
                    for up in reversed(lines[:k]):
                        d = len(up) - len(up.lstrip(" :+-*(0123456789)"))
                        if d < depth:
                            above, depth = [*above, up], d
                        if "SortMergeJoin" in up and d <= depth:
                            break
                    assert not any("Exchange" in x for x in above), tree
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in [x.name for x in spark.catalog.listTables() if x.name.startswith("items_")]:
        spark.sql(f"DROP TABLE {name}")
    again = ItemsTable(spark, str(tmp_path / "items"), buckets=5)
    assert again.buckets == 3
    assert rows(again.read()) == before
    again.compact()
    assert rows(again.read()) == before and len(again.layers()) == 1


def test_retention_drops_folders(spark, tmp_path):
    """Whole days go unread (their files are made unreadable but for the footers), the cutoff's own day is cut, others and timeless items stay."""
    items = spark.createDataFrame([(k, f"2024-01-{1 + k % 5:02d} {k % 24:02d}:00:00" if k % 7 else None) for k in range(200)], "id int, at string").withColumn("expires_at", F.col("at").cast("timestamp_ntz"))
    path = str(tmp_path / "items")
    retention.write_by_expiry(items, path)
    for file in (tmp_path / "items").glob("expires_on=2024-01-0[12]/*.parquet"):
        raw = bytearray(file.read_bytes())
        end = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
        raw[4:end] = b"\0" * (end - 4)
        file.write_bytes(raw)
        (file.parent / f".{file.name}.crc").unlink()
    cutoff = "2024-01-03 10:00:00"
    told = {r.day: r.deleted for r in retention.drop_expired(spark, path, cutoff).collect()}
    gone = [r.at[:10] for r in items.filter(F.col("expires_at") < F.lit(cutoff).cast("timestamp_ntz")).collect()]
    assert told == dict(collections.Counter(gone)) and len(told) == 3
    assert rows(retention.read_by_expiry(spark, path).select("id")) == rows(items.filter(~F.coalesce(F.col("expires_at") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))).select("id"))
    assert retention.drop_expired(spark, path, cutoff).count() == 0 and retention.drop_expired(spark, str(tmp_path / "none"), cutoff).count() == 0
    assert {r.deleted for r in retention.drop_expired(spark, path, "2024-01-04 00:00:00").collect()} == {len([0 for r in items.collect() if r.at and "2024-01-03 10" <= r.at < "2024-01-04"])}


def test_tallies_are_observed_once(spark, t, tmp_path):
    """A repeated task counts once; the raw rows are read once, and a batch of a known name is not merged."""
    path = str(tmp_path / "raw")
    t.raw_items.repartition(3).write.parquet(path)
    calls = str(tmp_path / "calls")

    def once_lost(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0 and TaskContext.get().attemptNumber() == 0 and not os.path.exists(f"{calls}.lost"):
            list(batches)
            open(f"{calls}.lost", "w").close()
        for batch in batches:
            with open(calls, "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield batch

    raw = spark.read.parquet(path)
    batch = ingest.normalize(raw.mapInArrow(once_lost, raw.schema), t.sources, NOW)
    open(f"{calls}.lost", "w").close()
    table = ItemsTable(spark, str(tmp_path / "items"), buckets=2)
    told = table.merge(batch, token="a")
    normal = ingest.normalize(raw, t.sources, NOW)
    by = {r.reject_reason: r["count"] for r in normal.groupBy("reject_reason").count().collect()}
    hashes = normal.filter("reject_reason IS NULL").select("dedup_hash").distinct().count()
    assert told == {"landed": sum(by.values()), "inserted": hashes, "duplicates": by[None] - hashes} | {f"reject_{r}": by.get(r, 0) for r in ingest.REASONS}
    assert sum(map(int, open(calls).read().split())) == raw.count()
    assert table.merge(batch, token="a") == told and len(table.layers()) == 1
    assert table.merge(batch, token="b") == told | {"inserted": 0, "duplicates": by[None]}
    run = {"dedup_skipped": told["duplicates"], "inserted": told["inserted"]}
    assert run["dedup_skipped"] + run["inserted"] == by[None]


def scanned(df):
    """Rows that the scan of a plan without exchanges gave."""
    plan = df._jdf.queryExecution().executedPlan()
    df_rows = plan.executeCollect()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value(), len(df_rows)


def test_layout_reads_what_it_needs(spark, tmp_path):
    items = spark.range(6000).select(F.concat(F.lit("s:"), F.xxhash64("id").cast("string")).alias("id"), F.when(F.col("id") % 17 != 0, (F.col("id") * 31 % 101).cast("int")).alias("insight_score"), (F.col("id") % 9).cast("string").alias("category"))
    path = str(tmp_path / "layout")
    layout.write_layout(items, path, file_rows=300)
    files = spark.read.parquet(f"{path}/index").count()
    assert files >= 15
    whole = lambda after, keep=None: [r.id for r in listing.page(items.filter(keep) if keep else items, 50, after).collect()]
    after = None
    for k in range(130):
        want = whole(after) if k % 16 == 0 else None
        found = layout.page(spark, path, 50, after).collect()
        assert want is None or [r.id for r in found] == want
        assert len(layout.page_files(spark, path, 50, after)) <= 3
        if len(found) <= 50:
            break
        after = listing.cursor(found[49].insight_score, found[49].id)
    assert k == 119
    rare = lambda d: d.filter("category = '7' AND insight_score < 20")
    assert [r.id for r in layout.page(spark, path, 50, filters=rare).collect()] == whole(None, "category = '7' AND insight_score < 20")
    assert layout.page(spark, path, 50, filters=lambda d: d.filter("false")).count() == 0
    one = items.first().id
    rows_read, found = scanned(layout.lookup(spark, path, one))
    assert found == 1 and rows_read <= 900
    assert scanned(layout.lookup(spark, path, "s:none"))[0] <= 600


def test_rollup_keeps_up(spark, t, tmp_path):
    """Equal to the counts of all items after inserts, late rows, new scores and deletions; only touched days are written."""
    items = t.items.select("doc_id", "domain", "source_id", "fetched_at", "insight_score", "stage1_error")
    path = str(tmp_path / "rollup")
    raw = items.withColumn("insight_score", F.lit(80))
    assert rollups.apply_change(spark, path, rollups.change(None, raw)) > 3
    assert rollups.apply_change(spark, path, rollups.change(raw, items)) > 3
    shown = lambda d: rows(d.filter("n <> 0").select(*rollups.KEYS, *rollups.COUNTS))
    assert shown(rollups.read_rollup(spark, path)) == shown(rollups.rollup(items))
    late = items.filter("doc_id % 50 = 7").limit(2)
    assert rollups.apply_change(spark, path, rollups.change(None, late)) <= 2
    assert shown(rollups.read_rollup(spark, path)) == shown(rollups.rollup(items.unionByName(late)))
    assert rollups.apply_change(spark, path, rollups.change(late, late)) == 0
    day = items.select(F.to_date("fetched_at").alias("d")).first().d
    gone = items.unionByName(late).filter(F.to_date("fetched_at") == F.lit(day))
    assert rollups.apply_change(spark, path, rollups.change(gone, gone.filter("false"))) == 1
    assert shown(rollups.read_rollup(spark, path)) == shown(rollups.rollup(items.unionByName(late).filter(F.to_date("fetched_at") != F.lit(day))))


def test_stream_equals_batch(spark, t, tmp_path):
    for k in (1, 2, 3):
        t.raw_items.filter(F.col("batch_id") == k).select(*(F.col(f.name).cast(f.dataType) for f in RAW.fields)).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    batches = ingest_stream(spark, str(tmp_path / "landed"), str(tmp_path / "items"), str(tmp_path / "checkpoint"), t.sources, NOW, buckets=4)
    streamed = read_items(spark, str(tmp_path / "items"))
    assert len(batches) >= 3
    normal = ingest.normalize(t.raw_items, t.sources, NOW)
    assert sum(b["landed"] for b in batches) == normal.count() and sum(b["inserted"] for b in batches) == streamed.count()
    for reason in ingest.REASONS:
        assert sum(b[f"reject_{reason}"] for b in batches) == normal.filter(F.col("reject_reason") == reason).count()
    assert ingest_stream(spark, str(tmp_path / "landed"), str(tmp_path / "items"), str(tmp_path / "checkpoint"), t.sources, NOW, buckets=4) == []
    batch = ingest.merge_items(ingest.normalize(t.raw_items, t.sources, NOW))
    shown = lambda d: rows(d.select("dedup_hash", "id", F.array_join(F.array_sort("also_seen_in.source_id"), ",")))
    assert shown(streamed) == shown(batch)


def test_pages_join_to_the_whole_order(t):
    seen, after, items = [], None, t.items.cache()
    while True:
        got = listing.page(items, 37, after).select("id", "insight_score").collect()
        seen += [r.id for r in got[:37]]
        if len(got) <= 37:
            break
        after = listing.cursor(got[36].insight_score, got[36].id)
    expected = [r.id for r in items.orderBy(F.coalesce("insight_score", F.lit(-1)).desc(), "id").collect()]
    assert seen == expected and listing.parse_cursor(listing.cursor(None, "x")) == {"score": -1, "id": "x"}


def test_search_terms(spark):
    items = spark.createDataFrame([("1", "Linux kernel", None, "a bug"), ("2", "kernel panic", "linux", None), ("3", "other", None, "nothing")], "id string, title string, summary_zh string, content_text string")
    ask = lambda q: sorted(r.id for r in listing.search(items, q).collect())
    assert ask("LINUX") == ["1", "2"] and ask("+kernel -panic") == ["1"] and ask('"linux kernel"') == ["1"] and ask("-kernel") == ["3"]


def test_progress_and_status(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    one = spark.range(1)
    assert one.select(runs.progress(*lit(1, 2, 5, 10, 1, 2, "partial")).alias("p")).first().p == 0.55
    assert one.select(runs.progress(*lit(0, 0, 0, 0, 0, 0, "pending")).alias("p")).first().p == 0
    cases = {"a": ("succeeded", "skipped"), "b": ("succeeded", "failed"), "c": ("failed", "skipped"), "d": ("skipped", "skipped"), "e": (None, None)}
    results = spark.createDataFrame([(k, s) for k, v in cases.items() for s in v], "k string, status string")
    assert {r.k: r.digest_status for r in runs.digest_status(results, "k").collect()} == {"a": "succeeded", "b": "partial", "c": "failed", "d": "failed", "e": "pending"}
    final = lambda *x: one.select(runs.final_status(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in x]).alias("s")).first().s
    assert final(None, True, 2, 0, 4, 4, 0, 0, "succeeded") == "succeeded" and final(None, True, 2, 1, 4, 4, 0, 0, "succeeded") == "partial"
    assert final(None, True, 0, 2, 4, 4, 0, 0, "succeeded") == "failed" and final(None, True, 2, 0, 4, 0, 4, 0, "succeeded") == "failed"
    assert final("x", True, 2, 0, 4, 4, 0, 0, "succeeded") == "failed" and final(None, False, 2, 0, 4, 4, 0, 0, "succeeded") == "failed" and final(None, True, 2, 0, 0, 0, 0, 0, "pending") == "partial"


def test_run_window_without_runs(spark, t):
    got = runs.run_window(t.runs.filter("false"), NOW).first()
    assert str(got.window_start) == "2024-01-15 12:00:00" and str(got.window_end) == NOW


def test_health(spark):
    log = [("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 4, False), ("b", 1, False), ("b", 2, True), ("c", 1, False)]
    attempts = spark.createDataFrame([(i, s, at, ok, None if ok else "source_parse_error") for i, (s, at, ok) in enumerate(log)], "event_id int, source_id string, attempt_at int, ok boolean, error string")
    initial = spark.createDataFrame([("c", 2), ("a", 5)], "source_id string, consecutive_failures int")
    got = {r.source_id: (r.consecutive_failures, r.health, r.last_status) for r in sources.health_fold(attempts, initial).collect()}
    assert got == {"a": (3, "disabled", "source_parse_error"), "b": (0, "good", "succeeded"), "c": (3, "disabled", "source_parse_error")}


def test_cap_per_domain(spark):
    items = spark.createDataFrame([(d, i) for i, d in enumerate(["ai"] * 5 + ["security"] * 4)], "domain string, pos int")
    assert sorted(r.pos for r in sources.cap_per_domain(items, 2, ("pos",)).collect()) == [0, 1, 5, 6]


def test_enqueue_twice(spark, t):
    want = spark.createDataFrame([("s1", "i1", 1), ("s1", "i2", 2), ("s2", "i3", 3)], "subject string, item_id string, doc_id int")
    empty = t.queue.drop("doc_id").filter("false")
    first = queue.enqueue(empty, want, NOW)
    assert {(r.subject, r.item_id, r.status) for r in first.collect()} == {("s1", "i2", "queued"), ("s2", "i3", "queued")}
    claimed = queue.claim(first, "w", NOW, 1)
    assert sorted(r.status for r in claimed.collect()) == ["queued", "running"] and rows(queue.enqueue(claimed, want, NOW)) == rows(claimed.select(*queue.enqueue(claimed, want, NOW).columns))
    done = queue.finalise(claimed, spark.createDataFrame([("s1", "failed")], "subject string, outcome string"))
    again = queue.enqueue(done, want, NOW)
    assert {r.subject: r.status for r in again.collect()} == {"s1": "queued", "s2": "queued"}


def digest_case(spark, rows, collected, analyzed, failed, domain="ai"):
    items = spark.createDataFrame([(i, k, domain, x, n, c, s, conf, summary, action, 1) for k, (i, x, n, c, s, conf, summary, action) in enumerate(rows)], "id string, doc_id int, domain string, source_id string, title string, category string, insight_score int, confidence string, summary_zh string, action_suggestion string, analysis_stage int").withColumn("stage1_analyzed_at", F.lit("2026-05-25 16:30:00").cast("timestamp_ntz"))
    totals = spark.createDataFrame([("2026-05-26", collected, analyzed, failed)], "day string, collected long, analyzed long, failed_sources long").withColumn("day", F.to_date("day"))
    return digest.digest_items(items), totals


def test_digest_golden(spark):
    """Line by line, with the overview that a scorer gave; it is asked once, for the high-value items only."""
    rows = [("i1", "src", "Critical CVE", "vulnerability", 92, "confirmed", "高危漏洞。", "确认影响。"), ("i2", "p0", "Browser research", "research", 81, "firm", None, None), ("i3", "note", "Moderate note", "discussion", 55, None, None, None), ("i4", "low", "Low item", "discussion", 39, None, None, None), ("i5", "src", "Odd kind", "weird", 75, None, "", "")]
    chosen, totals = digest_case(spark, rows, 9, 4, 1, "security")
    requests = digest.overview_requests(chosen).collect()
    assert len(requests) == 1 and requests[0].id == "2026-05-26:security"
    assert json.loads(requests[0].payload) == {"domain": "security", "items": [{"title": t, "category": c, "summary_zh": s, "insight_score": n, "action_suggestion": a} for _, _, t, c, n, _, s, a in rows if n >= 75]}
    said = digest.overviews(chosen, lambda p: json.dumps({"overview_zh": f" {len(json.loads(p)['items'])} 条。 "}))
    got = digest.render(chosen, totals, "2026-05-26 08:06:00", said).first()
    assert (got.id, got.file, got.title, got.summary, got.n_items, got.n_high) == ("2026-05-26:security", "intelligence-security-2026-05-26.md", "安全情报日报 · 2026-05-26", "3 条。", 4, 3)
    assert got.content.split("\n") == [
        "---", "title: 安全情报日报 · 2026-05-26", "date: 2026-05-26 08:06:00", "tags:", "  - intelligence", "  - security", "categories:", "  - 情报日报", "---", "", "## Overview", "", "3 条。", "", "## High Value", "",
        "### 研究分析", "", "- **Browser research**", "  - score: 81", "  - source: p0", "", "### 漏洞披露", "", "- **Critical CVE**", "  - score: 92", "  - source: src", "  - summary: 高危漏洞。", "  - action: 确认影响。", "", "### weird", "", "- **Odd kind**", "  - score: 75", "  - source: src", "",
        "## Lower-value Mentions", "", "- Moderate note (score 55)", "", "## Stats", "", "- Collected: 9", "- Analyzed: 4", "- High value: 3", "- Failed sources: 1", ""]


def test_digest_without_overview(spark):
    chosen, totals = digest_case(spark, [("i", "s", "Model update", "product", 76, None, "x", None)], 1, 1, 0)
    broken = digest.overviews(chosen, lambda p: "no")
    assert {digest.render(chosen, totals, "2026-05-26 08:00:00", o).first().summary for o in (None, broken)} == {"今日共采集 1 条情报，高价值 1 条。"}
    none, totals = digest_case(spark, [("i", "s", "Low", "product", 20, None, "x", None)], 1, 1, 0)
    assert digest.render(none, totals, "2026-05-26 08:00:00").count() == 0
    lower, totals = digest_case(spark, [("i", "s", "Lower", "product", 45, None, "x", None)], 1, 1, 0)
    assert json.loads(digest.overview_requests(lower).first().payload) == {"domain": "ai", "items": []}
    assert "## High Value\n\n暂无高价值情报。\n\n## Lower-value Mentions\n\n- Lower (score 45)\n" in digest.render(lower, totals, "2026-05-26 08:00:00").first().content


def counting(log, broken=lambda n, payload: False, dies=None):
    """A scorer that notes each payload it is asked; ``dies`` names one at which the first call kills its task."""

    def scorer(p: str) -> str:
        body = p[p.index("{") :]
        n = json.loads(body)["n"]
        with open(log, "a") as f:
            f.write(f"{n} ")
        if n == dies and not os.path.exists(f"{log}.died"):
            open(f"{log}.died", "w").close()
            os._exit(1)
        return "sorry" if broken(n, p) else json.dumps({"summary_zh": "x", "insight_score": n % 100})

    return scorer


def payloads_of(spark, numbers):
    return spark.createDataFrame([(str(i), json.dumps({"n": n})) for i, n in enumerate(numbers)], "id string, payload string")


def test_scorer_repairs_once(spark, tmp_path):
    """One call a payload and one a repair, however often the result is used."""
    from curatrix.functions.contracts import parse_stage1

    log = str(tmp_path / "calls")
    scored = scoring.score(payloads_of(spark, range(6)), counting(log, lambda n, p: n % 2 and p[0] == "{"), 2, parse_stage1)
    got = scored.collect()
    assert len(got) == 6 and all(r.outcome.error is None for r in got) and scored.count() == 6
    assert sorted((tmp_path / "calls").read_text().split()) == ["0", "1", "1", "2", "3", "3", "4", "5", "5"]


def test_response_log(spark, tmp_path):
    """A second run asks for what is new only, equal payloads are one request, and another prompt version is another one."""
    from curatrix.functions.contracts import parse_stage1

    calls, log = tmp_path / "calls", str(tmp_path / "log")
    run = lambda numbers, version="v1": {r.id: r.outcome.insight_score for r in scoring.score(payloads_of(spark, numbers), counting(str(calls)), 3, parse_stage1, log=log, prompt_version=version).collect()}
    assert run([1, 2, 3, 3, 2]) == {"0": 1, "1": 2, "2": 3, "3": 3, "4": 2} and sorted(calls.read_text().split()) == ["1", "2", "3"]
    assert run([3, 4, 1]) == {"0": 3, "1": 4, "2": 1} and sorted(calls.read_text().split()) == ["1", "2", "3", "4"]
    assert run([4], "v2") == {"0": 4} and sorted(calls.read_text().split()) == ["1", "2", "3", "4", "4"]
    assert run([]) == {} and scoring.read_log(spark, log).count() == 5


def test_lost_task_pays_once(tmp_path):
    """A scorer that kills its worker once: every payload of a finished chunk is asked once, the others of the lost chunk twice at most."""
    code = f"""
import sys; sys.path[:0] = {sys.path[:1] + [ROOT]!r}
from pyspark.sql import SparkSession
from tests.test_operators import counting, payloads_of
from curatrix.operators import scoring
from curatrix.functions.contracts import parse_stage1
spark = SparkSession.builder.master("local[2,3]").config(map={{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path / "shared")!r}, "spark.sql.shuffle.partitions": "2", "spark.local.dir": {str(tmp_path / "local")!r}}}).getOrCreate()
asked = payloads_of(spark, range(40))
out = scoring.answers(asked, counting({str(tmp_path / "calls")!r}, dies=17), 1, {str(tmp_path / "log")!r}, chunk=4).collect()
assert len(out) == 40, len(out)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=240, env=os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT}/tests"})
    calls = collections.Counter((tmp_path / "calls").read_text().split())
    assert (tmp_path / "calls.died").exists() and len(calls) == 40
    assert calls["17"] == 2 and max(calls.values()) == 2 and sum(n == 2 for n in calls.values()) <= 4


def test_readers(spark, tmp_path):
    catalog = tmp_path / "sources.json"
    catalog.write_text(json.dumps([{"id": " a ", "name": "A", "domain": "ai", "type": "l1_rss", "url": "u", "authority": "official", "fetch_strategy": "poll"}, {"id": "b", "name": "", "domain": "ai", "type": "x", "url": "u", "authority": "official", "fetch_strategy": "poll"}]))
    got = {r.id: r for r in readers.catalog(spark, str(catalog)).collect()}
    assert (got["a"].status, got["a"].health, got["a"].is_active, got["a"].missing, got["b"].missing) == ("candidate", "good", True, "", "name")
    for name, head in (("x.md", '<!-- {"ghsa":"GHSA-1","kind":"k"} -->\n'), ("y.md", "<!-- {bad} -->\n"), ("z.md", "")):
        (tmp_path / "r").mkdir(exist_ok=True)
        (tmp_path / "r" / name).write_text(head + "body")
    assert {(r.stem, r.subject, r.kind) for r in readers.reports(spark, str(tmp_path / "r")).collect()} == {("x", "GHSA-1", "k"), ("y", "y", "vuln_rca"), ("z", "z", "vuln_rca")}
    atom = "<feed><entry><title>T</title><link href='https://e.org/1'/><id>urn:1</id><updated>2024-01-05T10:00:00Z</updated><author><name>N</name></author><summary>S</summary><category term='c'/></entry><entry><title></title></entry></feed>"
    found = readers.feed(spark.createDataFrame([("s", atom)], "source_id string, payload string"), tag="entry").collect()
    assert [(r.title, r.canonical_url, r.native_id, r.content_text, r.author) for r in found] == [("T", "https://e.org/1", "urn:1", "S", "N")] and json.loads(found[0].metadata)["tags"] == ["c"]
    mixed = spark.createDataFrame([("s", "api", '{"items":[],"data":[{"id":1,"title":"t","url":"u"},3]}'), ("s", "api", "[]"), ("g", "github", json.dumps([{"ghsa_id": "GHSA-1", "summary": "GHSA-1 x", "html_url": "h", "identifiers": [{"type": "CVE", "value": "CVE-1"}]}]))], "source_id string, parser string, payload string")
    assert sorted((r.source_id, r.title) for r in readers.read_all(mixed).collect()) == [("g", "GHSA-1 x"), ("s", "t")]
    news = spark.createDataFrame([("h", "hackernews", "[2,1,9]", 7), ("h", "hackernews", '{"id":1,"type":"story","title":"one"}', 7), ("h", "hackernews", '{"id":2,"type":"job","title":"two"}', 7), ("s", "api", '[{"title":"t"}]', 3)], "source_id string, parser string, payload string, source_order int")
    assert sorted((r.source_order, r.pos, r.title) for r in readers.read_all(news).collect()) == [(3, 0, "t"), (7, 1, "one")]
    with pytest.raises(Exception, match="no parser for source q"):
        readers.read_all(mixed.union(spark.createDataFrame([("q", "new", "[]")], mixed.schema))).collect()


def test_feed_documents(spark, tmp_path):
    """CDATA that holds an end tag, prefixes, attributes, nested markup, several links, broken entries; as payloads and as files."""
    rss = """<?xml version="1.0"?><rss xmlns:dc="http://d/" xmlns:content="http://c/"><channel><title>feed</title><!-- <item><title>no</title></item> -->
<item><title><![CDATA[A </item> <b>x</b>]]></title><link>https://e.org/1?a=1&amp;b=2</link><guid isPermaLink="false">g1</guid><dc:creator>Me</dc:creator><category> </category><category domain="d">c1</category><content:encoded><![CDATA[<p>hello</p>]]></content:encoded><description>desc</description></item>
BROKEN<item><title>third</title><link>https://e.org/3</link><description>a <b>bold</b> word</description><author>?</author></item></channel></rss>"""
    broken = "<item><title>broken <b>x</title><link>https://e.org/2</link></item>"
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T1</title><link rel="self" href="https://e.org/self"/><link rel="alternate" href="https://e.org/1"/><id>urn:1</id><updated>2024-01-05T10:00:00.25Z</updated><author><name>N1</name></author><author><name> N2 </name></author><summary type="xhtml"><div>in <i>it</i></div></summary><category term="k"/></entry></feed>"""
    shown = lambda df: sorted((r.title, r.canonical_url, r.native_id, r.content_text, r.author, json.loads(r.metadata)["tags"]) for r in df.collect())
    items = [("A </item> <b>x</b>", "https://e.org/1?a=1&b=2", "g1", "<p>hello</p>", "Me", ["c1"]), ("third", "https://e.org/3", "https://e.org/3", "a <b>bold</b> word", None, [])]
    entries = [("T1", "https://e.org/1", "urn:1", "<div>in <i>it</i></div>", "N1, N2", ["k"])]
    for k, text in enumerate((rss.replace("BROKEN", ""), rss.replace("BROKEN", broken), rss.replace("BROKEN", broken * 3).replace("</channel></rss>", ""))):
        payloads = spark.createDataFrame([("s", text)], "source_id string, payload string")
        assert shown(readers.feed(payloads)) == items
        folder = tmp_path / str(k) / "source_id=s"
        folder.mkdir(parents=True)
        (folder / "a.xml").write_text(text)
        (folder / "b.xml").write_text(rss.replace("BROKEN", "").replace("/1?", "/9?"))
        assert shown(readers.feed_files(spark, str(tmp_path / str(k)))) == sorted([*items, *((t, u.replace("/1?", "/9?"), *x) for t, u, *x in items)])
        told = [readers.feed_entries(payloads), readers.feed_file_entries(spark, str(tmp_path / str(k)))]
        assert [t.filter("e.broken IS NOT NULL").count() for t in told] == [(0, 1, 3)[k]] * 2
    assert shown(readers.feed(spark.createDataFrame([("s", atom)], "source_id string, payload string"), tag="entry")) == entries
    assert readers.feed(spark.createDataFrame([("s", None), ("s", ""), ("s", "<rss/>"), ("s", "no xml")], "source_id string, payload string")).count() == 0
    paper = readers.papers(spark.createDataFrame([(1, atom), (2, "none")], "key int, payload string")).orderBy("key").collect()
    assert [(r.title, r.authors, r.categories) for r in paper] == [("T1", ["N1", "N2"], ["k"]), (None, [], [])]


def test_links(spark):
    docs = spark.createDataFrame([(1, "https://github.com/a/b.git, https://github.com/topics/x https://github.com/c/d. https://github.com/c/d")], "id int, text string")
    assert [(r.target, r.n) for r in links.most_mentioned(docs, "id", "text").collect()] == [("c/d", 2)]
    refs = spark.createDataFrame([(1, ["https://github.com/own/r1/commit/aaaaaaa", "https://github.com/Own/r12/commit/bbbbbbb"], "https://github.com/own/r12/"), (2, ["https://github.com/own/r1/commit/aaaaaaa"], None), (3, ["https://e.org"], "own/r1")], "id int, refs array<string>, home string")
    assert sorted((r.id, r.repo) for r in links.fix_commit(refs, "id", "refs", "home").collect()) == [(1, "Own/r12"), (2, "own/r1")]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        sinks.write_snapshot(spark.range(n), path)
    assert sinks.read_snapshot(spark, path).count() == 2


def test_parts_and_text_files(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "part string, v int")
    path = str(tmp_path / "parts")
    assert sinks.read_parts(spark, path, "part") is None
    sinks.write_parts(rows(("00", 1), ("1e", 2), ("ff", 3)), path, "part")
    sinks.write_parts(rows(("1e", 5), ("aa", 6)), path, "part")
    assert sorted(r.v for r in sinks.read_parts(spark, path, "part").collect()) == [1, 3, 5, 6] and [r.v for r in sinks.read_parts(spark, path, "part", ["00"]).collect()] == [1] and sinks.read_parts(spark, path, "part", ["77"]) is None
    out = str(tmp_path / "texts")
    for text in ("old\n", "new\n\nlines\n"):
        sinks.write_text_files(spark.createDataFrame([("a b=1.md", text), ("c.md", "x")], "file string, content string"), out)
    assert (tmp_path / "texts" / "a b=1.md").read_text() == "new\n\nlines\n" and (tmp_path / "texts" / "c.md").read_text() == "x\n"
    assert {f.name for f in (tmp_path / "texts").iterdir() if not f.name.startswith(".")} == {"a b=1.md", "c.md"}
    for wrong in ([("a.md", "x"), ("a.md", "y")], [("../a.md", "x")], [(None, "x")]):
        with pytest.raises(Exception, match="more than one text|no plain file name"):
            sinks.write_text_files(spark.createDataFrame(wrong, "file string, content string"), out)
    assert sinks.write_text_files(spark.createDataFrame([], "file string, content string"), out).count() == 0


def test_intermediate_tables_can_be_cleared(spark):
    import os

    from curatrix import storage

    kept = storage.stored(spark.range(3), "numbers")
    assert kept.count() == 3 and os.path.isdir(storage.run_folder(spark))
    storage.clear(spark)
    assert not os.path.isdir(storage.run_folder(spark)) and storage.stored(spark.range(2), "numbers").count() == 2


def test_audit_codes(spark):
    made = lambda shape, *x: spark.createDataFrame(list(x), shape)
    run = made("id string, status string", ("r", "partial"))
    items = made("run_id string, analysis_stage int", ("r", 0), ("r", 1))
    digests = made("run_id string, domain string, id string, has_content boolean", ("r", "security", "d1", True), ("r", "ai", "d2", False))
    told = made("run_id string, domain string, status string, digest_id string", ("r", "security", "failed", "d9"), ("r", "ai", "succeeded", "d2"))
    got = runs.audit(run, items, digests, told, 3, 2, 2).first()
    assert got.errors == "run_status_partial,items_below_min:2<3,analyzed_below_min:1<2,digests_below_min:1<2,digest_not_succeeded:security,digest_id_mismatch:security,missing_digest:ai"
    dated = digests.withColumn("day", F.lit("2024-01-05"))
    posts = lambda *names: made("file string", *((x,) for x in names))
    lost = runs.audit(run, items, dated, told, 3, 2, 2, posts=posts("other.md")).first().errors
    assert lost == got.errors.replace("mismatch:security", "mismatch:security,missing_hexo_file:intelligence-security-2024-01-05.md")
    assert runs.audit(run, items, dated, told, 3, 2, 2, posts=posts("intelligence-security-2024-01-05.md")).first().errors == got.errors
    none = runs.audit(run.filter("false"), items, digests, told, 3, 2, 2).collect()
    assert [(r.id, r.errors) for r in none] == [(None, "no_finished_run")]


def test_stats_document_of_a_new_run(spark):
    made = lambda shape, *x: spark.createDataFrame(list(x), shape)
    run = made("id string, source_ids array<string>, stage1_total int, stage1_ok int, stage1_failed int, stage2_total int, stage2_ok int, stage2_failed int, dedup_skipped int, retention_deleted int", ("r", ["a", "b"], 0, 0, 0, 0, 0, 0, 0, 0))
    results = made("run_id string, source_id string, status string, items long, duration_s double, error string", ("r", "b", "failed", 0, 1.5, "source_timeout"))
    digests = made("run_id string, domain string, status string, digest_id string, hexo_path string, oss_url string, error string", ("r", "ai", "succeeded", "d", None, None, None))
    doc = json.loads(runs.stats_document(run, results, digests).first().stats_json)
    assert doc["sources"] == {"a": {"status": "pending", "items": 0, "duration_s": 0.0}, "b": {"status": "failed", "items": 0, "duration_s": 1.5, "error": "source_timeout"}} and doc["digest"] == {"status": "succeeded", "security": None, "ai": {"status": "succeeded", "digest_id": "d", "hexo_path": None, "oss_url": None, "error": None}}
    empty = json.loads(runs.stats_document(run, results.filter("false"), digests.filter("false")).first().stats_json)
    assert empty["digest"]["status"] == "pending" and empty["sources"]["b"]["status"] == "pending" and empty["dedup_skipped"] == 0


def test_progress_from_documents(spark):
    """Failed items of stage one are no progress; a document that can't be read says nothing."""
    source = lambda s: {"status": s, "items": 5, "duration_s": 1.5}
    doc = {"sources": {"a": source("succeeded"), "b": source("pending")}, "stage1": {"total": 10, "succeeded": 5, "failed": 0}, "stage2": {"total": 2, "succeeded": 1, "failed": 0}, "digest": {"status": "partial", "security": None, "ai": None}}
    failing = doc | {"stage1": {"total": 10, "succeeded": 5, "failed": 5}, "sources": {"a": source("failed"), "b": source("skipped")}, "digest": {"status": "succeeded"}}
    new = {"sources": {"a": source("pending")}, "stage1": {"total": 0, "succeeded": 0, "failed": 0}, "stage2": {"total": 0, "succeeded": 0, "failed": 0}, "digest": {"status": "pending", "security": None, "ai": None}}
    every = {"half": doc, "failing": failing, "new": new, "empty": {}}
    df = spark.createDataFrame([*((k, json.dumps(v)) for k, v in every.items()), ("none", None), ("broken", "{")], "id string, stats_json string")
    assert {r.id: r.progress for r in runs.from_documents(df).collect()} == {"half": 0.55, "failing": 0.7, "new": 0.0, "empty": 0.0, "none": 0.0, "broken": 0.0}
    status = lambda fatal, cleaned: {r.id: r.final_status for r in runs.status_from_documents(df, F.lit(fatal).cast("string"), F.lit(cleaned)).collect()}
    assert status(None, True) == {"half": "partial", "failing": "failed", "new": "failed", "empty": "failed", "none": "failed", "broken": "failed"}
    assert set(status("x", True).values()) == set(status(None, False).values()) == {"failed"}
    good = df.filter("id = 'half'").select("id", F.regexp_replace("stats_json", "partial|pending", "succeeded").alias("stats_json"))
    assert runs.status_from_documents(good, F.lit(None).cast("string"), F.lit(True)).first().final_status == "succeeded"
    assert sorted((r.source_id, r.status, r.items, r.duration_s, r.error) for r in runs.document_sources(good).collect()) == [("a", "succeeded", 5, 1.5, None), ("b", "succeeded", 5, 1.5, None)]


def test_digest_sink_overwrites_one_partition(spark, tmp_path):
    make = lambda d, text: spark.createDataFrame([(d, "ai", "f", text)], "day string, domain string, file string, content string")
    for d, text in (("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-01", "c")):
        sinks.digest_job(make(d, text), str(tmp_path / "d"), base_url="https://x")
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "d")).collect()) == ["b", "c"]


def test_empty_tables(spark, t):
    from curatrix.operators import stats

    none = t.items.filter("false")
    assert stats.item_summary(none).first().total == 0 and {r.n for r in stats.histogram(none).collect()} == {0} and stats.source_summary(t.sources.filter("false"), none, "2024-01-16").first().max_spark == 1
    assert ingest.merge_items(ingest.normalize(t.raw_items.filter("false"), t.sources, NOW)).count() == 0
