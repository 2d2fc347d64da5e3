"""Golden values of the column functions."""

from __future__ import annotations

import datetime
import email.utils
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from curatrix.functions import contracts, html, ids, scores, times, urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("url", "expected"), [
    ("HTTPS://Example.COM/path/?utm_source=x&b=2&a=1#frag", "https://example.com/path?a=1&b=2"),
    ("  https://e.org  ", "https://e.org/"), ("https://e.org//a//", "https://e.org//a"), ("https://e.org/a?x=&y=1&Ref=z", "https://e.org/a?y=1"),
    ("https://e.org/a?b=2&a=2&a=1", "https://e.org/a?a=2&a=1&b=2"), ("https://e.org/a?q=a*b~c", "https://e.org/a?q=a%2Ab~c"), ("https://e.org/a?q=%zz", "https://e.org/a?q=%25zz"),
    ("https://e.org/a/;v=1?q=1", "https://e.org/a;v=1?q=1"), ("", "/"), (None, None),
])
def test_canonical_url(spark, url, expected):
    assert one(spark, url, urls.canonicalize_url) == expected


def test_identity(spark):
    rows = spark.createDataFrame([("s", "http://E.org/a/", "t", "c", "n"), ("s", "http://e.org/a", "u", None, "x" * 100), ("s", " ", " A  b ", "c", None), ("s2", None, "a b", "C", "")], "s string, u string, t string, c string, n string")
    h = urls.dedup_hash(F.col("u"), F.col("t"), F.col("c"), F.col("s"))
    got = rows.select(h.alias("h"), urls.item_id(F.col("s"), F.col("n"), h).alias("i")).collect()
    assert got[0].h == got[1].h and len(got[0].h) == 32 and got[0].i == "s:n" and len(got[1].i) == 26
    assert got[2].h == got[3].h and got[2].i == "s:" + got[2].h[:16] and got[3].i == "s2:" + got[3].h[:16]


@pytest.mark.parametrize(("authority", "n", "expected"), [("regular", 0, "tentative"), ("official", 0, "firm"), ("authoritative", 1, "firm"), ("official", 1, "confirmed"), ("regular", 2, "confirmed"), (None, None, "tentative")])
def test_confidence(spark, authority, n, expected):
    assert spark.createDataFrame([(authority, n)], "a string, n int").select(scores.derive_confidence(F.col("a"), F.col("n")).alias("y")).first().y == expected


def test_retention_and_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0, 9, 10, 29, 30, 49, 50, 74, 75, 100)], "insight_score int")
    from curatrix.operators import stats

    assert {r.retention: r.n for r in stats.retention_counts(df).collect()} == dict.fromkeys(("delete", "5_days", "10_days", "30_days", "permanent"), 2)
    hist = spark.createDataFrame([(x,) for x in (None, -5, 0, 4, 5, 74, 75, 99, 100)], "insight_score int")
    got = {r.bucket: r.n for r in stats.histogram(hist).collect()}
    assert len(got) == 20 and {k: v for k, v in got.items() if v} == {0: 3, 1: 1, 14: 1, 15: 1, 19: 2}
    given = spark.createDataFrame(list({0: 2, 1: 1, 2: 3, 6: 2, 10: 1, 15: 2, 19: 1}.items()), "bucket int, n long")
    assert {r.retention: r.n for r in stats.retention_from_histogram(given).collect()} == {"permanent": 3, "30_days": 1, "10_days": 2, "5_days": 3, "delete": 3}
    at = spark.createDataFrame([(9,), (10,), (30,), (50,), (75,)], "s int").select(F.datediff(scores.expires_at(F.col("s"), F.lit("2024-01-01").cast("timestamp_ntz")), F.lit("2024-01-01")).alias("d"))
    assert [r.d for r in at.collect()] == [0, 5, 10, 30, None]


def test_ids(spark):
    assert one(spark, "see ghsa-ABCD-12ef-x9y8.", ids.extract_ghsa) == "GHSA-abcd-12ef-x9y8"
    assert one(spark, "https://arxiv.org/abs/2401.01234v2", ids.extract_arxiv) == "2401.01234"
    assert one(spark, "https://e.org/2401.01234", ids.extract_arxiv) is None
    assert one(spark, "oai:arXiv.org:2401.01234v3", lambda c: ids.native_id(c, "arxiv")) == "2401.01234"
    assert one(spark, "https://e.org/a/b/?x", lambda c: ids.native_id(c, "path")) == "b"


def test_times(spark):
    stamp = lambda f: lambda c: F.date_format(f(c), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, "Mon, 25 May 2026 16:30:00 GMT", stamp(times.parse_feed_date)) == "2026-05-25 16:30:00"
    assert one(spark, "2026-05-25T16:30:00+02:00", stamp(times.parse_feed_date)) == "2026-05-25 14:30:00"
    assert one(spark, "soon", times.parse_feed_date) is None
    assert one(spark, "1700000000", stamp(times.parse_unix)) == "2023-11-14 22:13:20" and one(spark, "x", times.parse_unix) is None
    assert str(one(spark, "2026-05-25 16:30:00", lambda c: times.digest_date(c.cast("timestamp_ntz")))) == "2026-05-26"


def utc(spark, texts, parse):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", F.unix_micros(parse(F.col("x"))).alias("y"))
    return [r.y for r in sorted(df.collect())]


def micros(at):
    at = at.replace(tzinfo=datetime.UTC) if at.tzinfo is None else at
    return (at - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)


def test_feed_dates_as_python_reads_them(spark):
    rng = random.Random(4)
    texts = ["Fri, 05 Jan 2024 10:00:00 EST", "05 Jan 2024 10:00:00 GMT", "Fri, 5 Jan 24 10:00 PDT", "Friday, 05-Jan-99 10:00:00 UT", "Fri, 05 January 2024 10:00:00 +0530 (IST)", "5 Feb 2024 01:02:03 -0000", "Fri 05 Jan 2024 10:00:00 Z", "30 Feb 2024 10:00:00 GMT", "31 Dec 68 23:59 CST", "1 Jan 69 00:00 MDT", "soon", ""]
    for _ in range(300):
        at = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=rng.randrange(3 * 10**9))
        year = rng.choice(["%Y", "%Y", "%y" if 1969 <= at.year <= 2068 else "%Y"])
        zone = rng.choice(["GMT", "EST", "EDT", "CST", "CDT", "MST", "MDT", "PST", "PDT", "UT", "UTC", "+0000", "-0000", "+0530", "-0330", "+1400", "-1130", ""])
        texts.append(at.strftime(f"{rng.choice(['%a, ', '', '%A, '])}%d %b {year} %H:%M{rng.choice([':%S', ''])} {zone}").strip())

    def expected(text):
        try:
            return micros(email.utils.parsedate_to_datetime(text))
        except (ValueError, TypeError, IndexError):
            return None

    assert utc(spark, texts, times.parse_feed_date) == [expected(x) for x in texts]


def test_iso_dates_as_python_reads_them(spark):
    rng = random.Random(5)
    texts = ["2024-01-05T10:00:00.123456Z", "2024-01-05T10:00:00+0000", "2024-01-05T10:00:00.1234567891+02", "2024-01-05 10:00", "2024-01-05", "20240105T101112", "20240105T1011-0330", "2024-02-30T00:00:00", "2024-01-05T25:00:00", "2024-01-05T10:00:61", "2024-01-05T10:00:00+01:02:03", "2024-1-5", "x", "2024-0105", " 2024-01-05T10:00:00Z "]
    for _ in range(300):
        at = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=rng.randrange(3 * 10**9), microseconds=rng.randrange(10**6))
        d, c = rng.choice([("-", ":"), ("-", ":"), ("", "")])
        clock = rng.choice([f"%H{c}%M{c}%S.%f", f"%H{c}%M{c}%S", f"%H{c}%M", "%H"])
        texts.append(at.strftime(f"%Y{d}%m{d}%d{rng.choice('T ')}{clock}") + rng.choice(["", "Z", "+00:00", "+0530", "-03:30", "+14"]))

    def expected(text):
        try:
            return micros(datetime.datetime.fromisoformat(text.strip().replace("Z", "+00:00")))
        except ValueError:
            return None

    for parse in (times.parse_iso, times.parse_feed_date):
        assert utc(spark, texts, parse) == [expected(x) for x in texts]
    assert utc(spark, ["1700000000", "-1.5", "1e30", "x", None], times.parse_unix) == [1700000000 * 10**6, -(10**6), None, None, None]
    assert utc(spark, ["2024-01-05T10:00:00Z"], lambda c: times.parse_feed_date(F.lit(" "), c, F.lit("2020-01-01"))) == [1704448800 * 10**6]


def outcome(spark, raw, parse=contracts.parse_stage1):
    return contracts.extract_objects(spark.createDataFrame([(raw,)], "raw string")).select(parse(F.col("payload")).alias("o")).first().o


GOOD = {"category": "unknown-category", "tags": ["cve", " linux ", ""], "summary_zh": "x", "insight_score": 130, "credibility": "invalid"}


def test_stage1(spark):
    for raw in (json.dumps(GOOD), f"```json\n{json.dumps(GOOD)}\n```", f"Sure: {{no}} {json.dumps(GOOD)} bye"):
        assert outcome(spark, raw) == Row(category="other", tags=["cve", "linux"], summary_zh="x", insight_score=100, credibility="unknown", error=None)
    for bad in ("nothing", None, "", "[1]", json.dumps(GOOD | {"insight_score": True}), json.dumps(GOOD | {"insight_score": "NaN"}), json.dumps(GOOD | {"summary_zh": " "}), json.dumps(GOOD | {"summary_zh": 7}), json.dumps(GOOD | {"summary_zh": {"a": 1}}), json.dumps(GOOD | {"insight_score": 1e999}), json.dumps(GOOD | {"tags": "no"})):
        assert outcome(spark, bad).error == contracts.PARSE_ERROR, bad
    assert [outcome(spark, json.dumps(GOOD | {"insight_score": x})).insight_score for x in (0.5, 1.5, -3)] == [0, 2, 0]


def test_stage2_and_overview(spark):
    parse = lambda p: contracts.parse_stage2(p, F.lit("firm"))
    got = outcome(spark, json.dumps({"recommendation_reason": "r", "action_suggestion": "a", "trend_signal": "surging", "confidence": "confirmed"}), parse)
    assert (got.trend_signal, got.confidence, got.error) == (None, "firm", None)
    assert outcome(spark, '{"recommendation_reason":"r"}', parse).error == contracts.PARSE_ERROR
    assert outcome(spark, '{"overview_zh":" o "}', contracts.parse_overview) == Row(overview_zh="o", error=None)
    assert outcome(spark, '{"overview":"o"}', contracts.parse_overview).error == contracts.PARSE_ERROR


def test_prepared_content(spark):
    got = one(spark, "a" * 3000 + "b" * 2000 + "c" * 500, contracts.prepare_content)
    assert got.truncated and got.text == "a" * 3000 + contracts.MARKER + "c" * 500
    assert one(spark, "a" * 4000, contracts.prepare_content) == Row(text="a" * 4000, truncated=False)


def test_page_text(spark):
    page = "<!DOCTYPE html><html><head><title>t</title></head><body><nav>n</nav><p>Hello&nbsp;<b>you</b> &amp;  I</p><script>var t='</p>';</script><br>x<footer>f</footer></body></html>"
    assert one(spark, page, html.page_text) == "Hello\u00a0you & I\n\nx" and one(spark, None, html.page_text) == ""
    assert one(spark, "<p>a</p><p>b</p>", html.page_text) == "a\n\nb" and one(spark, "a<br>b<br/>c&#8217;&eacute;&lt;p&gt;", html.page_text) == "a\nb\n\nc\u2019\u00e9<p>"


def test_fetch_error(spark):
    from curatrix.functions.errors import fetch_error

    cases = [("timeout", None, "source_timeout"), ("status", 401, "source_auth_error"), ("status", 403, "source_auth_error"), ("status", 500, "source_http_error"), ("status", None, "source_http_error"), ("transport", None, "source_http_error"), ("odd", 401, "source_parse_error"), (None, None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "kind string, status int")
    assert [r.e for r in df.select(fetch_error(F.col("kind"), F.col("status")).alias("e")).collect()] == [c[2] for c in cases]
