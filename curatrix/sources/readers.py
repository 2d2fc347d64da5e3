"""Readers of landed payloads: each turns a table or folder of payloads into raw items with their position."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import native_id
from ..functions.times import parse_feed_date, parse_iso, parse_unix
from ..operators.ingest import has_keyword
from ..storage import stored

RAW = ("source_id", "pos", "title", "canonical_url", "content_text", "author", "published_at", "native_id", "metadata")
CATALOG = "id STRING, name STRING, domain STRING, type STRING, url STRING, authority STRING, fetch_strategy STRING, auth_mode STRING, status STRING, health STRING, is_active BOOLEAN"
REQUIRED = ("id", "name", "domain", "type", "url", "authority", "fetch_strategy")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The source catalog, a JSON array, with defaults and ``missing``, the required fields that a source lacks."""
    raw = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    trimmed = raw.withColumns({c: F.trim(c) for c in REQUIRED})
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED))), ",")
    return trimmed.withColumns({"auth_mode": F.coalesce("auth_mode", F.lit("none")), "status": F.coalesce("status", F.lit("candidate")), "health": F.coalesce("health", F.lit("good")), "is_active": F.coalesce("is_active", F.lit(True)), "missing": missing})


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _raw(rows: DataFrame, since: str | None) -> DataFrame:
    """The raw-item columns; entries with neither title nor link and those older than ``since`` go; no time passes."""
    kept = rows.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("canonical_url", F.lit("")) != ""))
    if since:
        kept = kept.filter(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(since).cast("timestamp")))
    return kept.select(*RAW)


#: What is read of an RSS item or an Atom entry; names without their namespaces' prefixes, attributes with an underscore.
ENTRY = """title STRING, link ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>, guid STRUCT<_VALUE: STRING>, id STRING, pubDate STRING, published STRING, updated STRING, date STRING, description STRING, summary STRING,
  content STRING, encoded STRING, author ARRAY<STRUCT<_VALUE: STRING, name: STRING>>, name ARRAY<STRING>, creator ARRAY<STRING>, category ARRAY<STRUCT<_VALUE: STRING, _term: STRING>>, broken STRING"""
_ENTRY_TYPE = f"STRUCT<{re.sub(r'(^|, )([A-Za-z]+) ', r'\1\2: ', re.sub(r'\s+', ' ', ENTRY))}>"
_DOCUMENT = f"channel STRUCT<item: ARRAY<{_ENTRY_TYPE}>>, item ARRAY<{_ENTRY_TYPE}>, entry ARRAY<{_ENTRY_TYPE}>, broken STRING"
_XML = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}


def _blocks(text: Column, tag: str) -> Column:
    """The elements of a tag as they stand in a text; what stands in a comment or a CDATA section neither begins nor ends one."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|(<{tag}[\s>](?:[^<]++|<!\[CDATA\[.*?\]\]>|<!--.*?-->|<(?!/{tag}\s*>))*+</{tag}\s*>)"), 1)


def _cut(text: Column, tag: str) -> Column:
    """Entries of a document that is no XML as a whole: each element is read for itself, and one that can't be is ``broken``."""
    found = F.filter(_blocks(text, tag), lambda x: x != "")
    return F.transform(found, lambda x: F.struct(x.alias("xml"), F.from_xml(x, ENTRY, _XML).alias("e")))


def _named(names: Column) -> Column:
    """Names that say something, in one text; null where none does."""
    return _blank(F.array_join(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""), ", "))


def _entry_items(entries: DataFrame, since: str | None, native: str) -> DataFrame:
    """Raw items of entries (source_id, pos, e); broken ones are left out."""
    rows = entries.filter("e.broken IS NULL")
    links = F.coalesce("e.link", F.array())
    href = F.filter(links, lambda x: _blank(x["_href"]).isNotNull())
    # A link's text, or the address of the first that is no link to the feed itself.
    link = F.coalesce(F.get(F.filter(F.transform(links, lambda x: _blank(x["_VALUE"])), lambda x: x.isNotNull()), F.lit(0)), _blank(F.get(F.filter(href, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]), _blank(F.get(href, F.lit(0))["_href"]))
    author = _named(F.filter(F.transform("e.author", lambda a: a["_VALUE"]), lambda a: F.trim(a) != "?"))
    who = F.coalesce(author, _named(F.col("e.creator")), _named(F.transform("e.author", lambda a: a["name"])))
    own = F.coalesce(_blank(F.col("e.guid._VALUE")), _blank(F.col("e.id")), link)
    terms = F.filter(F.transform(F.coalesce("e.category", F.array()), lambda c: F.coalesce(_blank(c["_term"]), _blank(c["_VALUE"]))), lambda c: c.isNotNull())
    content = F.coalesce(*(_blank(F.col(f"e.{c}")) for c in ("encoded", "content", "summary", "description")))
    at = parse_feed_date(F.col("e.pubDate"), F.col("e.published"), F.col("e.updated"), F.col("e.date"))
    return _raw(rows.select("source_id", F.col("pos").cast("long").alias("pos"), F.trim("e.title").alias("title"), link.alias("canonical_url"), content.alias("content_text"), who.alias("author"),
                            at.alias("published_at"), native_id(own, native).alias("native_id"), F.to_json(F.struct(terms.alias("tags"))).alias("metadata")), since)


def feed_entries(payloads: DataFrame, tag: str = "item") -> DataFrame:
    """(source_id, pos, e) of documents (source_id, payload): RSS items or Atom entries as ENTRY. An entry that can't be read has ``e.broken``, its text.

    A document is read as XML; one that is none is cut into its elements, so that a broken entry costs no other one.
    """
    doc = F.from_xml("payload", _DOCUMENT, _XML)
    read = payloads.select("source_id", "payload", doc.alias("doc")).withColumn("whole", F.coalesce("doc.channel.item", "doc.item") if tag == "item" else F.col("doc.entry"))
    cut = F.transform(_cut(F.col("payload"), tag), lambda x: x["e"])
    entries = F.when(F.col("doc.broken").isNull() & F.col("whole").isNotNull(), F.col("whole")).otherwise(cut)
    return read.select("source_id", F.posexplode(entries).alias("pos", "e"))


def feed(payloads: DataFrame, since: str | None = None, native: str = "plain", tag: str = "item") -> DataFrame:
    """RSS items (or Atom entries, tag="entry") of payloads (source_id, payload): one document a row."""
    return _entry_items(feed_entries(payloads, tag), since, native)


def feed_file_entries(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """(source_id, file, pos, e) of landed feed files below ``path``, read by Spark's XML source, an entry a row. Sources are folders ``source_id=...``.

    ``pos`` grows in a file's order. Of a file that is no XML the source gives the whole text once; such files are cut into their elements.
    """
    # A source's name is a text, whatever all of them look like (007 is no 7).
    reader = spark.read.format("xml").schema(f"{ENTRY}, source_id STRING").options(rowTag=tag, **_XML)
    # Written once: files are parsed once, and positions are the same wherever the rows are used.
    rows = stored(reader.load(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")), "entries")
    fields = [c for c in spark.createDataFrame([], ENTRY).columns]
    bad = rows.filter("broken IS NOT NULL").select("source_id", "file", "pos", F.col("broken").alias("text"))
    names = bad.select(F.col("file").alias("bad_file")).distinct()  # the source may have read entries before it met the fault
    good = rows.join(names, F.col("file") == F.col("bad_file"), "left_anti").select("source_id", "file", "pos", F.struct(*fields).alias("e"))
    whole = bad.groupBy("source_id", "file").agg(F.min("pos").alias("first"), F.max_by("text", F.length("text")).alias("text"))
    cut = whole.select("source_id", "file", "first", F.posexplode(F.transform(_cut(F.col("text"), tag), lambda x: x["e"])).alias("k", "e")).select("source_id", "file", (F.col("first") + F.col("k")).alias("pos"), "e")
    return good.unionByName(cut)


def feed_files(spark: SparkSession, path: str, since: str | None = None, native: str = "plain", tag: str = "item") -> DataFrame:
    """Raw items of landed feed files; how many entries are broken says ``feed_file_entries``."""
    return _entry_items(feed_file_entries(spark, path, tag).drop("file"), since, native)


NVD = """vulnerabilities ARRAY<STRUCT<cve: STRUCT<id: STRING, published: STRING, vulnStatus: STRING, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>,
  metrics: STRUCT<cvssMetricV31: ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE>>>, cvssMetricV30: ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE>>>, cvssMetricV2: ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE>>>>,
  weaknesses: ARRAY<STRUCT<description: ARRAY<STRUCT<lang: STRING, value: STRING>>>>, references: ARRAY<STRUCT<url: STRING>>>>>"""


def _by_lang(array: Column, lang: str) -> Column:
    return F.get(F.filter(array, lambda d: d["lang"] == lang), F.lit(0))["value"]


def nvd(payloads: DataFrame, since: str | None = None) -> DataFrame:
    """Records of vulnerability payloads, all landed pages."""
    v = payloads.select("source_id", F.posexplode(F.from_json("payload", NVD)["vulnerabilities"]).alias("pos", "v")).select("source_id", "pos", "v.cve.*")
    about = F.coalesce(_by_lang(F.col("descriptions"), "en"), F.lit(""))
    score = F.coalesce(*(F.get(F.col(f"metrics.{m}"), F.lit(0))["cvssData"]["baseScore"] for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")))
    weak = F.filter(F.flatten(F.transform(F.coalesce("weaknesses", F.array()), lambda w: F.transform(w["description"], lambda d: d["value"]))), lambda x: x.startswith("CWE-"))
    refs = F.slice(F.filter(F.transform("references", lambda r: r["url"]), lambda u: F.coalesce(u, F.lit("")) != ""), 1, 10)
    meta = F.to_json(F.struct(score.alias("cvss"), weak.alias("cwes"), refs.alias("references"), _by_lang(F.col("descriptions"), "zh").alias("zh"), F.col("vulnStatus").alias("status")))
    return _raw(v.select("source_id", F.col("pos").cast("long").alias("pos"), F.concat("id", F.lit(": "), F.substring(about, 1, 200)).alias("title"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "id").alias("canonical_url"), about.alias("content_text"),
                         F.lit(None).cast("string").alias("author"), parse_iso(F.col("published")).alias("published_at"), F.col("id").alias("native_id"), meta.alias("metadata")), since)


ADVISORY = "ARRAY<STRUCT<ghsa_id: STRING, id: STRING, summary: STRING, description: STRING, html_url: STRING, url: STRING, published_at: STRING, severity: STRING, identifiers: ARRAY<STRUCT<type: STRING, value: STRING>>>>"


def advisories(payloads: DataFrame, since: str | None = None) -> DataFrame:
    a = payloads.select("source_id", F.posexplode(F.from_json("payload", ADVISORY)).alias("pos", "a")).select("source_id", "pos", "a.*")
    key, text = F.coalesce(_blank(F.col("ghsa_id")), F.col("id")), F.coalesce("summary", F.lit(""))
    cves = F.transform(F.filter("identifiers", lambda i: i["type"] == "CVE"), lambda i: i["value"])
    title = F.when(text.startswith(key), text).otherwise(F.concat(key, F.lit(": "), text))
    return _raw(a.select("source_id", F.col("pos").cast("long").alias("pos"), title.alias("title"), F.coalesce(_blank(F.col("html_url")), _blank(F.col("url")), F.lit("")).alias("canonical_url"), F.coalesce("description", text).alias("content_text"),
                         F.lit(None).cast("string").alias("author"), parse_iso(F.col("published_at")).alias("published_at"), key.alias("native_id"), F.to_json(F.struct("severity", cves.alias("cve_ids"))).alias("metadata")), since)


def records(payloads: DataFrame, fields: dict[str, tuple[str, ...]] | None = None, since: str | None = None) -> DataFrame:
    """Records of a JSON payload: a list, or the first non-empty list under items, data or results; what is no object is dropped."""
    fields = {"title": ("title", "name"), "url": ("url", "link", "html_url"), "content": ("content", "summary", "description"), "author": ("author",), "at": ("published_at", "date", "created_at"), "id": ("id",)} | (fields or {})
    body = F.trim("payload")
    lists = [F.from_json(F.when(body.startswith("["), body), "array<string>"), *(F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in ("items", "data", "results"))]
    full = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    rows = payloads.select("source_id", F.posexplode(full).alias("pos", "r")).filter(F.trim("r").startswith("{"))
    pick = lambda k: F.coalesce(*(_blank(F.get_json_object("r", f"$.{f}")) for f in fields[k]))
    return _raw(rows.select("source_id", F.col("pos").cast("long").alias("pos"), pick("title").alias("title"), pick("url").alias("canonical_url"), pick("content").alias("content_text"), pick("author").alias("author"), parse_iso(pick("at")).alias("published_at"), pick("id").alias("native_id"), F.col("r").alias("metadata")), since)


def stories(lists: DataFrame, details: DataFrame, max_items: int, keywords: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """lists (source_id, payload: JSON array of ids) joined to details (id, payload): the first ``max_items`` ids, then only stories that a keyword fits."""
    ids = lists.select("source_id", F.posexplode(F.from_json("payload", "array<bigint>")).alias("pos", "story")).filter(F.col("pos") < max_items)
    found = ids.join(details.select(F.col("id").alias("story"), F.from_json("payload", "type STRING, title STRING, url STRING, by STRING, time BIGINT, score INT, descendants INT, text STRING").alias("d")), "story").filter("d.type = 'story'")
    home = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("story").cast("string"))
    rows = found.select("source_id", F.col("pos").cast("long").alias("pos"), F.col("d.title").alias("title"), F.coalesce(_blank(F.col("d.url")), home).alias("canonical_url"), F.col("d.text").alias("content_text"), F.col("d.by").alias("author"), parse_unix(F.col("d.time").cast("string")).alias("published_at"),
                        F.col("story").cast("string").alias("native_id"), F.to_json(F.struct(F.col("d.score").alias("score"), F.col("d.descendants").alias("descendants"), home.alias("hn_url"))).alias("metadata"))
    return _raw(rows.filter(has_keyword(keywords, "title", "content_text", "canonical_url")), since)


def posts_in(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(file, bytes) of a folder of posts, from its listing: no file is opened. A folder without any gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("length").alias("bytes"))


#: What a report's head may say, beside what it is about.
REPORT_FIELDS = ("item_id", "repo", "vuln_commit", "fix_commit", "model", "status", "attempts")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files: the whole text, and what their leading comment of JSON says of them (a value that is no string as its JSON).

    The comment begins the file; bad JSON says nothing. A report without a subject is named by its file.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("report_md"), F.col("_metadata.file_name").alias("file"))
    head = F.regexp_extract("report_md", r"(?s)^<!--\s*(\{.*?\})\s*-->", 1)
    get = lambda k: F.get_json_object(F.when(F.try_parse_json(head).isNotNull(), head), f"$.{k}")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return files.select(stem.alias("stem"), F.coalesce(_blank(get("ghsa")), _blank(get("subject")), stem).alias("subject"), F.coalesce(get("kind"), F.lit("vuln_rca")).alias("kind"), *(get(k).alias(k) for k in REPORT_FIELDS), "report_md")


def landed_stories(payloads: DataFrame, since: str | None = None, max_items: int = 50) -> DataFrame:
    """Stories whose list (a JSON array of ids) and details (JSON objects with their id) landed as payloads of one source."""
    text = F.trim("payload")
    details = payloads.filter(text.startswith("{")).select(F.get_json_object("payload", "$.id").cast("long").alias("id"), "payload")
    return stories(payloads.filter(text.startswith("[")), details.dropDuplicates(["id"]), max_items, since=since)


#: Authors of a paper that are kept.
MOST_AUTHORS = 12


def papers(payloads: DataFrame) -> DataFrame:
    """Of answers (key, payload: Atom, of which the first entry counts) a paper's title, summary, authors and categories; of one that is no XML nulls."""
    first = feed_entries(payloads.select(F.col("key").alias("source_id"), "payload"), "entry").filter("pos = 0").select(F.col("source_id").alias("of_key"), "e")
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    authors = F.concat(F.coalesce(F.transform("e.author", lambda a: F.coalesce(a["name"], a["_VALUE"])), F.array()), F.coalesce("e.name", F.array()))
    authors = F.slice(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""), 1, MOST_AUTHORS)
    terms = F.filter(F.transform(F.coalesce("e.category", F.array()), lambda c: _blank(c["_term"])), lambda c: c.isNotNull())
    return payloads.select("key").join(first, F.col("key") == F.col("of_key"), "left").select("key", squeeze(F.col("e.title")).alias("title"), squeeze(F.col("e.summary")).alias("summary"), authors.alias("authors"), terms.alias("categories"))


PARSERS: dict[str, Callable[..., DataFrame]] = {"nvd": nvd, "github": advisories, "hackernews": landed_stories, "rss": feed, "api": records}


def read_all(payloads: DataFrame, since: str | None = None, parsers: dict[str, Callable[..., DataFrame]] = PARSERS) -> DataFrame:
    """Payloads (source_id, parser, payload), each through its parser, in one union; more parsers can be given.

    A payload whose parser is not listed fails the job when it is read. Where payloads have a ``source_order``, items carry it.
    """
    listed = F.coalesce(F.col("parser").isin(*parsers), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("no parser for source "), F.coalesce("source_id", F.lit("?"))))
    parts = [read(payloads.filter(F.col("parser") == name).drop("parser"), since=since) for name, read in parsers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.unionByName(payloads.filter(~listed).select(*(wrong.cast(out.schema[c].dataType).alias(c) for c in out.columns)))
    if "source_order" in payloads.columns:
        out = out.join(payloads.groupBy("source_id").agg(F.min("source_order").alias("source_order")), "source_id")
    return out
