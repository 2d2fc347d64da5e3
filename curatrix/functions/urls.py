"""Canonical form of URLs and the identities derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track where a visitor came from.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid")
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def strip(text: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """Form encoding in which ``~`` is safe and ``*`` is not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and authority, no trailing slashes, no tracking or blank parameters, parameters by key, no fragment."""
    url = strip(url)
    scheme, host, path, query = (F.regexp_extract(url, _PARTS, k) for k in (1, 2, 3, 4))
    params = F.regexp_extract(path, r"(;[^/]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", "")
    bare = F.when(bare == "", F.lit("/")).otherwise(bare)
    pairs = F.transform(F.split(query, "&"), lambda p, i: F.struct(
        _decoded(F.substring_index(p, "=", 1)).alias("key"), i.alias("at"),
        _decoded(F.when(p.contains("="), F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)).otherwise(F.lit(""))).alias("value")))
    kept = F.filter(pairs, lambda p: (p["value"] != "") & ~F.lower(p["key"]).isin(*TRACKING_KEYS))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")
    head = F.concat(F.when(scheme == "", F.lit("")).otherwise(F.concat(F.lower(scheme), F.lit(":"))), F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("//"), F.lower(host))))
    return F.concat(head, bare, params, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))


def normalize_text(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank; null as empty."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def dedup_hash(url: Column, title: Column, content: Column, source_id: Column) -> Column:
    """Identity of an item: its canonical URL, or without one its title and the start of its content (else its source)."""
    start = F.substring(normalize_text(content), 1, 500)
    words = F.concat(normalize_text(title), F.lit("|"), F.when(start == "", source_id).otherwise(start))
    has_url = F.coalesce(strip(url), F.lit("")) != ""
    return F.substring(F.sha2(F.when(has_url, canonicalize_url(url)).otherwise(words), 256), 1, 32)


def item_id(source_id: Column, native_id: Column, hashed: Column) -> Column:
    """``source:native`` where that is at most 96 characters, else a hash of the native id; without one, of the item."""
    plain = F.concat(source_id, F.lit(":"), native_id)
    short = F.concat(source_id, F.lit(":"), F.substring(F.sha2(native_id, 256), 1, 24))
    none = F.concat(source_id, F.lit(":"), F.substring(hashed, 1, 16))
    return F.when(F.coalesce(native_id, F.lit("")) == "", none).when(F.length(plain) <= 96, plain).otherwise(short)
