"""Identifiers found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GHSA = r"(?i)(GHSA(?:-[0-9a-z]{4}){3})"
ARXIV = r"(\d{4}\.\d{4,5})(?:v\d+)?"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def extract_ghsa(*fields: Column) -> Column:
    """The first advisory id in the given fields: prefix in capitals, the rest small."""
    hit = F.coalesce(*(_found(f, GHSA) for f in fields))
    return F.concat(F.lit("GHSA"), F.lower(F.substring(hit, 5, 15)))


def extract_arxiv(*fields: Column) -> Column:
    """The first paper id, without version, in fields that mention arXiv."""
    return F.coalesce(*(F.when(F.lower(f).contains("arxiv"), _found(f, ARXIV)) for f in fields))


def native_id(raw: Column, mode: str) -> Column:
    """``plain`` as it is; ``arxiv`` after the last colon or slash, before the version; ``path`` the last path segment, without query and fragment."""
    if mode == "arxiv":
        return F.regexp_replace(F.regexp_extract(raw, r"([^:/]*)$", 1), r"v\d+$", "")
    if mode == "path":
        return F.substring_index(F.regexp_replace(F.regexp_replace(raw, r"[?#].*$", ""), r"/+$", ""), "/", -1)
    return raw
