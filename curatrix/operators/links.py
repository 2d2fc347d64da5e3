"""Mining links of documents: fix commits, repositories and their mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: First path segments of links that are no repositories, and the patterns of repository and commit links.
BLOCKED_OWNERS = ("sponsors", "features", "about", "pricing", "topics", "site", "readme", "marketplace", "settings", "notifications", "apps")
REPOSITORY = r"(?i)github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
COMMIT = r"(?i)github\.com/([^/\s]+/[^/\s]+)/commit/([0-9a-f]{7,40})"


def most_mentioned(docs: DataFrame, key: str, text: str, pattern: str = REPOSITORY, blocked: tuple[str, ...] = BLOCKED_OWNERS) -> DataFrame:
    """Each document's most mentioned link target; ties go to the first mention. ``.git`` and trailing punctuation are cut, in
    this order; owners are compared without case."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("at", "hit"))
    name = F.regexp_replace(F.regexp_replace("hit", r"\.git$", ""), r"[.,);]+$", "")
    counted = found.withColumn("target", name).filter(~F.lower(F.substring_index("target", "/", 1)).isin(*blocked)).groupBy(key, "target").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).filter("rank = 1").select(key, "target", "n")


def fix_commit(advisories: DataFrame, key: str, references: str, location: str) -> DataFrame:
    """The first commit among an advisory's references whose repository is its source location, else the first commit.

    The location is compared whole: ``own/r12`` is not ``own/r1``.
    """
    home = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(location), F.lit("")), r"^https?://github\.com/", ""), F.lit("/")))
    refs = advisories.select(key, home.alias("home"), F.posexplode(references).alias("at", "url"))
    hits = refs.select(key, "home", "at", F.regexp_extract("url", COMMIT, 1).alias("repo"), F.regexp_extract("url", COMMIT, 2).alias("commit")).filter("commit <> ''")
    own = F.col("home") == F.lower("repo")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(own.desc(), "at"))
    return hits.withColumn("rank", rank).filter("rank = 1").select(key, "repo", "commit")


def best_repository(candidates: DataFrame, key: str) -> DataFrame:
    """Of (key, pos, url, official, stars) the best valid link: official first, then stars, then order."""
    valid = candidates.withColumn("repo", F.regexp_replace(F.regexp_extract("url", REPOSITORY, 1), r"\.git$", "")).filter("repo <> ''")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("official", F.lit(False)).desc(), F.coalesce("stars", F.lit(0)).desc(), "pos"))
    return valid.withColumn("rank", rank).filter("rank = 1").select(key, "repo")
