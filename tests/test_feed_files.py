"""Landed feed files: how many there are follows the bytes, not the documents; whole ones and broken ones are both read."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from curatrix import registry
from curatrix.bindings import Tables
from curatrix.plans import payloads


def test_files_follow_bytes(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text & <b> \n of "), "id", F.repeat(F.lit(" x"), 50)).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 2).alias("source"), F.lit(3).cast("long").alias("n_chars"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))

    def landed():
        files = spark.read.text(payloads._landed_feeds(Tables(spark, str(tmp_path))), wholetext=True)
        return files.count(), files.filter(F.col("value").contains("broken <b>")).count()

    assert landed() == (8, 2)  # four of each source
    monkeypatch.setattr(payloads, "FEED_BYTES", 10_000)
    count, broken = landed()
    assert 20 <= count <= 30 and 6 <= broken <= 8
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / 'documents.parquet'}/*.parquet'")
    for name in ("feed_files", "feed_files_broken"):
        found = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
        assert found == sorted(con.execute(registry.oracle_sql()[name]).fetchall()), name
