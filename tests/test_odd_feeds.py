"""Feeds of texts that XML can't carry as they are, and of sources that look like numbers: all rows come back as their SQL has them."""

from __future__ import annotations

import duckdb
import pytest

from curatrix import registry

TEXTS = (None, "", "   ", "\n\n", "\nab", "ab\t ", "a\rb\r\nc", "a\x01b\x0bc\x1f", "\x0cab", "a\x00b", "a\ufffeb", "a\uffff", "\ufdd0\x85\u2028", "\u00a0 ab\u3000", "base64:YQ==", "a]]>b</item><item>&#10;<!-- &amp;", "\u00e9\U0001f600\n" * 5000)
SOURCES = ("007", "08", "src1", "", None, " a/b=c%20 \u00e9", "__HIVE_DEFAULT_PARTITION__", "base64:x")
LANGS = ("en", None, "", " e n ", "a&<'\">", "?", "e\n\x01", "a, b")


@pytest.mark.parametrize("sources", [SOURCES, SOURCES[:2]])
def test_odd_feeds_equal_their_sql(spark, tmp_path, sources):
    odd = [(11 * k + 1, text, LANGS[k % len(LANGS)], sources[k % len(sources)], 3) for k, text in enumerate(TEXTS * 4)]
    broken = [(11 * k + 3, "lost", "en", s, 4) for k, s in enumerate(sources * 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", odd + broken)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    for name in ("feed_files", "feed_files_broken", "feed_items_xml", "atom_items"):
        found = sorted((tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()), key=repr)
        assert found == sorted(con.execute(registry.oracle_sql()[name]).fetchall(), key=repr), name


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("feed_files", "feed_files_broken"):
        assert registry.queries()[name](spark, str(tmp_path)).collect() == [], name
