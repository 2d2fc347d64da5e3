"""References are fitted, from any corpus; those of the library are what the fit gives for the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.llm import quality
from curatrix.llm.common import table

LARGE = "/root/testdata/sf0.1"


def test_the_librarys_references_are_the_fits(spark):
    vocabulary = {lang: list(known) for lang, known in quality.COMMON_WORDS.items()}
    found = quality.fit_references(table(spark, LARGE, "documents"), table(spark, LARGE, "labels"), vocabulary=vocabulary)
    assert found.words == quality.COMMON_WORDS
    assert set(found.classes) == set(quality.CLASS_SHARES)
    assert all(abs(a - b) <= 0.0001 for lang, shares in quality.CLASS_SHARES.items() for a, b in zip(shares, found.classes[lang]))


def test_a_small_corpus(spark):
    docs = spark.createDataFrame([(1, "Ab ab. ba BA 12", "xx", "w"), (2, "ab ab", "xx", "w"), (3, "no no no", "xx", "w"), (4, None, "xx", "w"), (5, "z", None, "w"), (None, "q q", "yy", "w"), (2, "ab ab", "xx", "w")], "doc_id long, text string, lang string, word string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (5, 1), (2, 1), (None, 1)], "doc_id long, quality int")
    found = quality.fit_references(docs, labels)
    # 15 + 5 + 5 characters: 13, 3, 6, 2 and 1 of the classes; nine words, five of them "ab" without a full stop.
    assert found.words == {"xx": {"ab": round(5 / 9, 4), "ba": round(2 / 9, 4)}}
    assert found.classes == {"xx": (0.52, 0.12, 0.24, 0.08, 0.04, 0.0, 0.0)}
    assert quality.fit_references(docs, labels.filter("false")) == quality.References({}, {})
    assert quality.fit_references(docs, labels, good=F.col("quality") == 0).words == {"xx": {"no": 1.0}}
    assert sum(quality.fit_references(docs, labels, most_rows=1).classes["xx"]) > 0.99
    text = " ".join(["ab ba"] * 3 + ["ab", "c", "d"] * 30)
    rows = spark.createDataFrame([(1, text, "xx"), (2, text, "zz")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(rows, references=found).collect()}
    assert got[1].word_distance is not None and got[2].word_distance is None and got[2].class_distance is not None
    none = quality.quality_rules(rows, references=quality.References({}, {})).collect()
    assert all(r.class_distance is None and r.word_distance is None and r.kept != r.base_failed for r in none)
