"""The pipeline's stages, each on all that its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from conftest import SMALL

from test_jaccard import brute

from curatrix.llm import decontaminate, line_dedup, quality
from curatrix.llm.common import stage, table


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]
    counts = [docs.count()]
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, stage(function(spark, docs, SMALL), "test")
        if name == "quality rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.quality_rules(before).filter("kept").collect()}
        if name == "line dedup":
            cut = {r.doc_id: r for r in line_dedup.drop_template_lines(before).collect()}
            assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (r.text, len(r.text)) for i, r in cut.items()} and any(r.n_dropped for r in cut.values())
        if name == "near-dedup":  # the rule for stages without a contract of their own: similarity 0.8 on shingles of five words
            rows, least = [(r.doc_id, r.text) for r in before.collect()], {}
            for (i, _), g in zip(rows, brute(rows)):
                least[g] = min(i, least.get(g, i))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(least.values())
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contamination(before, table(spark, SMALL, "benchmark")).filter("contaminated").collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
        else:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SMALL, name).filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


PROSE = "the committee met in the morning to hear of what the engineers had found and it was clear to all that the bridge with a crack in it was not to be opened for the season"


def edge_cases(spark):
    """Nulls in every column, empty and very long texts, repeated rows, copies, and columns that clash with the operators' own."""
    texts = [None, "", " \n", "short", PROSE, PROSE, PROSE + " again", f"{PROSE} {'q' * 300_000}", "lone " * 40_000, f"{PROSE}\n" + "\n".join(f"line {k} of {'x' * k}" for k in range(40))]
    rows = [(i if i != 2 else None, t, "en" if i % 3 else None, None if i % 4 == 1 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[0], (None, None, None, None, None)]
    clash = ("row_key", "of_key", "gone", "fp", "kept", "n_lines", "n_dropped", "component_id", "n_words")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'mine' AS {c}" for c in clash))


def test_stages_take_edge_cases(spark):
    docs = edge_cases(spark)
    given = docs.collect()
    results = {name: function(spark, docs, SMALL) for name, function in corpus_pipeline.STAGES}
    for name in ("quality rules", "line dedup", "near-dedup", "decontamination"):
        rows = results[name].collect()
        assert results[name].columns == docs.columns and all(r.row_key == r.n_lines == r.fp == "mine" for r in rows)
        if name == "quality rules":
            assert {r.text for r in rows} >= {PROSE} and all(r.text and len(r.text.split()) >= 10 for r in rows)
        if name == "line dedup":
            assert sorted(str(r) for r in rows) == sorted(str(r) for r in given)
        if name == "near-dedup":
            kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows)
            assert [k for k, _ in kept] == [0, 3, 4, 8, 9]  # 7 adds a single word
        if name == "decontamination":
            assert len(rows) == len(given)
    pieces = results["packing"].collect()
    assert sum(r.start == 0 for r in pieces) == len(given) and sum(r.length for r in pieces if r.doc_id == 0) == 2


def test_each_stage_takes_an_empty_table(spark):
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, edge_cases(spark).filter("false"), SMALL).count() == 0
