"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from conftest import SMALL

from curatrix.llm import jaccard
from curatrix.llm.common import table


def brute(rows):
    """Component (a list of places) of each row, by all pairs."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (shared and 9 * shared >= 4 * (len(sets[a]) + len(sets[b]))):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block, large", [(2048, 256), (5, 2)])
def test_near_dedup_stage_is_brute_force_jaccard(spark, block, large, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard.jaccard_components, "__defaults__", ("doc_id", "text", block))
    rng = random.Random(8)
    texts = [None, "", " \n", "one two", "one two", "ONE two", "one two three four five", "one two three four six"]
    passage = [f"p{k}" for k in range(40)]
    for base in range(6):
        words = [f"w{base}x{rng.randrange(400)}" for _ in range(rng.choice((30, 80, 200)))]
        texts += [edited(words, rng, rng.randrange(6)) for _ in range(14)]
    texts += [" ".join([*(f"u{k}x{j}" for j in range(12)), *passage]) for k in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    group = brute(rows)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, SMALL)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(least.values())


def test_near_dedup_of_documents(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    least = {}
    for (i, _), g in zip(rows, brute(rows)):
        least[g] = min(i, least.get(g, i))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == sorted(least.values())
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), SMALL).count() == 0


def test_sets_that_share_an_id_stay_apart(spark):
    rng = random.Random(9)
    texts = [None, "", "one two", "one two three four five six"]
    for base in range(12):
        words = [f"w{base}x{rng.randrange(400)}" for _ in range(60)]
        texts += [edited(words, rng, rng.randrange(4)) for _ in range(4)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.component_id, r.fp) for r in jaccard.jaccard_components(df, id_bits=2).collect()}
    assert {i: c for i, (c, _) in found.items()} == dict(enumerate(brute(rows)))
    assert len({fp for _, fp in found.values()}) == len({(t or "") for t in texts})


def test_a_task_forgets_what_it_sent(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "REMEMBERED", 2)
    rows = [("a b c d e f", 1, 9, 0, False), ("a b c d e f", 1, 9, 0, False), ("a b c d e g", 2, 9, 0, False), ("a b c d e h", 3, 9, 0, False), ("a b c d e f", 1, 9, 0, False)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["text", "node", "pivot", "part", "leads"])
    sent = [n for b in jaccard._sets(iter([batch])) for n in b.column("node").to_pylist()]
    assert sent == [1, 2, 3, 1]
