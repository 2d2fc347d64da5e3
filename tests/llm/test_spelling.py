"""Spelling variants against brute force, on odd rows, and trie nodes across partitions."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import spelling


def brute(rows, least_chars=6, least_count=5, times=5, every=199):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    near = {w: {v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)} for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def found(docs, **rules):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.spelling_forms(docs, misspell=True, **rules).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n long, form string").repartition(7)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Straße", "STRAßE", "naïveté", "naïvete", "hellooo", "helloo"]
    weights = [1 / (k % 60 + 1) for k in range(len(vocabulary))]
    out = [(i, ", ".join(rng.choices(vocabulary, weights, k=rng.choice((0, 3, 200))))) for i in range(60)]
    return [*out, out[3], (None, "aaaaaa " * 9), (100, None), (101, ""), (102, "1234 \n"), (103, ("z" * 3000 + " ") * 5), (104, ("y" + "z" * 2999 + " ") * 30)]


def test_against_brute_force(spark, rows):
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, rows), least_chars=2, least_count=1, times=2) == brute(rows, 2, 1, 2)


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["abcdefgh"] * 5 + ["abcdefgx"] * 25 + ["abcdefyx"] * 125 + ["abcdezyx"] * 625))]
    assert [r[2] for r in found(table(spark, rows))] == ["abcdezyx"] * 4


def test_empty(spark):
    assert found(table(spark, [])) == [] and found(table(spark, [(1, None)])) == []


def test_nodes_across_partitions(spark, monkeypatch):
    """A number for each prefix, whatever the partitions; whole words in order."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(400)} | {"a" * k for k in range(1, 30)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
        rows = spelling.numbered(df, F.col("word"), "fore").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    node = {}
    for r in rows:
        for depth, number in enumerate(r.fore):
            assert node.setdefault(r.word[:depth], number) == number
    assert len(set(node.values())) == len(node)
    ends = [r.fore[-1] for r in sorted(rows, key=lambda r: r.word)]
    assert ends == sorted(ends) and len(rows) == len(words)
