"""Substring dedup where hashes are dealt to buckets in several levels, by small flushes and groups."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest

from curatrix.llm.substring_dedup import remove_repeats


def brute(rows, n=35):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + n]) for w in docs for k in range(len(w) - n + 1))
    out = collections.Counter()
    for (i, _), w in zip(rows, docs):
        gone = {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    """Passages that two documents share, some that many share, one that a third of them share, copies, and texts of their own."""
    rng = random.Random(11)
    passage = lambda k: " ".join(f"p{k}x{rng.randrange(50)}" for _ in range(36 + k % 20))
    shared = [passage(k) for k in range(60)]
    out = []
    for i in range(400):
        parts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((3, 30, 80))))]
        parts += [rng.choice(shared) for _ in range(rng.choice((0, 1, 2)))] + ([shared[0]] if i % 3 == 0 else [])
        rng.shuffle(parts)
        out.append((i, " ".join(parts)))
    out += [(500 + i, out[i][1]) for i in range(0, 60, 4)] + [(7, out[7][1]), (600, None), (601, ""), (None, out[9][1])]
    return out


@pytest.mark.parametrize(("fan", "held"), [(4, 60), (8, 10_000), (2, 500)])
def test_levels(spark, rows, fan, held):
    """64 buckets in three, two and six levels: the result is that of brute force, whatever the groups."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, fan=fan, held=held).collect())
    assert got == brute(rows)


def test_levels_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"), fan=4).count() == 0
    alone = spark.createDataFrame([(1, " ".join(map(str, range(100))))], "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in remove_repeats(alone, fan=4).collect()] == [(100, 0)]
