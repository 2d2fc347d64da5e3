"""Near-dedup's candidates are those of operator 1's search on the sets' fingerprints."""

from __future__ import annotations

import random

import numpy as np
from conftest import SMALL

from curatrix.llm import jaccard
from curatrix.llm.common import table
from curatrix.llm.simhash import MOST_BITS


def groups(n, pairs):
    group = list(range(n))
    for a, b in pairs:
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_candidates_connect_near_fingerprints(spark):
    rng = random.Random(3)
    texts = sorted({r.text for r in table(spark, SMALL, "documents").collect() if r.text})
    texts += [t + rng.choice((" more", " more words here", "")) for t in texts[::5]]
    ids = list(range(len(texts)))
    bits = [jaccard.fingerprint(s) for s in jaccard.shingle_sets(texts)]
    u = np.array(bits, np.int64).view(np.uint64)
    expected = groups(len(ids), [(a, b) for a in ids for b in range(a) if int(u[a] ^ u[b]).bit_count() <= MOST_BITS])
    found = jaccard.candidates(spark.createDataFrame(list(zip(ids, bits)), "fp long, bits long")).collect()
    assert len(found) < len(ids) and any(bits[r.a] != bits[r.b] for r in found)
    assert groups(len(ids), [(r.a, r.b) for r in found]) == expected


def test_the_search_is_a_step_of_the_stage(spark, monkeypatch):
    """Each candidate is verified: with none from the search the groups are the same, and with it fewer pairs are left to the set join."""
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join([*words, *(f"x{k}" for k in range(n))]) for n in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verified = []
    real, search = jaccard._verified, jaccard.candidates

    def counted(pairs, rows, distinct):
        pairs = jaccard.stage(pairs, "pairs")
        verified.append(pairs.count())
        return real(pairs, rows, distinct)

    monkeypatch.setattr(jaccard, "_verified", counted)
    with_search = sorted(tuple(r) for r in jaccard.jaccard_components(df).select("doc_id", "component_id").collect())
    first = list(verified)
    verified.clear()
    monkeypatch.setattr(jaccard, "candidates", lambda distinct: search(distinct).filter("false"))
    without = sorted(tuple(r) for r in jaccard.jaccard_components(df).select("doc_id", "component_id").collect())
    assert with_search == without and {c for _, c in without} == {0}
    assert first[0] > 0 and sum(first[1:]) < sum(verified[1:])
