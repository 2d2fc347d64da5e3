"""Line dedup against a brute-force version of the tree, and against planted boilerplate in the test documents."""

from __future__ import annotations

import collections
import random
import re

import pytest

from curatrix.llm import line_dedup
from curatrix.llm.common import table as read

SF = "/root/testdata/sf0.01"


def brute(texts, least, most=line_dedup.MOST_RECURRING, fixed=line_dedup.LEAST_FIXED, share=line_dedup.SHARE):
    """The numbers of each text's lines that go."""
    found, sizes = {}, {}
    for text in {t for t in texts if t}:
        plain = [line.split() for line in text.split("\n")]
        lines = [line.split() for line in re.sub(r"(?<!\S)[^\s\d]*\d\S*", "<*>", text).split("\n")]
        sizes[text] = sum(map(len, lines))
        found[text] = {k: tuple(x) if any(w != "<*>" for w in x) else ("as it is", *plain[k]) for k, x in enumerate(lines) if x}
    count = collections.Counter(x for lines in found.values() for x in set(lines.values()))
    leaves = collections.defaultdict(dict)
    for x, n in count.items():
        if n < least:
            leaves[x if x[0] == "as it is" else (len(x), x[:3])][x] = n
    templates = {x: {("own", x)} for x, n in count.items() if n >= least}
    for leaf, members in leaves.items():
        total = sum(members.values())
        if total >= least:
            shared = collections.Counter()
            for x, n in members.items():
                for at, word in enumerate(x):
                    shared[(at, word)] += n
            for x in members:
                narrow = tuple((at, w) for at, w in enumerate(x) if shared[(at, w)] >= least)
                wide = tuple(p for p in narrow if shared[p] >= share * total)
                templates[x] = {("leaf", leaf, k) for k in (narrow, wide) if k and len(k) >= fixed * len(x)}
    of = lambda text: [(k, t) for k, x in found[text].items() for t in templates.get(x, ())]
    recurs = lambda chosen: {t for t, n in collections.Counter(t for text in chosen for t in {t for _, t in of(text)}).items() if n >= least}
    candidates = recurs(found)
    voters = [text for text in found if sum(len(found[text][k]) - (found[text][k][0] == "as it is") for k in {k for k, t in of(text) if t in candidates}) <= most * sizes[text]]
    final = {t for t, n in collections.Counter(t for text in voters for t in {t for _, t in of(text) if t in candidates}).items() if n >= least}
    return {text: {k for k, t in of(text) if t in final} for text in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_is_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split())
    line = lambda: rng.choice([lambda: word(), lambda: f"{word()} {rng.randrange(99)}", lambda: f"log of {word()} by {word()} in {word()}", lambda: " ".join(word() for _ in range(rng.randrange(2, 7))), lambda: f"{rng.randrange(9)} {rng.randrange(9)}", lambda: "  ", lambda: "a shared  line\tof text", lambda: f"u{'x' * rng.randrange(99)} {'y' * rng.randrange(99)} {word()} {'z' * rng.randrange(9)}"])()
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 12))) for _ in range(70)]
    texts += texts[:5] * 3 + [None, "", "\n\n", "7", "word " * 3000]
    expected = brute(texts, 4)
    assert any(expected.values())
    got = line_dedup.drop_template_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=4).collect()
    for r in got:
        text = texts[r.doc_id]
        gone = expected.get(text, set())
        assert r.n_dropped == len(gone) and r.text == (text and "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)), (text, gone)


def test_planted_boilerplate_goes_and_clean_lines_stay(spark):
    """Five-line blocks, two-token footers and templates with two word fields in 200 of 1,000 documents of any length."""
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    block = [f"{w} clause of the licence that all these pages carry" for w in ("First", "Second", "Third", "Fourth", "Fifth")]
    name = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3))
    copies = collections.Counter(t for _, t in rows)
    whole = [k for k, (_, t) in enumerate(rows) if t and copies[t] == 1]
    chosen = set(rng.sample(whole, 200))
    planted = []
    for k, (i, text) in enumerate(rows):
        if k in chosen:
            lines = text.split("\n")
            at = rng.randrange(len(lines) + 1)
            lines = [*lines[:at], *block, *lines[at:], f"Posted by user {name(rng.randrange(40))} in the forum about {name(1000 + rng.randrange(90))} today", "Page footer"]
            text = "\n".join(lines)
        planted.append((i, text))
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_template_lines(df).collect()}
    plain = {r.doc_id: r.text for r in line_dedup.drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = sum(sum(x in block or x == "Page footer" or x.startswith("Posted by user") for x in got[rows[k][0]].split("\n")) for k in chosen)
    recall = 1 - left / (7 * len(chosen))
    same = sum(got[i] == plain[i] for i, _ in rows) / len(rows)
    print(f"planted lines that go: {recall:.3f}; documents otherwise left as without the plants: {same:.3f}")
    assert recall >= 0.9 and same >= 0.98


def test_pages_that_are_mostly_boilerplate(spark):
    """Short pages of four fixed lines and one of their own lose the four; so do lines of variable fields alone that recur as they are."""
    fixed = ["Accept all cookies to continue reading this page", "Log in or register to leave a comment", "All rights reserved by the publisher of this site", "Home News Sport Weather Contact"]
    name = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    rows = [(k, "\n".join([*fixed, f"{name(k)} {name(7 * k + 3)} wrote {name(11 * k + 5)} {name(13 * k)} {name(17 * k)} here {name(19 * k)} and {name(23 * k)}"])) for k in range(200)]
    got = line_dedup.drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == 800 and all(r.text == rows[r.doc_id][1].split("\n")[4] for r in got)
    dated = [(k, f"2024-01-01\n{k} {k + 1}\n" + " ".join(name(k * 31 + j) for j in range(9))) for k in range(20)]
    got = line_dedup.drop_template_lines(spark.createDataFrame(dated, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 and "2024" not in r.text for r in got)
