"""Line dedup: blocks of boilerplate, and templates with several word fields at several sizes."""

from __future__ import annotations

import random

import pytest

from curatrix.llm import line_dedup

SCHEMA = "doc_id long, text string"


def unique(i, k):
    return f"{'abcdefghij'[k]}{'x' * i} stands only here as {'y' * i} once {'z' * k}"


def cut(spark, docs):
    return {r.doc_id: r.text for r in line_dedup.drop_template_lines(spark.createDataFrame(docs, SCHEMA)).collect()}


@pytest.mark.parametrize("size", [2, 3, 6])
def test_whole_blocks_go(spark, size):
    block = [f"This is {w} of the shared block" for w in ("one", "two", "three", "four", "five", "six")[:size]]
    own = [[unique(i, k) for k in range(8)] for i in range(14)]
    docs = [(i, "\n".join(x[:4] + block + x[4:])) for i, x in enumerate(own)]
    docs += [(100 + i, "\n".join(f"{w} a" for w in x)) for i, x in enumerate(own)]
    got = cut(spark, docs)
    assert all(got[i] == "\n".join(x) for i, x in enumerate(own)) and all(got[k] == t for k, t in docs[14:])
    for place in (lambda x: block + x, lambda x: x + block):
        assert cut(spark, [(i, "\n".join(place(x))) for i, x in enumerate(own)]) == {i: "\n".join(x) for i, x in enumerate(own)}


def test_edited_copies_stay(spark):
    lines = [f"Line {w} of a page that was copied" for w in "one two three four five six seven eight nine ten".split()]
    docs = []
    for i in range(60):
        mine = list(lines)
        mine[i % 10] = unique(i, 0)
        docs.append((i, "\n".join(mine)))
    assert cut(spark, docs) == dict(docs)


@pytest.mark.parametrize("n", [60, 2500])
def test_two_word_fields_go_at_every_size(spark, n):
    rng = random.Random(n)
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    docs = [(i, f"q{word(i)} begins\n{word(i)} r {word(i + 1)} s\nPosted by user {word(rng.randrange(50))} in the forum about {word(1000 + rng.randrange(100))} today\nt {word(i)} u v {word(i + 2)}\nends {word(i)}") for i in range(n)]
    got = cut(spark, docs)
    assert all("Posted by" not in t and t.count("\n") == 3 for t in got.values())
