"""The wildcard automaton against regular expressions on characters of all planes, and rules from tables."""

from __future__ import annotations

import random
import re

import pytest

from curatrix.llm import url_rules


def pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return out


def test_all_planes():
    rng = random.Random(8)
    letters = "ab/.-éя中😀𝒳"
    globs = ["*.x/中", "**/я*", "?.😀/**", *("".join(rng.choice([*letters, "*", "**", "?"]) for _ in range(rng.randrange(1, 8))) for _ in range(150))]
    texts = [".a.x/я", ".a.x/中", "", *("".join(rng.choice(letters + "ÿĀ😁") for _ in range(rng.randrange(0, 12))) for _ in range(400))]
    fits = url_rules.Automaton(tuple(url_rules.Rule("block", g) for g in globs)).run(texts)
    compiled = [re.compile(pattern(g), re.S) for g in globs]
    assert [[bool(p.fullmatch(t)) for p in compiled] for t in texts] == fits.tolist()


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("block", "*.x/中**", "x"), ("block", "*.x/中**", "x"), (None, "**", None), ("allow", None, None), ("block", "*.я/**", None)], "verdict string, glob string, name string")
    pages = spark.createDataFrame([(1, "http://a.x/中文"), (2, "http://a.x/я"), (3, "http://b.я/"), (4, None)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, table, ()).collect()}
    assert got == {1: ("x", "block"), 2: (None, "allow"), 3: ("*.я/**", "block"), 4: (None, "allow")}
    assert {r.verdict for r in url_rules.judge_urls(pages, (), table.filter("false")).collect()} == {"allow"}
    with pytest.raises(ValueError, match="more than 1 rules"):
        url_rules.rules_of(table, most=1)
