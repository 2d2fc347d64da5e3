"""URL rules by a bit-parallel wildcard automaton.

Every glob of the rule set is laid out, state by state, in one bit vector over as many 64-bit words as it
takes. A step of Shift-And then moves all globs over one character of all URLs of a batch at once:
``states = ((states << 1) | starts) & allowed[character] | states & loops[character]``. In a glob ``*``
stands for any characters but ``/``, ``**`` for any characters, ``?`` for one character but ``/``; all else is
literal. Globs are matched against a canonical URL: a dot, the lower-cased host, and the path, so that
``*.example.com/en/**`` is the host, all its subdomains, and the paths below ``/en/``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    glob: str
    name: str | None = None

    @staticmethod
    def site(verdict: str, host: str, path: str) -> "Rule":
        """A host with all its subdomains, and the paths that start with ``path`` (with its slash)."""
        return Rule(verdict, f"*.{host}{path}**", host + path)


RULES = (Rule.site("block", "com", "/en/"), Rule.site("allow", "example.com", "/en/7"), Rule.site("allow", "net", "/de/"), Rule.site("block", "example.net", "/de/8"), Rule.site("block", "org", "/es/"))
#: The method's own globs, for URLs that no rule above fits.
OWN_GLOBS = (Rule("block", "*.spam-*.**"), Rule("block", "*.ads.*.**"), Rule("block", "**/wp-login.php"), Rule("block", "*.casino-*.**"), Rule("block", "**/click-tracker/**"))


class Automaton:
    """All globs of a rule set. Each character that stands in a glob has a class of its own, all others one class that only wildcards fit."""

    def __init__(self, rules: tuple[Rule, ...]):
        # A state per literal or ``?``, entered by that character; its loop is the wildcard that follows it.
        states: list[tuple[int, int | None, str]] = []  # (rule, character or None, loop)
        self.first: list[int] = []
        self.last: list[int] = []
        for k, rule in enumerate(rules):
            head, own, i = "", [], 0
            while i < len(rule.glob):
                c = rule.glob[i]
                if c == "*":
                    wild = "**" if rule.glob[i : i + 2] == "**" else "*"
                    i += len(wild)
                    if own:
                        own[-1] = (k, own[-1][1], max(own[-1][2], wild))
                    else:
                        head = max(head, wild)
                    continue
                own.append((k, None if c == "?" else ord(c), ""))
                i += 1
            self.first.append(len(states))
            states.append((k, -1, head))  # the state before the first character
            states += own
            self.last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.known = np.array(sorted({ord("/"), *(c for _, c, _ in states if c is not None and c >= 0)}), np.uint32)
        class_of = {c: k + 1 for k, c in enumerate(self.known.tolist())}  # 0: any other character
        slash = class_of[ord("/")]
        self.allowed = np.zeros((len(self.known) + 1, self.words), np.uint64)
        self.loops = np.zeros((len(self.known) + 1, self.words), np.uint64)
        for s, (_, char, loop) in enumerate(states):
            w, bit = s // 64, np.uint64(1) << np.uint64(s % 64)
            if char is None:
                self.allowed[:, w] |= bit
                self.allowed[slash, w] &= ~bit
            elif char >= 0:
                self.allowed[class_of[char], w] |= bit
            if loop:
                self.loops[:, w] |= bit
                if loop == "*":
                    self.loops[slash, w] &= ~bit
        self.start = np.zeros(self.words, np.uint64)
        for s in self.first:
            self.start[s // 64] |= np.uint64(1) << np.uint64(s % 64)

    def run(self, urls: list[str]) -> np.ndarray:
        """Which rules fit which URLs, as booleans (URLs, rules). Long URLs end later; each character is one step of all."""
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        codes = np.frombuffer("".join([urls[i] for i in order]).encode("utf-32-le"), np.uint32)
        place = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        codes = np.where(self.known[place] == codes, place + 1, 0)
        firsts = np.cumsum(lengths) - lengths
        states = np.tile(self.start, (n, 1))
        top, one = np.uint64(63), np.uint64(1)
        for at in range(int(lengths[0]) if n else 0):
            live = int(np.searchsorted(-lengths, -at, side="left"))  # those longer than ``at``
            char = codes[firsts[:live] + at]
            now = states[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            states[:live] = (moved & self.allowed[char]) | (now & self.loops[char])
        fits = np.zeros((n, len(self.last)), bool)
        for k, s in enumerate(self.last):
            fits[order, k] = (states[:, s // 64] >> np.uint64(s % 64)) & one
        return fits


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host (A-Z) and path; both empty without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.encode().translate(_LOWER).decode(), rest[:end]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Words of state (eight bytes each) that a batch of URLs holds.
MOST_WORDS = 1 << 20


def _judge(rules: tuple[Rule, ...], own: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules + own)
        best = np.array([len(r.name or r.glob) for r in rules] + [0] * len(own))
        for batch in slices(batches, max(16, min(4096, MOST_WORDS // automaton.words))):
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            fits = automaton.run([f".{h}{p}" for h, p in parts])
            named = np.where(fits[:, : len(rules)], best[: len(rules)], -1)
            choice = named.argmax(axis=1) if len(rules) else np.zeros(len(parts), int)
            has = (named.max(axis=1) >= 0) if len(rules) else np.zeros(len(parts), bool)
            spare = fits[:, len(rules) :]
            any_own = spare.any(axis=1) if len(own) else np.zeros(len(parts), bool)
            first_own = spare.argmax(axis=1) if len(own) else choice
            rule = [rules[c].name or rules[c].glob if h else None for c, h in zip(choice, has)]
            verdict = [rules[c].verdict if h else own[o].verdict if a else "allow" for c, h, o, a in zip(choice, has, first_own, any_own)]
            glob = [rules[c].glob if h else own[o].glob if a else None for c, h, o, a in zip(choice, has, first_own, any_own)]
            host, path = zip(*parts) if parts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict, glob))], names=["page_id", "host", "path", "rule", "verdict", "glob"])

    return run


#: Rules that a table may hold: with their globs' characters they make an automaton that each task builds (some 100 MB at most).
MOST_RULES = 20_000


def rules_of(rules: DataFrame, most: int = MOST_RULES) -> tuple[Rule, ...]:
    """The rules of a table (verdict, glob, and optionally name), in order of glob and verdict; ValueError beyond ``most``, which are counted first.

    Rows without a glob or without a verdict of block or allow are no rules; repeated rows are one.
    """
    name = F.col("name") if "name" in rules.columns else F.lit(None).cast("string")
    kept = rules.filter(F.col("glob").isNotNull() & F.col("verdict").isin("block", "allow")).select("glob", "verdict", name.alias("name")).distinct()
    found = kept.orderBy("glob", "verdict", "name").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules")
    return tuple(Rule(r.verdict, r.glob, r.name) for r in found)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, own: tuple[Rule, ...] | DataFrame = OWN_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, the longest rule that fits (else null) and a verdict for each row; no shuffle.

    A null or empty URL, and one without ``://``, has an empty host and path and is allowed unless a glob fits
    that. Repeated rows are judged alike; an empty table gives no rows; other columns are left out. URLs of any length are
    read whole: one character of all URLs of a batch is a step, and a batch has fewer URLs the more rules there are. Rules are given as they are
    or as tables (``rules_of``).
    """
    rules, own = (rules_of(x) if isinstance(x, DataFrame) else tuple(x) for x in (rules, own))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_judge(rules, own), f"page_id {kind}, host string, path string, rule string, verdict string, glob string")


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    translate(CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
      ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
      ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
judged AS (
  SELECT *, '.' || host AS dotted,
    CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches('.' || host, '\.spam-[^/]*\.|\.ads\.[^/]*\.|\.casino-[^/]*\.') THEN 'block'
       WHEN path LIKE '%/wp-login.php' OR path LIKE '%/click-tracker/%' THEN 'block'
       ELSE 'allow' END AS verdict
FROM judged
"""
