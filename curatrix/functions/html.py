"""Text of HTML pages.

The text of hidden elements is left out, counted by depth: each opening tag of one goes a level down, each closing tag of any a level up, and text
counts on the top level only. Tags of blocks break the line at every depth. A regular page, in which hidden elements neither nest nor stay open and
every ``<`` begins a plain tag, is read natively; any other goes through Arrow to a parser that keeps the depth.
"""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .urls import strip

#: Elements whose text is not shown, and those that stand on lines of their own.
HIDDEN = ("script", "style", "head", "nav", "footer", "noscript")
BLOCKS = ("p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "li", "tr", "br", "blockquote", "pre")
#: Entities that are decoded inside the JVM, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
_OTHER = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z])"

#: An ampersand that begins no reference with a semicolon at its end; and pairs that stand for one, and for the mark itself, while a page is read.
_LONE = r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)"
_MARK, _LITERAL, _AMPERSAND = "\uFDD0", "\uFDD0\uFDD1", "\uFDD0\uFDD2"

#: Stands for a block's tag while hidden text goes; a page that has it is not regular.
_BREAK = "\uE000"
_ATTRIBUTES = r"""(?:\s+[A-Za-z][A-Za-z0-9_:\-]*(?:="[^"<>]*"|='[^'<>]*'|=[A-Za-z0-9_.%#\-]+)?)*+\s*"""
_PLAIN_TAG = rf"<(?:[A-Za-z][A-Za-z0-9]*{_ATTRIBUTES}/?|/[A-Za-z][A-Za-z0-9]*\s*)>"
#: Contents that no tags are looked for in.
_RAW = rf"(?is)<(script|style){_ATTRIBUTES}>.*?</\1\s*>"
_COMMENT = r"(?s)<!--(?!-?>)(?:[^<>\-]++|-(?!-))*+-->|(?i)<!doctype[^<>]*>"
_SKIPPED = "head|nav|footer|noscript"
#: Elements that parsers read in ways of their own, hidden ones that close themselves, raw ones that are left, a reference cut in two by a tag.
_SPECIAL = rf"(?i)<(?:textarea|iframe|noembed|noframes|xmp|plaintext|script|style)\b|<(?:{_SKIPPED})\b[^>]*/>|&[#A-Za-z0-9]*<|&[#A-Za-z0-9]*$|{_BREAK}"
_TITLE = r"(?is)<title>[^<]*</title\s*>"


class _Text(HTMLParser):
    """Visible text of a page of any kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found = 0, []

    def _block(self, tag: str) -> None:
        if tag in BLOCKS:
            self.found.append("\n")

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN
        self._block(tag)

    def handle_endtag(self, tag):
        self.depth -= tag in HIDDEN and self.depth > 0
        self._block(tag)

    def handle_data(self, data):
        if not self.depth:
            self.found.append(data)


def parsed_text(page: str) -> str:
    """The page's visible text with its line breaks, before blanks are squeezed. What follows the last tag counts, too."""
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "".join(parser.found)


@pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(entities.unescape, na_action="ignore")


@pandas_udf(StringType())
def _parsed(page: pd.Series) -> pd.Series:
    return page.map(parsed_text, na_action="ignore")


def _without_raw(page: Column) -> Column:
    """A page without comments and without the contents of raw elements."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(page, F.lit("")), _RAW, ""), _COMMENT, "")


def is_regular(page: Column) -> Column:
    """Whether the native path reads a page as a parser does.

    Hidden elements open and close in turn, each by its own name; every ``<`` begins a plain tag; and nothing is left that parsers treat apart.
    """
    rest = _without_raw(page)
    tags = F.lower(F.array_join(F.regexp_extract_all(rest, F.lit(rf"(?i)<(/?(?:{_SKIPPED}))\b"), 1), " "))
    in_turn = tags.rlike(rf"^(?:({_SKIPPED}) /\1(?: |$))*+$")
    bare = F.regexp_replace(rest, _PLAIN_TAG, "")
    # A comment or a raw element's opening inside the other would be cut wrongly.
    page = F.coalesce(page, F.lit(""))
    nested = F.exists(F.regexp_extract_all(page, F.lit(_RAW), 0), lambda x: x.contains("<!--")) | F.exists(F.regexp_extract_all(page, F.lit(r"(?s)<!--.*?-->"), 0), lambda x: x.rlike(r"(?i)<(?:script|style)\b"))
    titles = F.regexp_replace(rest, _TITLE, "").rlike(r"(?i)<title\b")
    return in_turn & ~bare.contains("<") & ~rest.rlike(_SPECIAL) & ~nested & ~titles


def _native_text(page: Column) -> Column:
    """The visible text of a regular page with its line breaks."""
    blocks = "|".join(BLOCKS)
    out = F.regexp_replace(_without_raw(page), rf"(?i)<(?:{blocks})\b[^>]*/>", _BREAK * 2)
    out = F.regexp_replace(out, rf"(?i)</?(?:{blocks})\b[^>]*>", _BREAK)
    # Every second part is inside a hidden element; of it the blocks' breaks stay.
    parts = F.split(out, rf"(?i)</?(?:{_SKIPPED})\b[^>]*>")
    out = F.array_join(F.transform(parts, lambda part, k: F.when(k % 2 == 0, part).otherwise(F.regexp_replace(part, f"[^{_BREAK}]", ""))), "")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    common = out
    for name, char in ENTITIES:
        common = F.replace(common, F.lit(name), F.lit(char))
    odd = out.rlike(_OTHER)
    return F.translate(F.when(odd, _decoded(F.when(odd, out))).otherwise(common), _BREAK, "\n")


def with_ended_references(page: Column) -> Column:
    """A page in which only references that end in a semicolon are any; every other ampersand is marked as text."""
    return F.regexp_replace(F.replace(page, F.lit(_MARK), F.lit(_LITERAL)), _LONE, _AMPERSAND)


def page_text(page: Column, ended: bool = False) -> Column:
    """Visible text, line by line: a block's tags each break the line, runs of blanks become one, and of blank lines one stays.

    Null and empty pages are empty. Only irregular pages, and texts with an entity beyond the common ones, cross to Python, in Arrow batches.
    ended: references count only where a semicolon ends them (``&amp`` stays as it stands); parsers also decode some without it.
    """
    if ended:
        return F.replace(F.replace(page_text(with_ended_references(page)), F.lit(_AMPERSAND), F.lit("&")), F.lit(_LITERAL), F.lit(_MARK))
    regular = is_regular(page)
    out = F.when(regular, _native_text(F.when(regular, page))).otherwise(_parsed(F.when(~regular, F.coalesce(page, F.lit("")))))
    lines = F.split(F.regexp_replace(out, r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", "\n"), "\n")
    out = F.array_join(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit("\n"))


def squeezed(text: str) -> str:
    """The same squeezing for one text, for tests of the parser's path."""
    lines = [re.sub(r"[ \t]+", " ", line).strip() for line in text.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")
