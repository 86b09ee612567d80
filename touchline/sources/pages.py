"""Web pages: data embedded in scripts and tables hidden in comments."""

from __future__ import annotations

import codecs
import json
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

#: What pages of a challenge instead of content say in their first 4000 characters.
CHALLENGE = ("just a moment", "cf-challenge", "challenge-platform", "cf_chl_opt", "enable javascript and cookies", "attention required")
_EMBEDDED = re.compile(r"var\s+(\w+)\s*=\s*JSON\.parse\(\s*'(.*?)'\s*\)", re.DOTALL)


def embedded_json(html: str, variable: str):
    """The value of `var NAME = JSON.parse('...')`, its escapes undone; ValueError where it is absent or no JSON."""
    for name, body in _EMBEDDED.findall(html):
        if name == variable:
            text = codecs.decode(body, "unicode_escape").encode("latin-1", "backslashreplace").decode("utf-8", "replace")
            return json.loads(text)
    raise ValueError(f"no variable {variable!r} in the page")


def challenged(html: Column) -> Column:
    head = F.lower(F.substring(html, 1, 4000))
    out = F.lit(False)
    for mark in CHALLENGE:
        out = out | head.contains(mark)
    return out


def uncommented(html: Column) -> Column:
    """Comments that hold a table opened up, the others left alone. The JVM's matcher takes each comment by itself."""
    return F.regexp_replace(html, r"(?is)<!--((?:(?!-->).)*?<table(?:(?!-->).)*)-->", "$1")


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<!--.*?-->", "")


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[tuple[str, int, bool]]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.depth += 1
        elif self.depth and tag == "tr":
            self.tables[-1].append([])
        elif self.depth and tag in ("td", "th") and self.tables[-1]:
            span = dict(attrs).get("colspan") or "1"
            self.cell = ["", int(span) if span.isdigit() else 1, tag == "th"]

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif tag in ("td", "th") and self.cell:
            self.tables[-1][-1].append((" ".join(self.cell[0].split()), self.cell[1], self.cell[2]))
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[0] += data


def page_tables(html: str) -> list[tuple[list[str], list[list[str]]]]:
    """(columns, rows) of every table of a page, hidden ones too; a header of two rows is joined as UPPER_LOWER.

    ValueError for a challenge page and for a page without tables.
    """
    if any(mark in html[:4000].lower() for mark in CHALLENGE):
        raise ValueError("the page is a challenge, not content")
    parser = _Tables()
    parser.feed(re.sub(r"<!--(.*?)-->", lambda m: m[1] if "<table" in m[1].lower() else m[0], html, flags=re.DOTALL))
    out = []
    for rows in parser.tables:
        wide = [[text for text, span, _ in row for _ in range(span)] for row in rows if row]
        heads = [all(th for *_, th in row) for row in rows if row]
        if not wide:
            continue
        columns, body = wide[0], wide[1:]
        if len(wide) > 1 and heads[0] and heads[1]:
            columns, body = [low if not up else f"{up}_{low}" for up, low in zip(wide[0], wide[1])], wide[2:]
        out.append((columns, body))
    if not out:
        raise ValueError("the page has no tables")
    return out


_ELEMENT = re.compile(r"""<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>|<h([1-6])[^>]*>(.*?)</h\3>""", re.DOTALL)
_TAG = re.compile(r"<[^>]*>")


@udtf(returnType="kind string, place int, target string, text string", useArrow=True)
class PageElements:
    """(kind, place, target, text): a row for each link (with its target) and heading (h1 to h6) of a page, numbered by kind; tags inside are left out of the text. Null: no rows."""

    def eval(self, html: str):
        seen = {"link": 0, "heading": 0}
        for target, link, level, heading in _ELEMENT.findall(html or ""):
            kind = "heading" if level else "link"
            seen[kind] += 1
            yield kind, seen[kind], f"h{level}" if level else target, _TAG.sub("", heading if level else link)


@udtf(returnType="number int, place int, cells array<string>", useArrow=True)
class PageTables:
    """(number, place, cells): the rows of a page's tables, hidden ones too; place 0 has the columns. A page without tables gives no rows."""

    def eval(self, html: str):
        try:
            tables = page_tables(html or "")
        except ValueError:
            return
        for number, (columns, body) in enumerate(tables, 1):
            for place, cells in enumerate([columns, *body]):
                yield number, place, list(cells)


def table_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, number, place, cells) of all tables of all pages, by a lateral join."""
    spark = pages.sparkSession
    spark.udtf.register("page_tables", PageTables)
    return spark.sql(f"SELECT p.`{key}`, t.* FROM {{pages}} AS p, LATERAL page_tables(p.`{html}`) AS t", pages=pages)


def page_elements(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, kind, place, target, text) of all elements of all pages, by a lateral join."""
    spark = pages.sparkSession
    spark.udtf.register("page_elements", PageElements)
    return spark.sql(f"SELECT p.`{key}`, e.* FROM {{pages}} AS p, LATERAL page_elements(p.`{html}`) AS e", pages=pages)
