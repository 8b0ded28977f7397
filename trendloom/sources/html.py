"""Records from HTML pages, by the standard library's parser. One page is one row, so pages spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Select(HTMLParser):
    """Texts, and the links inside, of elements of one tag and class (outermost ones)."""

    def __init__(self, tag: str, cls: str | None):
        super().__init__()
        self.tag, self.cls, self.depth, self.found = tag, cls, 0, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth:
            if tag == self.tag:
                self.depth += 1
            if tag == "a" and a.get("href") and self.found[-1][1] is None:
                self.found[-1][1] = a["href"]
        elif tag == self.tag and (self.cls is None or self.cls in (a.get("class") or "").split()):
            self.depth = 1
            self.found.append([[], a.get("href")])

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.found[-1][0].append(data)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.cells, self.table, self.row, self.text = [], -1, -1, None

    def _close(self):
        if self.text is not None:
            self.cells.append((self.table, self.row, self.col, " ".join("".join(self.text).split())))
            self.text = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self._close()
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th") and self.table >= 0 and self.row >= 0:
            self._close()
            self.col, self.text = self.col + 1, []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def select_elements(html: str | None, tag: str, cls: str | None = None) -> list[tuple[str, str | None]]:
    p = _Select(tag, cls)
    p.feed(html or "")
    return [(" ".join("".join(t).split()), href) for t, href in p.found]


def table_cells(html: str | None) -> list[tuple[int, int, int, str]]:
    p = _Tables()
    p.feed(html or "")
    p._close()
    return p.cells


def html_select(pages: DataFrame, tag: str, cls: str | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, item (from 0), text, href of each element of a tag and class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, t, h) for k, page in zip(b.iloc[:, 0], b.iloc[:, 1]) for i, (t, h) in enumerate(select_elements(page, tag, cls))]
            yield pd.DataFrame(rows, columns=["key", "item", "text", "href"])

    return pages.select(F.col(key).cast("string"), html).mapInPandas(run, "key string, item int, text string, href string")


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table_no, row_no, col_no, text of each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *c) for k, page in zip(b.iloc[:, 0], b.iloc[:, 1]) for c in table_cells(page)]
            yield pd.DataFrame(rows, columns=["key", "table_no", "row_no", "col_no", "text"])

    return pages.select(F.col(key).cast("string"), html).mapInPandas(run, "key string, table_no int, row_no int, col_no int, text string")


def html_records(pages: DataFrame, cls: str, prefix: str = "", key: str = "page_id", html: str = "html") -> DataFrame:
    """key, item, title, href, about: cards (div of a class) with a heading link; cards without one are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, page in zip(b.iloc[:, 0], b.iloc[:, 1]):
                for i, (title, href, about) in enumerate(_cards(page, cls)):
                    rows.append((k, i, title, prefix + href, about))
            yield pd.DataFrame(rows, columns=["key", "item", "title", "href", "about"])

    return pages.select(F.col(key).cast("string"), html).mapInPandas(run, "key string, item int, title string, href string, about string")


class _Cards(HTMLParser):
    def __init__(self, cls: str):
        super().__init__()
        self.cls, self.depth, self.cards, self.inside = cls, 0, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "div":
            if self.depth:
                self.depth += 1
            elif self.cls in (a.get("class") or "").split():
                self.depth = 1
                self.cards.append({"title": None, "href": None, "about": []})
        if self.depth and tag not in _VOID:
            self.inside.append(tag)
            card = self.cards[-1]
            if tag == "a" and "h2" in self.inside and card["title"] is None:
                card["title"], card["href"] = [], a.get("href") or ""

    def handle_endtag(self, tag):
        if self.depth and tag in self.inside:
            while self.inside.pop() != tag:
                pass
        if tag == "div" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.inside = []

    def handle_data(self, data):
        if self.depth:
            card = self.cards[-1]
            if "a" in self.inside and "h2" in self.inside and card["title"] is not None:
                card["title"].append(data)
            elif "p" in self.inside:
                card["about"].append(data)


def _cards(html: str | None, cls: str) -> list[tuple[str, str, str]]:
    p = _Cards(cls)
    p.feed(html or "")
    return [("".join(c["title"]).strip(), c["href"], "".join(c["about"]).strip()) for c in p.cards if c["title"] is not None]


def title(html: Column | str) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def upper_tags(html: Column | str) -> Column:
    """All tags in capitals, texts as they are."""
    whole = F.array_join(F.transform(F.regexp_extract_all(F.concat(html, F.lit("<>")), F.lit("([^<]*)(<[^>]*>)"), F.lit(0)), lambda p: F.concat(F.regexp_extract(p, "^([^<]*)", 1), F.upper(F.regexp_extract(p, "(<.*)$", 1)))), "")
    return F.left(whole, F.length(whole) - 2)
