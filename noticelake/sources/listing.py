"""Announcement rows from the tables of listing pages."""

from __future__ import annotations

import re
from datetime import date
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("published", "title", "url")]))


class _Table(HTMLParser):
    """Cells of each row: their text, and the first link in them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.open = False
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(["", None])
            self.open = tag == "td"
        elif tag == "a" and self.open and self.rows[-1][-1][1] is None:
            self.rows[-1][-1][1] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1][0] += data


def _day(text: str) -> str | None:
    m = re.fullmatch(r"\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\s*", text)
    try:
        return m and date(*map(int, m.groups())).isoformat()
    except ValueError:
        return None


def table_rows(html: str | None, base: str | None) -> list[dict]:
    """Rows with a valid date in the first cell and a titled link in the second;
    the first of each address.  Null or broken markup gives what could be read."""
    parser, found = _Table(), {}
    parser.feed(html or "")
    parser.close()
    for cells in parser.rows:
        if len(cells) < 2:
            continue
        day, title, link = _day(cells[0][0]), " ".join(cells[1][0].split()), cells[1][1]
        if day and title and link:
            url = urljoin(base or "", link.strip())
            found.setdefault(url, {"published": day, "title": title, "url": url})
    return list(found.values())


@F.pandas_udf(ROW)
def _rows(html: pd.Series, base: pd.Series) -> pd.Series:
    text = lambda v: v if isinstance(v, str) else None
    return pd.Series([table_rows(text(h), text(b)) for h, b in zip(html, base, strict=True)], dtype=object)


def listing_rows(pages: DataFrame, html: str, base: str, *keys: str) -> DataFrame:
    """One row for each announcement, with its place on the page."""
    each = pages.select(*keys, F.posexplode(_rows(F.col(html), F.col(base))).alias("place", "row"))
    return each.select(*keys, "place", "row.*")


def same_site(url: Column, base: Column) -> Column:
    """Whether a link stays on its listing's host."""
    host = lambda c: F.lower(F.regexp_extract(c, r"://([^/?#:]*)", 1))
    return host(url) == host(base)
