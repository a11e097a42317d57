"""Announcements from listing pages, by specifications that are data, and the
links from a listing to its other pages.

A specification says which links are candidates and where a date is looked for.
Defined results: null pages have no rows; of rows with one address (or, for
headings, one title, date and address) the first counts; impossible dates and
numbers of IP addresses are passed over, and a missing date is an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dom import Node, parse

# Patterns and words of the domain's listings.
NUMERIC = [r"(20\d{2})[./-](\d{1,2})[./-](\d{1,2})", r"(1\d{2})[./-](\d{1,2})[./-](\d{1,2})"]
SPELLED = r"(\d{3,4})年\s*(\d{1,2})月\s*(\d{1,2})日"
LOOSE = [r"(20\d{2})\s*[./\-年]\s*(\d{1,2})\s*[./\-月]\s*(\d{1,2})", r"(?<!\d)(1\d{2})\s*[./\-年]\s*(\d{1,2})\s*[./\-月]\s*(\d{1,2})"]
IP_ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
IN_PATH = r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)"
MARKED = "獎助學金 獎學金 助學金 獎助金 獎勵學金 助學計畫".split()
RELEVANT = "獎學金 助學金 獎助 補助 就學金".split()
BARE = frozenset("獎學金 助學金 獎助學金 校外獎學金 校外助學金 校外獎助學金 獎助學金公告 最新校外獎學金申請訊息公告".split())
SITE_HEADINGS = frozenset(["各項公告", "申請報名", "登入", "常見問題", "教育部", "ministry of education 教育部"])
NEXT = frozenset("下一頁 下頁 next > »".split())
PAGE_KEYS = frozenset("page pageno page_no pageindex page_index".split())
NO_PAGE = ("javascript:", "mailto:", "tel:")


def line(text: str) -> str:
    return " ".join(text.split())


def day(found: re.Match | None) -> str:
    """An ISO date; years before 1911 count from there."""
    if not found:
        return ""
    year, month, of_month = map(int, found.groups())
    try:
        return date(year + 1911 if year < 1911 else year, month, of_month).isoformat()
    except ValueError:
        return ""


def first_day(patterns: Sequence[str], text: str) -> str:
    """The first date that exists, in the order of the patterns."""
    text = re.sub(IP_ADDRESS, "|", text)
    return next(filter(None, (day(m) for p in patterns for m in re.finditer(p, text))), "")


def listed_date(text: str) -> str:
    """The first date of a row's text that exists, full years before short ones."""
    return first_day(NUMERIC, text)


def site(url: str) -> str:
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


@dataclass(frozen=True)
class Spec:
    """Which links of a page are announcements.

    ``find``: how rows are found (a name in ``FINDERS``); ``marks``: parts of the
    address one of which is needed; ``hosts``: hosts that are allowed; ``rows``:
    selectors of rows; ``entry``: a title for the listing itself, if it is an
    announcement too."""

    source: str
    find: str
    marks: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    rows: tuple[str, ...] = ("tr", "li", "article", ".item", ".news", ".list-item")
    words: tuple[str, ...] = tuple(MARKED)
    entry: str = ""


Row = tuple[str, str, str]  # title, date, address


def undated_table(page: Node, base: str, spec: Spec) -> Iterator[Row | None]:
    """Rows of three cells and more; the third is a deadline and no date."""
    for row in (n for n in page.walk() if n.name == "tr"):
        cells = [n for n in row.walk() if n.name == "td"]
        link = next(cells[0].links(), None) if len(cells) >= 3 else None
        if link:
            url = urljoin(base, link.attrs["href"].strip())
            yield (link.text(), "", url) if any(m in url for m in spec.marks) else None


def linked_news(page: Node, base: str, spec: Spec) -> Iterator[Row | None]:
    """Links by a part of their address, dated by the nearest row, item, article
    or block that has a date."""
    for link in page.links():
        if any(m in link.attrs["href"] for m in spec.marks):
            near = (link.enclosing(name) for name in ("tr", "li", "article", "div"))
            yield link.text(), next(filter(None, (listed_date(n.text()) for n in near if n)), ""), urljoin(base, link.attrs["href"])


def detail_links(page: Node, base: str, spec: Spec) -> Iterator[Row | None]:
    """Links to the host's own detail pages, dated by their table row or one of
    the five elements around."""

    def dated(node: Node) -> str:
        text = node.text()
        return first_day([*NUMERIC, SPELLED], text)

    for link in page.links():
        url = urljoin(base, link.attrs["href"])
        if site(url) == site(base) and any(m.casefold() in urlsplit(url).path.casefold() for m in spec.marks):
            near = [n for n in [link.enclosing("tr"), *list(link.above())[:5]] if n]
            yield link.text(), next(filter(None, map(dated, near)), ""), url


def marked_anchors(page: Node, base: str, spec: Spec) -> Iterator[Row | None]:
    """Links to allowed hosts whose text, or a text near them, names an award."""
    for link in page.links():
        href = link.attrs["href"].strip()
        url = urljoin(base, href)
        if not href or href.startswith(("#", *NO_PAGE)) or not any(site(url) == h or site(url).endswith(f".{h}") for h in spec.hosts):
            yield None
            continue
        near = [link.text()]
        for node in list(link.above())[:3]:
            near += [line(s) for s in node.strings()]
            if node.name in ("li", "tr", "article"):
                break
        near = list(dict.fromkeys(near))
        title = next((t for t in near if any(w in t for w in spec.words) and 4 <= len(t) <= 220), "")
        if title in BARE or (url.rstrip("/") == base.rstrip("/") and not spec.entry):
            title = ""
        context = " ".join(near)
        published = first_day(LOOSE, context) or day(re.search(IN_PATH, urlsplit(url).path))
        yield (title, published, url) if title else None


def relevant_rows(page: Node, base: str, spec: Spec) -> Iterator[Row | None]:
    """Dated rows by selector whose link stays on the host and whose title is relevant."""
    for row in page.select(spec.rows):
        link = next(row.links(), None)
        if link:
            url, title = urljoin(base, link.attrs["href"]), " ".join(link.strings())
            parts, own = urlsplit(url), urlsplit(base)
            fits = (not parts.netloc or parts.netloc == own.netloc) and any(m in parts.path or m in parts.query for m in spec.marks)
            published = listed_date(row.text())
            yield (title, published, url) if fits and published and len(line(title)) >= 4 and any(w in line(title) for w in spec.words) else None


def dated_headings(page: Node, base: str, spec: Spec) -> Iterator[Row | None]:
    """Headings with a date in one of the five elements from themselves outwards."""
    for head in (n for n in page.walk() if n.name in ("h2", "h3", "h4", "h5", "h6")):
        title = head.text()
        if len(title) < 4 or title.casefold() in SITE_HEADINGS:
            continue
        box = next((n for n in [head, *head.above()][:5] if listed_date(n.text())), None)
        if box:
            link = next(head.links(), None) or next((n for n in head.above() if n.name == "a" and "href" in n.attrs), None) or next(box.links(), None)
            url = urljoin(base, link.attrs["href"]) if link else base
            yield title, listed_date(box.text()), url if site(url) == site(base) else base


def brochures(page: Node, base: str, spec: Spec) -> Iterator[Row | None]:
    """Items of two known classes; where a page has none, its dated headings."""
    links = [(n.text(), "", urljoin(base, n.attrs.get("href", "").strip())) for n in page.select(["a.brochure-dropdown__item"])]
    heads = [next(iter(n.select([".announce-title"])), None) for n in page.select([".announce-item"])]
    links += [(h.text(), "", f"{base}#announcement-{k}") for k, h in enumerate(heads, 1) if h]
    found = [r for r in links if r[0]]
    yield from found or dated_headings(page, base, spec)


FINDERS: dict[str, Callable[[Node, str, Spec], Iterator[Row | None]]] = {f.__name__: f for f in (undated_table, linked_news, detail_links, marked_anchors, relevant_rows, dated_headings, brochures)}


def scan(html: str | None, base: str | None, spec: Spec) -> tuple[list[Row], int]:
    """The announcements of a page and the number of its candidates."""
    base, found, raw = base or "", {}, 0
    for row in FINDERS[spec.find](parse(html), base, spec):
        raw += 1
        row = row and (line(row[0]), *row[1:])
        if row and row[0]:
            found.setdefault(row if spec.find in ("dated_headings", "brochures") else row[2], row)
    if spec.entry and base not in found:
        found = {base: (spec.entry, "", base), **found}
    return list(found.values()), raw


def page_links(html: str | None, base: str | None) -> dict:
    """``total`` pages of a listing as far as it tells, its ``numbered`` pages, the
    ones that its script counts (``counted``) and the ``next``."""
    html, base = html or "", base or ""
    page, own = parse(html), urlsplit(base)

    def same_listing(url: str) -> bool:
        root = lambda u: re.sub(r"/page/\d+$", "", urlsplit(u).path.rstrip("/"))
        return site(url) == site(base) and root(url) == root(base)

    def resolved(href: str) -> str:
        """In full, and not less safe than the listing itself."""
        parts = urlsplit(urljoin(base, href))
        return parts._replace(scheme="https").geturl() if own.scheme == "https" and parts.scheme == "http" and parts.hostname == own.hostname else urljoin(base, href)

    numbered, following = {}, None
    for link in page.links():
        href, label = link.attrs["href"].strip(), link.text()
        if not href or href.casefold().startswith("javascript:"):
            continue
        url, parts = resolved(href), urlsplit(href)
        if not same_listing(url):
            continue
        in_path = re.search(r"/page/(\d+)(?:/|$)", parts.path)
        keys = {k.casefold() for k in parse_qs(parts.query, keep_blank_values=True)}
        if in_path or (label.isdigit() and keys & PAGE_KEYS):
            numbered[int(in_path[1] if in_path else label)] = url
        if following is None and (label.casefold() in NEXT or "next" in link.attrs.get("rel", "").casefold().split()):
            following = url
    said, counted = re.search(r"共\s*(\d+)\s*頁", page.text()), re.search(r"totalPage\s*:\s*(\d+)", html)
    total = int(said[1]) if said else int(counted[1]) if counted else max([1, *numbered])
    prefix, now = re.search(r"urlPrefix\s*:\s*['\"]([^'\"]*PAGE[^'\"]*)['\"]", html), re.search(r"currentPage\s*:\s*(\d+)", html)
    others = [k for k in range(1, total + 1) if k != (int(now[1]) if now else 1)] if prefix and counted else []
    return {"total": total, "numbered": [numbered[k] for k in sorted(numbered)], "counted": [resolved(prefix[1]).replace("PAGE", str(k)) for k in others], "next": following}


def known_pages(html: str | None, base: str | None, most: int) -> list[str]:
    """The other pages that a listing names, at most ``most`` with itself."""
    found = page_links(html, base)
    urls = [*found["counted"], *found["numbered"], *([found["next"]] if found["next"] else [])]
    return [u for u in dict.fromkeys(urls) if u != base][: max(most - 1, 0)]


ROWS = T.StructType([T.StructField("rows", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "published", "url")]))), T.StructField("raw", T.IntegerType())])
LINKS = T.StructType([T.StructField("total", T.IntegerType()), T.StructField("numbered", T.ArrayType(T.StringType())), T.StructField("counted", T.ArrayType(T.StringType())), T.StructField("next", T.StringType())])


def _texts(column: pd.Series) -> list[str | None]:
    return [v if isinstance(v, str) else None for v in column]


def scanned(pages: DataFrame, spec: Spec, html: str, base: str, *keys: str) -> DataFrame:
    """``keys``, ``source``, ``place``, ``title``, ``published``, ``url`` of every announcement."""

    @F.pandas_udf(ROWS)
    def rows(html: pd.Series, base: pd.Series) -> pd.DataFrame:
        found = [scan(h, b, spec) for h, b in zip(_texts(html), _texts(base), strict=True)]
        return pd.DataFrame({"rows": [[dict(zip(("title", "published", "url"), r, strict=True)) for r in x] for x, _ in found], "raw": [n for _, n in found]})

    each = pages.select(*keys, rows(F.col(html), F.col(base)).alias("found"))
    each = each.select(*keys, F.lit(spec.source).alias("source"), F.posexplode("found.rows").alias("place", "row"))
    return each.select(*keys, "source", "place", "row.*")


@F.pandas_udf(LINKS)  # type: ignore[call-overload]
def links_of(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    """:func:`page_links` over columns."""
    return pd.DataFrame([page_links(h, b) for h, b in zip(_texts(html), _texts(base), strict=True)], columns=["total", "numbered", "counted", "next"])
