"""Main text of HTML pages by equivalence-class template deduction.

1. Every page is cut into tokens: an element in its path (``tag.class`` from the
   root down) and a run of text, of any length, in its path.  A path is a digest
   of its parent's and its last step, so a token's size doesn't grow with depth.
2. For each host, a token's occurrence vector says how often it occurs on each
   different page; it is held as a digest that is an exclusive or over the pages,
   so it is aggregated like a sum.  Tokens of a host with equal vectors are an
   equivalence class.  Classes of two tokens or more on enough pages are valid.
   A class is nested in the class of its tokens' parent elements.
3. The nested classes are the host's template; text of it is what the site says
   on its every page.  All other text fills slots.
4. The slot text below each element is added up over the host's pages.  The
   main container is the deepest element of the template that holds most of the
   host's unlinked slot text, or the one above it that has the heading too.
5. A page's main text is that of the slots below the container.

What a page says of itself comes last: below the container, elements that are
known as a menu, footer, sidebar, notice, advert, form or comment by tag, role,
class or id are left out; text in ``article`` or ``main`` is never taken for the
template's.  Hosts of fewer than ``LEAST_PAGES`` different pages have too few for
vectors to tell; there such elements don't count as slots, and a page that has
no container takes ``article`` or ``main``, or else all slots.

Character references are decoded; white space in a block becomes one space, and
blocks are joined by one space in page order.

Defined results: a null or empty page has an empty text; broken markup is read
as browsers do in the cases that matter here (unclosed paragraphs and items,
stray ends, raw text up to its end tag or the page's end, a tag without its end
is text, and after a quote without its end tags end at the next ``>``).  Time and memory grow with a page's length, however deep it is.  A
null or odd URL belongs to the host "".  Rows that repeat an id are extracted
one by one; equal pages of a host count once for its template, unless their
ids are equal too.  Where the template would take more than half of a page's
container, the page is a copy of others and keeps all of it.  An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

LEAST_PAGES = 5
SHARE = 0.9
CONTAINER = 0.6
HEADED = 1.3  # how much more text the element with the heading may hold

# Elements by what they are.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input meta link base area col embed source track param".split())
VOID = frozenset("br img input meta link base area col embed source track param hr wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp".split())
UNSEEN = frozenset("head script style noscript template textarea title select option iframe object svg math canvas audio video noembed noframes datalist".split())
APART = frozenset("nav header footer aside form button dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body main article".split())
TEXTUAL = HEADINGS | frozenset("p li dt dd ul ol dl blockquote pre table thead tbody tr td th caption figure figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip status".split())
NAMES = frozenset("ad ads adv advert advertisement advertising adsense sponsor sponsored banner promo promoted promotion nav navi navigation navbar menu submenu breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside rail comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager login search form hidden copyright disclaimer tags skip".split())
# An element of the first name ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"}, "body": {"head"}}
BOUNDS = frozenset("ul ol dl table tr td th div section article main body html nav aside header footer form blockquote".split())

_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
_END = r"</([a-zA-Z][^\s/>]*+)[^>]*>"
_TAG = re.compile(_OTHER + "|" + _END + r"""|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|(?!["'])))*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_SIMPLE = re.compile(_OTHER + "|" + _END + r"|(?!)()()|<([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_LATE = re.compile(_OTHER + "|(?!)()()()()()", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_NOT = frozenset(("has", "with", "no", "without"))
ROOT = 0


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw == "/":
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _apart(name: str, attributes: dict[str, str], within: bool) -> bool:
    """Whether an element says of itself that it isn't of the article."""
    if name in APART and not (name == "header" and within):
        return True
    if not attributes or name in WHOLE:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    for word in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = _PART.findall(_CAMEL.sub("-", word).lower())
        if any(p in NAMES and not (k and parts[k - 1] in _NOT) for k, p in enumerate(parts)):
            return True
    return False


def _key(above: int, step: str) -> int:
    """The digest of a step below a path: an element's, or a text's after ``\0``."""
    return xxhash.xxh3_64_intdigest(step, above & ((1 << 64) - 1)) - (1 << 63)


class Block:
    """A run of text, or (``text`` is None) the start of an element that isn't inline."""

    __slots__ = ("path", "parent", "depth", "name", "text", "linked", "article", "apart", "inside")

    def __init__(self, path, parent, depth, name, text, linked, article, apart, inside):
        self.path, self.parent, self.depth, self.name, self.text = path, parent, depth, name, text
        self.linked, self.article, self.apart, self.inside = linked, article, apart, inside

    @property
    def key(self) -> int:
        return self.path if self.text is None else _key(self.path, "\0" + self.text)


def blocks(html: str, container: int | None = None) -> Iterator[Block]:
    """The elements and texts of a page in order, less those that are never shown.
    ``linked`` counts characters in links; ``inside`` says whether a block is below
    the element of the path ``container``."""
    top = (ROOT, ROOT, 0, "", False, False, False, False, 0)  # path, parent, depth, name, article, apart, unseen, inside, open p
    stack: list[tuple] = []
    here, opened = top, Counter()
    parts: list[str] = []
    linked, depth_a, at, end, last, tag = 0, 0, 0, len(html), html.rfind(">"), _TAG

    def flush():
        nonlocal linked
        text = "" if here[6] else " ".join(unescape("".join(parts)).split())
        held = Block(here[0], here[1], here[2], here[3], text, min(linked, len(text)), here[4], here[5], here[7])
        parts.clear()
        linked = 0
        return held if text else None

    def cut(k: int) -> tuple:
        for row in stack[k:]:
            opened[row[3]] -= 1
        del stack[k:]
        return stack[-1] if stack else top

    while at < end:
        match = (tag if at <= last else _LATE).search(html, at)
        stop = match.start() if match else end
        if stop > at:
            parts.append(html[at:stop])
            if depth_a:
                linked += stop - at
        if not match:
            break
        at = match.end()
        closing, name = match[1], match[2] or match[4]
        if closing:
            closing = closing.lower()
            if closing == "a":
                depth_a = max(0, depth_a - 1)
            if closing in INLINE:
                continue
            if block := flush():
                yield block
            if opened[closing] > 0 and not (closing == "p" and not here[8]):
                k = len(stack) - 1
                while stack[k][3] != closing:
                    k -= 1
                here = cut(k)
            depth_a = 0
            continue
        if not name:
            continue
        if match[4]:
            tag = _SIMPLE  # some quote has no end: to look for one at every tag would be quadratic
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = found.end() if found else end
            continue
        if name in INLINE:
            if name == "a":
                depth_a += 1
            continue
        if block := flush():
            yield block
        ends = CLOSES.get(name, set()) | ({"p"} if name not in ("option",) else set())
        k = len(stack)
        while k and (stack[k - 1][3] in ends or stack[k - 1][3] in HEADINGS and name in HEADINGS):
            k -= 1
        if k < len(stack):
            here = cut(k)
        if name in VOID:
            continue
        depth_a = 0
        attributes = _attributes(match[3] or match[5] or "")
        mark = "." + _DIGITS.sub("0", " ".join(attributes["class"].split()[:3])) if attributes.get("class") else ""
        path = _key(here[0], f"{name}{mark}")
        article = here[4] or name in ("article", "main") or attributes.get("role") == "main"
        inside = here[7] or path == container
        apart = here[5] or _apart(name, attributes, here[4] or here[7])
        if path == container:
            apart = False  # what holds the host's text isn't apart by its name
        here = (path, here[0], here[2] + 1, name, article, apart, here[6] or name in UNSEEN, inside, (0 if name in BOUNDS else here[8]) + (name == "p"))
        stack.append(here)
        opened[name] += 1
        yield Block(path, here[1], here[2], name, None, 0, article, apart, inside)
    if block := flush():
        yield block


def host(url: str | None) -> str:
    """The host of a URL, in small letters, without a port."""
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _arrays(out: list[list], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def tokens(pages: DataFrame) -> DataFrame:
    """``host, token, parent, vec, text``: a row for each different token of a
    page; ``text`` says whether it is one."""
    names, types = ["host", "token", "parent", "vec", "text"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                html = html or ""
                page = xxhash.xxh3_64_digest(html)
                count = Counter((b.key, b.parent if b.text is None else b.path, b.text is not None) for b in blocks(html) if b.text is None or not b.article)
                if count:
                    count[ROOT, ROOT, False] = 1  # the page itself
                out[0] += [site] * len(count)
                out[1] += [k[0] for k in count]
                out[2] += [k[1] for k in count]
                out[3] += [xxhash.xxh3_64_intdigest(page + n.to_bytes(8, "big")) - (1 << 63) for n in count.values()]
                out[4] += [k[2] for k in count]
            yield _arrays(out, names, types)

    return pages.select("host", "html").mapInArrow(run, "host string, token long, parent long, vec long, text boolean")


def classes(found: DataFrame) -> DataFrame:
    """``host, token, parent, class, pages, text``: the different tokens of each
    host, with the digest of their occurrence vector."""
    return found.groupBy("host", "token").agg(F.first("parent").alias("parent"), F.bit_xor("vec").alias("class"), F.count("*").alias("pages"), F.first("text").alias("text"))


def template(each: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The tokens of valid classes (two tokens or more, on ``share`` of at least
    ``least_pages`` pages of the host) with the class in which theirs is nested."""
    total = each.where(F.col("token") == ROOT).select("host", F.col("pages").alias("site_pages")).where(F.col("site_pages") >= least_pages)
    often = each.where(F.col("pages") >= share * least_pages).join(total, "host").where(F.col("pages") >= share * F.col("site_pages"))
    sizes = often.groupBy("host", "class").agg(F.count("*").alias("class_size")).where("class_size >= 2")
    above = often.select("host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    return often.join(sizes, ["host", "class"]).join(above, ["host", "parent"], "left")


def masses(pages: DataFrame) -> DataFrame:
    """``host, token, depth, pages, mass, named, heads`` of each element that may be
    a container: the unlinked slot text below it over a host's pages (``named``:
    less that which is apart by name) and the headings."""
    names = ["host", "token", "depth", "mass", "named", "heads"]
    types = [pa.string(), *[pa.int64()] * 5]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for site, html, fixed in rules_of(batch, 0, 1, 2):
                place = {}
                sums: dict[int, list[int]] = {ROOT: [0, 0, 0]}
                for b in blocks(html or ""):
                    place[ROOT] = (ROOT, 0, True)
                    if b.text is None:
                        place[b.path] = (b.parent, b.depth, b.name not in TEXTUAL)
                        sums.setdefault(b.path, [0, 0, 0])
                    elif b.article or b.key not in fixed:
                        own = sums[b.path]
                        free = len(b.text) - b.linked if 2 * b.linked < len(b.text) else 0
                        own[0] += free
                        own[1] += 0 if b.apart else free
                        own[2] += b.name in ("h1", "h2")
                for path in sorted(place, key=lambda x: -place[x][1]):
                    above, own = place[path][0], sums[path]
                    if path != ROOT:
                        into = sums[above]
                        for k in range(3):
                            into[k] += own[k]
                for path, (_, depth, box) in place.items():
                    if box and (sums[path][0] or path == ROOT):
                        for held, x in zip(out, (site, path, depth, *sums[path]), strict=True):
                            held.append(x)
            yield _arrays(out, names, types)

    found = pages.select("host", "html", "fixed").mapInArrow(run, "host string, token long, depth long, mass long, named long, heads long")
    return found.groupBy("host", "token").agg(F.first("depth").alias("depth"), F.count("*").alias("pages"), F.sum("mass").alias("mass"), F.sum("named").alias("named"), F.sum(F.least("heads", F.lit(1))).alias("heads"))


def containers(each: DataFrame) -> DataFrame:
    """``host, container``: from :func:`masses`, the path that holds the host's text."""
    weight = F.when(F.col("site_pages") >= LEAST_PAGES, F.col("mass")).otherwise(F.col("named"))
    site = each.where(F.col("token") == ROOT).select("host", F.col("pages").alias("site_pages"), F.when(F.col("pages") >= LEAST_PAGES, F.col("mass")).otherwise(F.col("named")).alias("site_mass"))
    deep = each.where(F.col("token") != ROOT).join(site, "host").withColumn("weight", weight)
    deep = deep.where((F.col("weight") >= CONTAINER * F.col("site_mass")) & (F.col("weight") > 0) & (F.col("pages") >= SHARE * F.col("site_pages")))
    place = F.struct("depth", "token")
    headed = 2 * F.col("heads") >= F.col("site_pages")
    best = deep.groupBy("host").agg(F.max_by(F.struct("token", "weight"), place).alias("deepest"), F.max_by(F.struct("token", "weight"), F.when(headed, place)).alias("headed"))
    chosen = F.when(F.col("headed.weight") <= HEADED * F.col("deepest.weight"), F.col("headed.token")).otherwise(F.col("deepest.token"))
    return best.select("host", chosen.alias("container"))


def rules_of(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """The rows of a batch, whose last column of ``columns`` is a list of tokens,
    as a set that neighbours share if it is the same."""
    *others, fixed = (batch.column(k) for k in columns)
    last, held = None, frozenset()
    for *row, found in zip(*(c.to_pylist() for c in others), fixed, strict=True):
        found = found.values if found.is_valid else None
        if found is None:
            yield (*row, frozenset())
            continue
        if last is None or not found.equals(last):
            last, held = found, frozenset(found.to_numpy().tolist())
        yield (*row, held)


def slots(html: str | None, fixed: frozenset[int]) -> list[Block]:
    """The texts of a page that fill slots of its host's template."""
    return [b for b in blocks(html or "") if b.text and b.key not in fixed]


def main_text(html: str | None, fixed: frozenset[int], container: int | None) -> str:
    """The main text of one page, given its host's template and container."""
    texts = [b for b in blocks(html or "", container) if b.text]
    body = [b for b in texts if b.inside and not b.apart]
    if not body:
        body = [b for b in texts if b.article and not b.apart] or [b for b in texts if not b.apart and 2 * b.linked <= len(b.text)]
    chosen = [b for b in body if b.article or b.key not in fixed]
    if 2 * sum(len(b.text) for b in chosen) < sum(len(b.text) for b in body):
        chosen = body
    return " ".join(b.text for b in chosen)


def site_rules(once: DataFrame) -> DataFrame:
    """``host, fixed, container`` from the different pages (``host, html``) of
    each host: the tokens of its nested classes, and the path of its text."""
    nested = template(keep(classes(tokens(once)), "classes")).where("text AND parent_class IS NOT NULL")
    fixed = keep(nested.groupBy("host").agg(F.collect_set("token").alias("fixed")), "fixed")  # at most 1 / SHARE times a page's texts
    found = keep(masses(once.join(fixed, "host", "left")), "masses")
    return containers(found).join(fixed, "host", "full").select("host", "fixed", "container")


def different(rows: DataFrame) -> DataFrame:
    """``host, html`` of the pages (``id, host, html``), each host's equal ones
    once: that with the least id.  Only digests are moved, and the pages not, if
    the table of repeated digests is small enough to be broadcast."""
    marked = rows.withColumn("copy", F.xxhash64(F.coalesce("html", F.lit(""))))
    many = marked.groupBy("host", "copy").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("host", "copy", "least")
    many = keep(many, "copies")
    found = marked.join(many.withColumn("some", F.lit(True)), ["host", "copy"], "left")
    return found.where(F.col("some").isNull() | F.col("id").eqNullSafe(F.col("least"))).select("host", "html")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` for each page."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][A-Za-z0-9_+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.withColumn("host", site)
    rules = keep(site_rules(different(rows.select("id", "host", "html"))), "rules")  # kept, so that a large host's pages can be split in the join
    joined = rows.join(rules, "host", "left").select("id", "url", "html", "container", "fixed")

    def run(batches):
        for batch in batches:
            texts = [main_text(html, fixed, container) for html, container, fixed in rules_of(batch, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = joined.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
