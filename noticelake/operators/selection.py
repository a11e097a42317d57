"""The announcement on its page: main content by versioned policies, attachment
links by value, and what a text says about its attachments.

Policies are data, one for each kind of site.  Defined results: a page whose
content can't be found, or is too short, has a null text; null texts ask for
nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalised
from ..sources.dom import Node, parse
from .attachments import BONUS, DOCUMENT_LABELS, LINK_ROLES, SHARED_HOSTS

# What is no content on any site, and each site's policy.
REMOVED = "script style noscript header nav footer aside form .header .footer .navbar .menu .sidebar .breadcrumb .banner .slider .carousel .bx-wrapper .swiper .owl-carousel .module-banner .social-share .related-posts".split()


@dataclass(frozen=True)
class Policy:
    """How the content of a site's pages is found."""

    name: str
    version: str
    mode: str  # auto, prefer_selectors or strict_selectors
    include: tuple[str, ...]
    least: int = 20
    remove: tuple[str, ...] = tuple(REMOVED)

    def digest(self) -> str:
        said = {"name": self.name, "version": self.version, "mode": self.mode, "include": self.include, "subtract": self.remove, "minimum": self.least}
        return hashlib.sha256(json.dumps(said, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


DEFAULT = Policy("default-html", "1", "auto", tuple("article main [role='main'] .mpgdetail .mcont .module-detail .article-content .news-content .content-body .entry-content".split()))
# The policy of hosts that end with a name (or are it, with ``=``).
POLICIES = {
    "lhu.edu.tw": Policy("lhu-html", "1", "prefer_selectors", tuple(".mpgdetail .module-detail .mcont .module-detail-inner article main".split())),
    "auden.com.tw": Policy("auden-html", "1", "prefer_selectors", tuple(".entry-content .et_pb_post_content .post-content article main".split())),
    "ccft.org.tw": Policy("ccft-html", "1", "prefer_selectors", tuple(".content .main-content .article-content main article".split())),
    "=announce.yzu.edu.tw": Policy("yzu-announcement-html", "1", "prefer_selectors", tuple(".item-page .com-content-article .com-content-article__body [itemprop='articleBody'] .article-content article main body".split()), 80),
    "ht.org.tw": Policy("ht-policy-html", "1", "prefer_selectors", tuple("#content .main-content .content .article-content article main body".split()), 80),
}


def policy_of(url: str | None) -> Policy:
    """The policy of an address's host."""
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = ""
    return next((p for end, p in POLICIES.items() if (host == end[1:] if end[0] == "=" else host.endswith(end))), DEFAULT)


def _smallest(nodes: list[Node], title: str, least: int) -> Node | None:
    """The one with the least text that is enough, with the title if any has it."""
    fit = [(len(t), k, n) for k, n in enumerate(dict.fromkeys(nodes)) if len(t := n.text()) >= least and (not title or title in t)]
    if not fit and title:
        return _smallest(nodes, "", least)
    return min(fit, default=(0, 0, None))[2]


def content_root(page: Node, title: str, policy: Policy) -> tuple[Node | None, str, bool]:
    """(element, how it was found, whether by guess) after what is no content went."""
    for node in page.select(policy.remove):
        node.remove()
    title = " ".join(title.split())
    for selector in policy.include:
        if found := _smallest(page.select([selector]), title, policy.least):
            return found, selector, False
    if policy.mode == "strict_selectors":
        return None, "", False
    holders = [n for n in [page, *page.walk()] if title and any(isinstance(c, str) and title in " ".join(c.split()) for c in n.children)]
    around = [a for n in holders for a in [n, *n.above()][:6] if a.name in ("article", "main", "section", "div")]
    if found := _smallest(around, title, policy.least):
        return found, "title-ancestor", True
    guess = page.select(["article", "main", "[role='main']", "section", "div"])

    def score(node: Node) -> int:
        linked = sum(len(a.text()) for a in node.walk() if a.name == "a")
        boiler = any(w in node.attrs.get("class", "").lower() for w in ("footer", "menu", "nav"))
        return len(node.text()) - 3 * linked - 1000 * boiler

    return max(guess, key=score, default=None), "heuristic", True


CONTENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("policy", T.StringType()), T.StructField("policy_hash", T.StringType()), T.StructField("selector", T.StringType()), T.StructField("guessed", T.BooleanType())])


def main_content(html: str | None, title: str | None, url: str | None) -> dict:
    """The content of one page and how it was found."""
    policy = policy_of(url)
    node, selector, guessed = content_root(parse(html), title or "", policy)
    text = node.text() if node else ""
    return {"text": text if len(text) >= policy.least else None, "policy": policy.name, "policy_hash": policy.digest(), "selector": selector, "guessed": guessed}


def _rows(*columns: pd.Series):
    return zip(*([v if isinstance(v, str) else None for v in c] for c in columns), strict=True)


@F.pandas_udf(CONTENT)
def content(html: pd.Series, title: pd.Series, url: pd.Series) -> pd.DataFrame:
    """:func:`main_content` over columns."""
    return pd.DataFrame([main_content(*r) for r in _rows(html, title, url)], columns=CONTENT.names)


content = content.asNondeterministic()  # so that a filter on its result doesn't compute it again


# Kinds of documents, pages that are rules themselves, and points.
SUFFIXES = (".pdf", ".docx", ".doc", ".odt")
RULE_PAGES = ("https://www.chtf.org.tw/project/693",)
FILE_POINTS = {".pdf": 10, ".odt": 7}
OTHER_FILE, WORD_POINTS, SCOPE_DEPTH = 5, 20, 5


def _is_rule_page(url: str) -> bool:
    parts = urlsplit(url)
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}{parts.path}".rstrip("/") in RULE_PAGES


def _is_document(url: str, label: str) -> bool:
    parts, named = urlsplit(url), any(w in label for w in DOCUMENT_LABELS)
    if _is_rule_page(url) or parts.path.lower().endswith(SUFFIXES):
        return True
    return named and (parts.hostname in SHARED_HOSTS or label.lower().rstrip("。．. ").endswith(SUFFIXES))


def _documents(root: Node | None, base: str) -> list[tuple[int, str, str, str]]:
    """(points, address, label, role) of every document that is linked below."""
    out: dict[str, tuple[int, str, str, str]] = {}
    for node in root.select(["a", "button", "[data-url]", "[data-href]", "[onclick]"]) if root else ():
        label = node.text()
        said = [v for k in ("href", "data-url", "data-href", "data-file") if (v := node.attrs.get(k, "").strip()) and not v.lower().startswith(("javascript:", "mailto:", "tel:"))]
        said += re.findall(r"['\"](https?://[^'\"]+|/[^'\"]+)['\"]", node.attrs.get("onclick", ""))
        for url in (urljoin(base, v.strip()) for v in dict.fromkeys(said)):
            if url in out or not _is_document(url, label):
                continue
            role = "rules" if _is_rule_page(url) else next((r for r, words in LINK_ROLES.items() if any(w in label for w in words)), "unrelated")
            path = urlsplit(url).path.lower()
            points = next((p for end, p in FILE_POINTS.items() if path.endswith(end)), OTHER_FILE)
            out[url] = (points + BONUS.get(role, 0) + WORD_POINTS * sum(w in label for w in LINK_ROLES["rules"]), url, label, role)
    return list(out.values())


INVENTORY = T.StructType([
    T.StructField("selected", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "label", "role")]))),
    T.StructField("discovered", T.IntegerType()), T.StructField("rules", T.IntegerType()), T.StructField("generic", T.IntegerType()),
])


def inventory_of(html: str | None, title: str | None, url: str | None, most: int = 3) -> dict:
    """The best ``most`` documents that a page's content links, or the nearest part
    around it that links any, and the counts of all."""
    base, page = url or "", parse(html)
    scope, _, _ = content_root(page, title or "", policy_of(base))
    found, root = [], scope
    for _ in range(SCOPE_DEPTH):
        if root is None or (found := _documents(root, base)):
            break
        above = root.parent
        root = above if above is not None and above.name not in ("", "body", "html") else None
    if not found and (urlsplit(base).hostname or "").endswith("lhu.edu.tw"):
        found = _documents(page, base)
    found.sort(key=lambda r: -r[0])
    count = lambda role: sum(r[3] == role for r in found)
    return {"selected": [{"url": u, "label": x, "role": r} for _, u, x, r in found[:most]], "discovered": len(found), "rules": count("rules"), "generic": count("generic_attachment")}


@F.pandas_udf(INVENTORY)
def inventory(html: pd.Series, title: pd.Series, url: pd.Series) -> pd.DataFrame:
    """:func:`inventory_of` over columns."""
    return pd.DataFrame([inventory_of(*r) for r in _rows(html, title, url)], columns=INVENTORY.names)


# How a text sends its readers to attachments.
REFERENCE = r"(?:詳見|請參閱|請參考|請見|如|依|下載).{0,10}(?:附件|附檔|檔案|文件)"
NEEDS = [
    ("eligibility_rules", rf"(?:申請資格|詳細資格|資格條件|申請條件|申請對象|申請辦法).{{0,30}}{REFERENCE}"),
    ("application_details", rf"(?:相關資訊|相關內容|詳細內容|詳情|申請方式|相關助學金項目及內容|各項資格).{{0,24}}{REFERENCE}"),
    ("unknown", r"(?:請參考附件|請參閱附件|詳見附件|內容請見附件|詳情請見附件|請下載附件|如附件所示|依附件規定)"),
]


def attachment_need(text: Column) -> Column:
    """A struct: whether the text needs its attachments, for what, and where it says so."""
    text = normalised(text)
    found = [F.regexp_extract(text, p, 0) for _, p in NEEDS]
    purpose, said = F.lit("unknown"), F.lit("")
    for (name, _), part in zip(reversed(NEEDS), reversed(found), strict=True):
        purpose, said = F.when(part != "", name).otherwise(purpose), F.when(part != "", part).otherwise(said)
    return F.struct((said != "").alias("required"), purpose.alias("purpose"), said.alias("evidence"))
