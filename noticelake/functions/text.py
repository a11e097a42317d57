"""Text, hash and URL expressions; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that don't identify an announcement.
IGNORED_QUERY_KEYS = ("fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
# Counters and footers whose change is no revision.
VOLATILE = (r"瀏覽(?:人次|次數)?\s*[:：]?\s*\d+", r"最後更新\s*[:：]?\s*\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")


def normalised(text: Column) -> Column:
    """White space of any script becomes one space; none at the ends."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.regexp_replace(spaced, "^ | $", "")


def stable(text: Column) -> Column:
    """Normalised text without volatile parts."""
    return normalised(reduce(lambda t, p: F.regexp_replace(t, p, ""), VOLATILE, normalised(text)))


def iso_date(text: Column) -> Column:
    """``yyyy-MM-dd`` if the text is a date, else the text itself."""
    value = normalised(text)
    return F.coalesce(F.date_format(F.try_to_timestamp(value, F.lit("yyyy-M-d")), "yyyy-MM-dd"), value)


def digest(*parts: Column, by: str = "|") -> Column:
    """SHA-256 in hex of the joined parts."""
    return F.sha2(F.concat_ws(by, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def content_hash(source: Column, title: Column, published: Column, url: Column) -> Column:
    return digest(normalised(source), normalised(title), iso_date(published), normalised(url))


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers], F.lit(False))


def hits(text: Column, markers: Sequence[str]) -> Column:
    """The markers that occur, in the order given."""
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def sentences(text: Column) -> Column:
    """Sentences by CJK and Latin ends, without blank ones."""
    parts = F.split(text, r"[。；;\n]|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))


def _decoded(part: Column) -> Column:
    spaced = F.replace(part, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(part), spaced)


def _encoded(part: Column) -> Column:
    """As forms are encoded: letters, digits and ``_.-~`` stay, a space is a plus."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in small letters, no fragment, no tracking keys, the other
    keys and values decoded, sorted and encoded anew, no doubled or final
    slashes.  An address without a scheme or host keeps what it has."""
    url = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    site = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*IGNORED_QUERY_KEYS)))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        F.when(site != "", F.concat(F.lit("//"), site, F.when(path.startswith("/"), "").otherwise("/"))).otherwise(""),
        path,
        F.when(shown == "", "").otherwise(F.concat(F.lit("?"), shown)),
    )
