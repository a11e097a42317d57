"""What an announcement is: its row, category, program, identity and revision, and
the key that copies of it on other sites share.

Defined results: null texts count as empty ones.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logic import cascade
from ..functions.text import canonical_url, contains_any, content_hash, digest, iso_date, normalised, stable

# Title words of each category, in order of precedence.
CATEGORIES = [
    ("loan", ["就學貸款"]),
    ("scholarship", ["獎助學金", "獎學金", "獎助金", "獎勵學金"]),
    ("student_aid", ["助學金", "助學計畫", "扶助學生", "濟助"]),
    ("subsidy", ["補助", "減免", "津貼", "扶助"]),
]
PROGRAM_PREFIX = "tun-program-"
# What a relayed title begins with, and titles that name nothing.
BRACKETED = r"^[【〖\[][^】〗\]]{1,24}[】〗\]]\s*"
RELAYED = r"^(?:轉知|公告|重要資訊|最新消息|有關|函轉|教育部公告)+[：:－\-｜|\s]*"
GENERIC = ["獎學金", "助學金", "獎助學金", "獎學金公告", "助學金公告", "獎助學金公告", "申請公告"]


def category(title: Column) -> Column:
    """The first category one of whose words is in the title."""
    return cascade([(contains_any(normalised(title), words), name) for name, words in CATEGORIES], "other")


def program_id(source: Column, given: Column) -> Column:
    """The given program, or the one that a source's name says."""
    given, source = normalised(given), normalised(source)
    said = F.when(source.startswith(PROGRAM_PREFIX), F.substr(source, F.lit(len(PROGRAM_PREFIX) + 1))).otherwise("")
    return F.when(given != "", given).otherwise(said)


def announcement(source: Column, title: Column, published: Column, url: Column, program: Column | None = None, entry: Column | None = None, detail: Column | None = None, score: Column | None = None) -> Column:
    """A row from raw fields: normalised, with addresses, category, hash and program
    filled in."""
    empty = F.lit("")
    own = lambda c: F.when(normalised(c) != "", normalised(c)).otherwise(normalised(url)) if c is not None else normalised(url)
    return F.struct(
        normalised(source).alias("source"),
        normalised(title).alias("title"),
        iso_date(published).alias("published_date"),
        normalised(url).alias("source_url"),
        category(title).alias("category"),
        content_hash(source, title, published, url).alias("content_hash"),
        program_id(source, empty if program is None else program).alias("program_id"),
        own(entry).alias("entry_url"),
        own(detail).alias("detail_url"),
        F.greatest((F.lit(0) if score is None else score).cast("int"), F.lit(0)).alias("match_score"),
    )


def announcement_id(source: Column, program: Column, detail_url: Column, source_url: Column) -> Column:
    """A digest of the source and the program or else the canonical address."""
    program, detail = F.coalesce(program, F.lit("")), F.coalesce(detail_url, F.lit(""))
    address = canonical_url(F.when(detail != "", detail).otherwise(source_url))
    return digest(source, F.when(program != "", program).otherwise(address))


def revision_hash(ident: Column, page_url: Column, body: Column, attachments: Column, rules_status: Column, policy: Column, selector: Column) -> Column:
    """Changes with the page's stable text, the texts of its rule attachments, in
    any order, and how they were read.  ``attachments`` is an array of structs of
    ``status``, ``content_role`` and ``text``."""
    rules = F.filter(attachments, lambda a: (a["status"] == "success") & (a["content_role"] == "scholarship_rules") & (normalised(a["text"]) != ""))
    rules = F.sort_array(F.transform(rules, lambda a: stable(a["text"])))
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = F.concat(F.array(ident, canonical_url(page_url), stable(body)), rules, F.array(text(rules_status), text(policy), text(selector)))
    return F.sha2(F.array_join(parts, "\n---\n"), 256)


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility forms without case; Spark has no such function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def cross_source_key(title: Column, published: Column) -> Column:
    """What copies of an announcement have in common: the bare title, and for
    titles that name nothing the date."""
    bare = F.regexp_replace(F.regexp_replace(folded(normalised(title)), BRACKETED, ""), RELAYED, "")
    bare = F.regexp_replace(bare, r"(?U)[\W_]+", "")
    dated = F.concat(bare, F.lit("|"), F.trim(F.coalesce(published, F.lit(""))))
    return F.when(bare.isin(*GENERIC), dated).otherwise(bare)


def excerpt(text: Column, size: int = 160) -> Column:
    """The first characters of a text on one line."""
    return F.substring(normalised(text), 1, size)


def error_text(message: Column, kind: Column, size: int = 300) -> Column:
    """What to show of an error: its text, or its kind if it says nothing."""
    said = F.substring(normalised(message), 1, size)
    return F.when(said == "", kind).otherwise(said)
