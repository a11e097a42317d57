"""Evidence of bounded length, and whether a text belongs to a title."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of evidence, and of a block of it at most; points of a
# clear marker, a weak one, and one that speaks against a block.
EVIDENCE_CHARS, BLOCK_CHARS = 8000, 700
CLEAR, WEAK, AGAINST = 8, 2, 5


def blocks(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """Paragraphs, or lines where there are fewer than three, cut at ``size``."""
    paragraphs = [p for p in map(str.strip, re.split(r"\n\s*\n", text)) if p]
    if len(paragraphs) < 3:
        paragraphs = [p for p in map(str.strip, text.split("\n")) if p]
    return [p[k : k + size] for p in paragraphs for k in range(0, len(p), size)]


def choose(lengths: Sequence[int], scores: Sequence[int], room: int) -> set[int]:
    """The first two blocks, then by falling score (ties: earlier) each block of a
    positive score with its neighbours, if all of them still fit with one
    character between blocks."""
    taken = set(range(min(2, len(lengths))))
    left = room + 1 - sum(lengths[k] + 1 for k in taken)
    for k in sorted((k for k, s in enumerate(scores) if s > 0), key=lambda k: (-scores[k], k)):
        new = {j for j in (k - 1, k, k + 1) if 0 <= j < len(lengths)} - taken
        cost = sum(lengths[j] + 1 for j in new)
        if cost <= left:
            taken |= new
            left -= cost
    return taken


def compact_text(text: str | None, strong: Sequence[str], weak: Sequence[str], against: Sequence[str], room: int) -> str:
    """The text, if it fits; else its best blocks in their order; without any
    marker its beginning.  Null gives an empty text."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    if len(text) <= room:
        return text
    parts = blocks(text)
    scores = []
    for p in parts:
        clear = sum(m in p for m in strong)
        scores.append(CLEAR * clear + WEAK * sum(m in p for m in weak) - (0 if clear else AGAINST * sum(m in p for m in against)))
    if max(scores, default=0) <= 0:
        return text[:room].rstrip()
    return "\n".join(parts[k] for k in sorted(choose([len(p) for p in parts], scores, room)))[:room].rstrip()


def compact(text: Column, strong: Sequence[str], weak: Sequence[str], against: Sequence[str], room: int = EVIDENCE_CHARS) -> Column:
    """:func:`compact_text` over Arrow batches; each text by itself."""

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: compact_text(t if isinstance(t, str) else None, strong, weak, against, room))

    return each(text)


def anchors(title: Column, n: int = 4) -> Column:
    """Distinct shingles of ``n`` characters of the title's letters and digits; a
    short title (at most 2n) is one anchor, an empty one has none."""
    bare = F.regexp_replace(F.lower(title), "[^a-z0-9\\u4e00-\\u9fff]+", "")
    many = F.array_distinct(F.regexp_extract_all(bare, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(bare == "", F.array().cast("array<string>")).when(F.length(bare) <= 2 * n, F.array(bare)).otherwise(many)


def shared_anchors(title: Column, body: Column, n: int = 4) -> Column:
    """How many anchors of a long title occur in the body, found by sets of
    shingles, so the work is linear in the body."""
    return F.size(F.array_intersect(anchors(title, n), anchors(body, n)))
