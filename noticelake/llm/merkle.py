"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is tiled by paragraphs (lines, with their ends), and each of them by
leaves (up to 40 bytes, then to the end of the word, or less if a sentence ends
before).  A blank line ends a section; so does a paragraph whose digest falls
into one of four classes, so long texts without blank lines have sections too,
at places that follow from the content alone.  A leaf's digest is of its bytes,
an inner node's of its children's digests; the root of equal texts is equal,
and that of different texts differs but for a collision of 128-bit digests.

The fingerprint is the root in hex, ``|``, and the sections joined by ``;``:
8 hex digits of the section's digest, ``:``, and its paragraphs joined by
``,``: 6 hex digits for each leaf.  ``likeness`` is the share of equal leaves
(twice the common ones over all, repeats counted), 1 only if the roots are
equal.  ``differences`` walks two whole trees down the branches whose digests
differ, lines up their children, and gives the places of both texts that have
no equal leaf in the other: without them the texts are the same.

Defined results: a null text is an empty one, which has a root and no section;
two empty texts are alike (1).  A null id comes after all others; rows that
repeat an id are in order of their text's hash.  The one row of a table is its own
next.  An empty table gives no rows.  Other columns are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flatfile import in_ranges
from .store import keep

LEAF = re.compile(rb"[^.!?]{1,40}[^.!?\x20\x09-\x0D]{0,64}[.!?]{0,8}[\x20\x09-\x0D]{0,8}|[.!?]{1,8}[\x20\x09-\x0D]{0,8}")


def _node(children: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16).digest()


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    raw, sections, paragraphs, shown = (text or "").encode("utf-8", "surrogatepass"), [], [], []
    digests, leaf_digest = [], xxhash.xxh3_128_digest

    def close():
        node = _node(paragraphs)
        digests.append(node)
        sections.append(f"{node[:4].hex()}:{','.join(shown)}")
        paragraphs.clear()
        shown.clear()

    for line in raw.splitlines(True):
        leaves = [leaf_digest(x) for x in LEAF.findall(line)]
        node = _node(leaves)
        paragraphs.append(node)
        shown.append("".join([x[:3].hex() for x in leaves]))
        if node[0] < 64 or not line.strip():
            close()
    if paragraphs:
        close()
    return f"{_node(digests).hex()}|{';'.join(sections)}"


def leaves(mark: str) -> Counter[str]:
    """The leaves of a fingerprint with their number."""
    found: Counter[str] = Counter()
    for section in filter(None, mark.partition("|")[2].split(";")):
        for line in section[9:].split(","):
            found.update([line[k : k + 6] for k in range(0, len(line), 6)])
    return found


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 if and only if the roots are equal."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    one, two = leaves(a), leaves(b)
    total = one.total() + two.total()
    return min(2 * (one & two).total(), total - 1) / total


class Branch(NamedTuple):
    """A node of a tree: its digest, its bytes in the text, and what is below."""

    digest: bytes
    start: int
    end: int
    below: list[Branch]


def tree(text: str | None) -> Branch:
    """The whole tree of a text, with undivided digests.  Levels are the text, its
    sections, their paragraphs and their leaves."""
    raw, at, sections, paragraphs = (text or "").encode("utf-8", "surrogatepass"), 0, [], []

    def close():
        sections.append(Branch(_node([p.digest for p in paragraphs]), paragraphs[0].start, paragraphs[-1].end, paragraphs.copy()))
        paragraphs.clear()

    for line in raw.splitlines(True):
        leaves_ = [Branch(xxhash.xxh3_128_digest(m[0]), at + m.start(), at + m.end(), []) for m in LEAF.finditer(line)]
        paragraphs.append(Branch(_node([x.digest for x in leaves_]), at, at + len(line), leaves_))
        at += len(line)
        if paragraphs[-1].digest[0] < 64 or not line.strip():
            close()
    if paragraphs:
        close()
    return Branch(_node([x.digest for x in sections]), 0, len(raw), sections)


def differences(a: Branch, b: Branch) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The (start, end) bytes of each text in branches that the other lacks at that
    place; none if and only if the roots are equal.  Equal branches aren't entered."""
    if a.digest == b.digest:
        return [], []
    if not a.below or not b.below:
        return [(a.start, a.end)] if a.end > a.start else [], [(b.start, b.end)] if b.end > b.start else []
    mine, theirs = [], []
    match = SequenceMatcher(None, [x.digest for x in a.below], [x.digest for x in b.below], autojunk=False)
    for kind, i, j, k, m in match.get_opcodes():
        if kind == "equal":
            continue
        both = min(j - i, m - k)
        for one, two in zip(a.below[i : i + both], b.below[k : k + both], strict=True):
            found = differences(one, two)
            mine += found[0]
            theirs += found[1]
        mine += [(x.start, x.end) for x in a.below[i + both : j]]
        theirs += [(x.start, x.end) for x in b.below[k + both : m]]
    return mine, theirs


NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
DDL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(ident, text: str, mark: str, following: str, next_mark: str) -> list:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    raw = edited.encode("utf-8", "surrogatepass")
    other = mark if edited == text else fingerprint(edited)
    return [ident, len(text), hashlib.sha256(raw).hexdigest(), mark, other, likeness(mark, other), likeness(mark, next_mark)]


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half is
    replaced by the start of the next document in order of ids.

    The texts are moved once, into ranges of ids, and each range is streamed
    with a look ahead of one row.  Only the first and last text of a range are
    kept for a second step over the range borders.
    """

    def run(batches):
        part, prior, out = TaskContext.get().partitionId(), None, []
        schema = pa.schema(list(zip([*NAMES, "part", "edge", "text"], [*TYPES, pa.int32(), pa.string(), pa.string()], strict=True)))
        blank = [None] * len(NAMES)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                mark = fingerprint(text)
                if prior is None:
                    out.append([*blank, part, "first", text])
                else:
                    out.append([*_row(*prior, text, mark), part, None, None])
                prior = (ident, text, mark)
                if len(out) >= 512:
                    yield batch_of(out)
                    out = []
        if prior:
            out.append([prior[0], *blank[1:], part, "last", prior[1]])
            yield batch_of(out)

    rows = keep(in_ranges(docs, id_col, text_col).mapInArrow(run, f"{DDL}, part int, edge string, text string"), "edits")
    firsts = rows.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = rows.where("edge = 'last'").select("part", "id", "text")
    numbers = lasts.select("part")  # one for each range, some 16 MB of text
    first = F.min("part").over(Window.partitionBy())
    order = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), first).alias("next"))

    def borders(batches):
        for batch in batches:
            out = []
            for ident, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out.append(_row(ident, text, fingerprint(text), following, fingerprint(following)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    ends = lasts.join(order, "part").join(firsts, "next").select("id", "text", "following").mapInArrow(borders, DDL)
    return rows.where("edge IS NULL").select(*NAMES).union(ends).withColumnRenamed("id", id_col)
