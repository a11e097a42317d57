"""Substring dedup: words covered by a passage that occurs earlier too.

A window is ``length`` consecutive words of one document.  A word goes if it is
covered by a window whose word sequence also starts earlier: in a document with
a smaller id, or further ahead in the same one.

1. Every window has an anchor: of its sequences of ``GRAM`` words the one with
   the least hash (the leftmost of equal ones).  Consecutive windows with the
   same anchor occurrence make a segment.  Equal windows have equal anchors, so
   an anchor that occurs once ends its windows' search: they are unique.
2. The segments of the other anchors are cut from the texts.  Equal segments of
   an anchor are one entry with the place of the earliest (aggregated before
   the shuffle).
3. Entries are dealt to shards by anchor.  A shard builds a compressed FM-index
   of its entries (:mod:`.fmindex`) and streams them through it: backward
   search over its wavelet matrix gives the matching statistics of each position,
   and the interval of suffixes where the match reaches ``length`` words; of an
   interval's suffixes the one with the earliest place alone is kept.
4. A document's windows in segments of step 1 that are not kept are removed.

An anchor with more than ``hot`` different segments (the edges of a passage
that very many documents share) is dealt on by single windows, aggregated by
their words, so no shard meets a hot anchor's entries.

Defined results: a null or blank text has no words; fewer than ``length`` words
have no window.  A null id counts as the largest number.  Rows that repeat an id
are ordered by a hash of their text; rows equal in both are one document and
have the same result.  A text of any length is read in pieces of some two
megabytes, and a word of over ``LONGEST`` bytes is looked for by its digest.  An
empty table gives no rows.  Other columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .store import forget, free_names, keep

GRAM = 5
PIECE = 2 << 20  # bytes that are hashed at a time
LONGEST = 8 << 10  # bytes of a word that are hashed; a piece has many more words than a window
SHARD_WORDS = 1_000_000
LAST = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LONG = re.compile(rb"[^\x20\x09-\x0D]{%d,}+" % LONGEST)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BACK)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word in a buffer of bytes."""
    space = np.r_[True, _SPACE[buffer], True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(buffer) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_MIX[buffer] * up[: len(buffer)], dtype=np.uint64)]
    hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return starts, ends, _scramble(hashes)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of some two megabytes: the bytes, and for each text in them
    its number, its first byte and the words of it before.  A longer text comes
    in pieces that overlap by ``length - 1`` words."""
    held, size = [], 0
    for k, raw in enumerate(texts):
        if len(raw) >= LONGEST:
            raw = _LONG.sub(lambda m: hashlib.sha256(m[0]).hexdigest().encode(), raw)
        if len(raw) > PIECE:
            at, before = 0, 0
            while True:
                gap = _GAP.search(raw, min(len(raw), at + PIECE))
                end = gap.start() if gap else len(raw)
                part = raw[at:end]
                while end < len(raw) and len(part.split(None, length)) <= length:  # a piece holds a window and more
                    gap = _GAP.search(raw, min(len(raw), end + PIECE))
                    end = gap.start() if gap else len(raw)
                    part = raw[at:end]
                yield part, np.array([k]), np.array([0]), np.array([before])
                if end >= len(raw):
                    break
                starts = words_of(np.frombuffer(part, np.uint8))[0]
                back = min(length - 1, len(starts) - 1)
                if back <= 0:
                    at, before = end, before + len(starts)
                else:
                    at, before = at + int(starts[-back]), before + len(starts) - back
            continue
        if size + len(raw) > PIECE and held:
            yield _joined(held)
            held, size = [], 0
        held.append((k, raw))
        size += len(raw) + 1
    if held:
        yield _joined(held)


def _joined(held):
    sizes = np.array([len(r) + 1 for _, r in held])
    return b"\n".join(r for _, r in held), np.array([k for k, _ in held]), np.cumsum(sizes) - sizes, np.zeros(len(held), np.int64)


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, first word, windows and anchor of each segment."""
    span = length - GRAM + 1
    for raw, number, first, before in pieces(texts, length):
        starts, _, hashes = words_of(np.frombuffer(raw, np.uint8))
        if len(starts) < length:
            continue
        gram = np.zeros(len(hashes) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(_BASE) + hashes[k : len(hashes) - GRAM + 1 + k]
        gram = _scramble(gram)
        place = np.arange(len(gram), dtype=np.uint64)
        least = (gram & np.uint64(0xFFFFFFFFFF000000)) | (place & np.uint64(0xFFFFFF))  # PIECE is below 2^24 words
        width = 1
        while width < span:  # least of `span` neighbours by doubling
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        text = np.searchsorted(first, starts, side="right") - 1
        inside = text[: len(least)] == text[length - 1 :]
        window = np.flatnonzero(inside)
        if not len(window):
            continue
        spot = (least[window] & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((np.diff(spot) != 0) | (np.diff(window) != 1)) + 1
        head, tail = np.r_[0, cut], np.r_[cut, len(window)]
        begin, which = window[head], text[window[head]]
        first_word = np.searchsorted(starts, first)
        yield number[which], begin - first_word[which] + before[which], tail - head, gram[spot[head]].view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("t"))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def anchors(rows: DataFrame, length: int) -> DataFrame:
    """``doc, mark, start, windows, anchor`` of every segment."""

    def run(batches):
        for batch in batches:
            doc, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for number, start, windows, anchor in segments(batch.column(2).cast(pa.binary()).to_pylist(), length):
                yield _batch({"doc": doc[number], "mark": mark[number], "start": start.astype(np.int32), "windows": windows.astype(np.int32), "anchor": anchor})

    return rows.mapInArrow(run, "doc long, mark long, start int, windows int, anchor long")


def contents(found: DataFrame, length: int) -> DataFrame:
    """The words of the segments ``segs`` of each text, one space between them."""

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("anchor", "words", "doc", "mark", "start")}
            size = 0
            for doc, mark, text, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                words = text.as_py().split()
                flat = segs.values.flatten()
                starts, windows, anchor = (x.to_numpy(zero_copy_only=False) for x in flat)
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                from_, to = (np.r_[0, ends][starts]).tolist(), (ends[starts + windows + (length - 2)] - 1).tolist()
                parts = [line[a:b] for a, b in zip(from_, to, strict=True)]
                out["words"] += parts
                out["anchor"].append(anchor)
                out["start"].append(starts)
                out["doc"].append(np.full(len(parts), doc))
                out["mark"].append(np.full(len(parts), mark))
                size += sum(map(len, parts))
                if size > 8 << 20:
                    yield flush(out)
                    out, size = {n: [] for n in out}, 0
            if out["words"]:
                yield flush(out)

    def flush(out):
        return _batch({n: pa.array(x, pa.binary()) if n == "words" else np.concatenate(x) for n, x in out.items()})

    return found.mapInArrow(run, "anchor long, words binary, doc long, mark long, start int")


def windows_of(entries: DataFrame, length: int) -> DataFrame:
    """Entries cut into single windows, whose anchor is a hash of their words."""

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("words", "doc", "mark", "start")}
            for row in batch.to_pylist():
                words = row["words"].split(b" ")
                for k in range(len(words) - length + 1):
                    out["words"].append(b" ".join(words[k : k + length]))
                    out["doc"].append(row["doc"])
                    out["mark"].append(row["mark"])
                    out["start"].append(row["start"] + k)
            yield _batch({"words": pa.array(out["words"], pa.binary()), "doc": pa.array(out["doc"], pa.int64()), "mark": pa.array(out["mark"], pa.int64()), "start": pa.array(out["start"], pa.int32())})

    rows = entries.select("words", "doc", "mark", "start").mapInArrow(run, "words binary, doc long, mark long, start int")
    return rows.select(F.xxhash64("words").alias("anchor"), "words", "doc", "mark", "start")


def _earliest(rows: DataFrame) -> DataFrame:
    least = rows.groupBy("anchor", "words").agg(F.min(F.struct("doc", "mark", "start")).alias("at"))
    return least.select("anchor", "words", "at.doc", "at.mark", "at.start")


def search(entries: pa.Table, length: int) -> pa.RecordBatch:
    """Index the entries of a shard, stream them through it, and return for each
    entry the windows (a bit for each) that are the earliest of their class."""
    joined = b" \n ".join(x.as_py() for x in entries.column("words")) + b" \n "
    tokens = joined.split(b" ")[:-1]
    vocabulary: dict[bytes, int] = {b"\n": 0}
    text = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tokens), np.int64, len(tokens))
    del tokens, joined
    stops = np.flatnonzero(text == 0)
    starts = np.r_[0, stops[:-1] + 1]
    lengths = stops - starts
    index = FMIndex(text, length)
    low, high = index.matching(text, starts, lengths)
    owner = np.repeat(np.arange(len(starts)), lengths + 1)
    rank = np.empty(len(starts), np.int64)
    rank[np.lexsort([entries.column(n).to_numpy() for n in ("start", "mark", "doc")])] = np.arange(len(starts))
    when = rank[owner] * (int(lengths.max()) + 1) + np.arange(len(text)) - starts[owner]  # segments of a text share no window
    place = np.flatnonzero(high > low)
    least = np.minimum.reduceat(when[index.sa], index.start)  # of the suffixes of each interval
    earliest = place[when[place] == least[index.of[low[place]]]]
    bits = np.zeros(len(starts), np.int64)
    np.bitwise_or.at(bits, owner[earliest], np.left_shift(np.int64(1), earliest - starts[owner[earliest]]))
    some = bits != 0
    doc, mark, start = (entries.column(n).to_numpy()[some] for n in ("doc", "mark", "start"))
    return _batch({"doc": doc, "mark": mark, "start": start.astype(np.int32), "bits": bits[some]})


def kept_windows(entries: DataFrame, length: int, words: int) -> DataFrame:
    """``doc, mark, start, bits``: the windows of entries that stay."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("words").nbytes
            if size > 7 * SHARD_WORDS:  # a shard ends where an anchor does
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))
                if cut:
                    yield search(table.slice(0, cut), length)
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(b.column("words").nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield search(pa.Table.from_batches(held), length)

    spark = entries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / SHARD_WORDS / 2))
    dealt = entries.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc long, mark long, start int, bits long")


def removals(rows: DataFrame, length: int = 20, hot: int = 2000) -> DataFrame:
    """``doc, mark, segs``: for each text with repeated anchors its segments
    (``bits`` null) and the windows of them that stay."""
    if not GRAM < length <= GRAM + 62:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 62} words")
    found = anchors(rows, length)
    # kept, so that the join has a shuffle of its own on this side and a hot anchor's rows can be split
    repeated = keep(found.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated")
    segs = keep(found.join(repeated, "anchor"), "segments")
    by_text = segs.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "windows", "anchor")).alias("segs"))
    cut = rows.join(by_text, ["doc", "mark"]).select("doc", "mark", "t", "segs")
    entries = keep(_earliest(contents(cut, length)), "entries")
    crowded = entries.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowded = keep(crowded, "crowded")
    if crowded.first() is not None:
        calm = entries.join(crowded, "anchor", "left_anti")
        entries = keep(calm.union(_earliest(windows_of(entries.join(crowded, "anchor", "left_semi"), length))), "entries")
    total = entries.agg(F.sum(F.octet_length("words") / 6.5)).first()[0] or 0
    stay = keep(kept_windows(entries, length, int(total)), "kept")
    forget(entries)
    both = segs.select("doc", "mark", "start", "windows", F.lit(None).cast("long").alias("bits"))
    both = both.union(stay.select("doc", "mark", "start", F.lit(0).alias("windows"), "bits"))
    return both.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "windows", "bits")).alias("segs"))


def covered(n_words: int, segs, length: int) -> np.ndarray:
    """Which words of a text go."""
    start, windows, bits = (x.fill_null(0).to_numpy() for x in segs.flatten())
    repeated = np.zeros(n_words + 1, bool)
    seg = windows > 0
    if seg.any():
        a, m = start[seg], windows[seg]
        repeated[np.repeat(a, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)] = True
    for k in range(63):
        on = (~seg) & ((bits >> k) & 1 == 1)
        if on.any():
            repeated[start[on] + k] = False
    out = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(out, at, 1)
    np.add.at(out, np.minimum(at + length, n_words), -1)
    return np.cumsum(out)[:n_words] > 0


PIECES = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")


def dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, hot: int = 2000) -> DataFrame:
    """``docs`` with ``text_col`` less the covered words (each with the white
    space after it), or with ``digest`` rows ``id_col, n_words, n_removed,
    kept_sha256`` (of the kept words joined by one space) instead."""
    rows = _keyed(docs, id_col, text_col)
    doc, mark, gone_in = free_names(docs, "doc", "mark", "segs")
    lost = removals(rows, length, hot).withColumnsRenamed({"doc": doc, "mark": mark, "segs": gone_in})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))), mark: F.xxhash64(text)})
    joined = named.join(lost, [doc, mark], "left").drop(doc, mark)

    def marks(raw: bytes, segs) -> tuple[list[bytes], np.ndarray | None]:
        words = raw.split()
        return words, covered(len(words), segs.values, length) if segs.is_valid else None

    def digests(batches):
        for batch in batches:
            out = [[], [], []]
            for raw, segs in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words, gone = marks(raw.as_py() or b"", segs)
                kept = words if gone is None else list(compress(words, (~gone).tolist()))
                for held, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    if digest:
        out = joined.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), gone_in)
        return out.mapInArrow(digests, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)

    names = docs.columns
    place = names.index(text_col)

    def texts(batches):
        for batch in batches:
            new = []
            for raw, segs in zip(batch.column(place).cast(pa.binary()), batch.column(len(names)), strict=True):
                raw = raw.as_py()
                if raw is not None and segs.is_valid:
                    words, gone = marks(raw, segs)
                    if gone.any():
                        parts = PIECES.findall(raw)
                        lead = parts[:1] if len(parts) > len(words) else []
                        raw = b"".join(lead + list(compress(parts[len(lead) :], (~gone).tolist())))
                new.append(raw)
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in names]).schema
    return joined.select(*names, gone_in).mapInArrow(texts, schema)
