"""Token ids as flat unsigned integer files with 64-bit document offsets.

A range of ascending documents makes one shard: ``*.ids`` holds the ids of its
documents one after another (uint16 if the vocabulary fits, else uint32, little
endian), ``*.off`` the n + 1 offsets of its n documents as uint64, ``*.doc``
their ids as int64.  The place of a shard in the whole is the sum of the tokens
of those before it.  Readers map the files into memory (or read a range, where
the store can't be mapped), so a document costs its own bytes alone.

Defined results: a null text is empty and holds the end id alone; a null doc id
comes after all others and is read back as null (the id 2**63 - 1 stands for it
in a file, and is read back as null as well); rows that repeat a doc id are
written in order of their text's hash.  An empty table makes no files.  Other columns
are not used.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import filesystem, keep, new_path

SHARD_BYTES = 16 << 20  # text of a shard
NONE = np.iinfo(np.int64).max  # a null doc id in a .doc file


def in_ranges(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``id, t`` in ranges of ascending ids, sorted within each; nulls last.  Rows
    of one id are in order of their text's hash, so that they may fill many ranges;
    rows that are equal in both are spread by their place in the input."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    size = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / shard_bytes))
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("place")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order[:2], "t").select("id", "t")


CACHE = 700_000  # pieces whose ids a worker holds, some 200 bytes each
LONGEST = 64  # bytes of a piece that is held
WINDOW = 4 << 20  # bytes of text that are cut into pieces at a time
_JOINED = re.compile(rb" ?[^\x00-\x20\x7f\xc2\xe1-\xe3]+")
_DOUBTFUL = ["\x1c", "\x1d", "\x1e", "\x1f", "\u180e"]  # libraries differ on whether these are white space
# White space of more than one byte in UTF-8.
_WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_SPACE, _LETTER, _MARK = 1, 2, 4


def _kinds() -> np.ndarray:
    """For each byte: white space, a letter, or another sign of ASCII."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = _MARK
    kinds[list(range(65, 91)) + list(range(97, 123))] = _LETTER
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    return kinds


_KINDS = _kinds()


def edges(raw: np.ndarray) -> np.ndarray:
    """A flag for each byte of UTF-8 before which the text may be cut.

    The common byte-level pattern never joins a letter with a sign after it, nor
    anything but white space with white space after it; and a single line end
    between two words stands alone.  It looks ahead at white space alone, which
    such cuts leave whole, and never back.
    """
    kinds = _KINDS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # Latin letters of two bytes, less the two signs among them
    second = raw[lead + 1]
    kinds[lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)] + 1] = _LETTER
    for wide in _WIDE if np.isin(raw, (0xC2, 0xE1, 0xE2, 0xE3)).any() else ():
        at = np.flatnonzero(raw[: len(raw) - len(wide) + 1] == wide[0])
        for k, x in enumerate(wide[1:], 1):
            at = at[raw[at + k] == x]
        for k in range(len(wide)):
            kinds[at + k] = _SPACE
    space = kinds == _SPACE
    cut = np.zeros(len(raw), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | ((kinds[:-1] == _LETTER) & (kinds[1:] == _MARK))
    line = np.flatnonzero(raw[1:-1] == 10) + 1
    line = line[~space[line - 1] & ~space[line + 1]]
    cut[line + 1] = True
    return cut


class Encoder:
    """Ids of texts, with the ids of recurring pieces held.

    Texts are cut where the tokenizer's pattern always cuts (:func:`edges`), so a
    text's ids are those of its pieces one after another, and the library
    encodes each different piece once.  A text that holds the string of an added
    token, or a sign on which libraries differ, is one piece; so is every text
    if the tokenizer has another pattern.
    """

    def __init__(self, model, kind: np.dtype, by_piece: bool, added: list[str]):
        self.model, self.kind, self.by_piece, self.added = model, kind, by_piece, added
        line_end = model.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if by_piece and len(line_end) == 1 and "\n" not in "".join(added) else None
        self.forget()

    def forget(self) -> None:
        self.held: dict[bytes, int] = {}
        self.ids, self.start, self.size = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pieces = self.used = 0

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in found]

    def _put(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of some pieces to the table."""
        for name, need in (("ids", self.used + len(ids)), ("start", self.pieces + len(sizes)), ("size", self.pieces + len(sizes))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[self.pieces : self.pieces + len(sizes)] = sizes
        self.start[self.pieces : self.pieces + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.pieces += len(sizes)

    def _learn(self, new: list[bytes], joined: bool, size: int = 256) -> None:
        """Encode pieces: by the line, many at a time, if no piece has white space
        but one space before it; then a line end is a piece of its own, and no
        other piece has its id."""
        for k in range(0, len(new), 64 * size):
            part = new[k : k + 64 * size]
            if joined:
                found = self._encode([b"\n".join(part[g : g + size]) + b"\n" for g in range(0, len(part), size)])
                ids = np.concatenate(found)
                ends = np.flatnonzero(ids == self.line_end)
                self._put(np.delete(ids, ends), np.diff(np.r_[-1, ends]) - 1)
            else:
                found = self._encode(part)
                self._put(np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def _slots(self, pieces: list[bytes]) -> tuple[np.ndarray, tuple[int, int]]:
        """The table's rows of different pieces, and its extent without those that
        are too long to be held."""
        if len(self.held) + len(pieces) > CACHE:
            self.forget()
        slots = np.fromiter(map(self.held.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(slots < 0).tolist()
        plain, other, long = [], [], []
        for k in new:
            p = pieces[k]
            (long if len(p) > LONGEST else plain if self.line_end is not None and _JOINED.fullmatch(p) else other).append(k)
        for group, joined in ((plain, True), (other, False), (long, False)):
            if group is long:
                extent = self.pieces, self.used
            first = self.pieces
            self._learn([pieces[k] for k in group], joined)
            slots[group] = np.arange(first, first + len(group))
            if group is not long:
                self.held.update((pieces[k], first + j) for j, k in enumerate(group))
        return slots, extent

    def _window(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some bytes that are cut at ``starts``, and each piece's count."""
        ends = np.r_[starts, len(raw)].astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        found = column.dictionary_encode()
        slots, extent = self._slots(found.dictionary.to_pylist())
        slots = slots[found.indices.to_numpy()]
        sizes = self.size[slots]
        after = np.cumsum(sizes)
        total = int(after[-1])
        ids = self.ids[np.repeat(self.start[slots] - after + sizes, sizes) + np.arange(total)]
        self.pieces, self.used = extent
        return ids, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the count of each text."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        whole = np.ones(len(texts), bool)
        if self.by_piece:
            whole[:] = False
            seen = np.bincount(raw, minlength=256)
            for text in (x for x in _DOUBTFUL + self.added if all(seen[b] for b in x.encode())):
                whole |= pc.match_substring(texts, text).to_numpy(zero_copy_only=False)
        lo, ids, counts, places = 0, [], [], []
        while lo < len(raw):
            width = WINDOW
            while True:  # up to the last place to cut, which a longer window may need
                hi = min(len(raw), lo + width)
                cut = edges(raw[lo : min(len(raw), hi + 4)])[: hi - lo] if self.by_piece else np.zeros(hi - lo, bool)
                a, b = np.searchsorted(offsets, [lo, hi])
                for row in np.flatnonzero(whole[max(a - 1, 0) : b]) + max(a - 1, 0):
                    cut[max(offsets[row] - lo, 0) : max(offsets[row + 1] - lo, 0)] = False
                cut[offsets[a:b] - lo] = True
                cut[0] = True
                starts = np.flatnonzero(cut)
                if hi == len(raw) or len(starts) > 1:
                    break
                width *= 2
            if hi < len(raw):
                hi, starts = lo + int(starts[-1]), starts[:-1]
            found, sizes = self._window(raw[lo:hi], starts)
            ids.append(found)
            counts.append(sizes)
            places.append(starts + lo)
            lo = hi
        before = np.r_[0, np.cumsum(np.concatenate(counts))]
        rows = before[np.searchsorted(np.concatenate(places), offsets)]
        return np.concatenate(ids), np.diff(rows)


def cuts_at_spaces(tokenizer: str) -> bool:
    """Whether a tokenizer file is byte-level BPE with the common pattern, no
    normaliser and no space put before a text."""
    with open(tokenizer, encoding="utf-8") as f:
        rules = json.load(f)
    steps = rules.get("pre_tokenizer") or {}
    return rules["model"]["type"] == "BPE" and not rules.get("normalizer") and steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)


@functools.lru_cache(maxsize=1)
def encoder(tokenizer: str, end_id: int, plain: bool) -> Encoder:
    """The encoder of a worker, which its tasks share with the pieces they met."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = plain
    small = max(model.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16
    added = [x.content for x in model.get_added_tokens_decoder().values() if not (plain and x.special)]
    return Encoder(model, np.dtype("<u2" if small else "<u4"), cuts_at_spaces(tokenizer), added)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> DataFrame:
    """Encode every text with the tokenizer file and write the shards; returns
    the manifest ``part, file, docs, tokens`` of the shards whose task ended
    well, with the full name of each shard's files less the ending.

    The string of a special token in a text becomes that token, as in a plain
    call of the library; with ``plain`` it is ordinary text."""

    def run(batches):
        encode = encoder(tokenizer, end_id, plain)
        kind = encode.kind
        context, fs, path = TaskContext.get(), *filesystem(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        outs, docs_done, at = None, 0, 0
        for batch in batches:
            if outs is None:
                fs.create_dir(path, recursive=True)
                outs = [fs.open_output_stream(f"{path}/{name}.{x}", compression=None) for x in ("ids", "off", "doc")]
            found, lengths = encode(batch.column(1))
            n, ends = len(lengths), np.cumsum(lengths + 1)
            ids = np.full(len(found) + n, end_id, kind)
            ids[np.arange(len(found)) + np.repeat(np.arange(n), lengths)] = found
            outs[0].write(ids.tobytes())
            outs[1].write((at + ends - lengths - 1).astype("<u8").tobytes())
            outs[2].write(batch.column(0).fill_null(NONE).to_numpy().astype("<i8").tobytes())
            docs_done, at = docs_done + n, at + int(ends[-1])
        if outs is not None:
            outs[1].write(np.array([at], "<u8").tobytes())
            for out in outs:
                out.close()
            row = [context.partitionId(), f"{folder}/{name}", docs_done, at, kind.str]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "file", "docs", "tokens", "kind"])

    return in_ranges(docs, id_col, text_col).mapInArrow(run, "part long, file string, docs long, tokens long, kind string")


def _mapped(uri: str) -> pa.NativeFile:
    fs, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def bases(manifest: DataFrame, block: int = 4096) -> DataFrame:
    """The manifest with ``base``, the tokens of all shards before: prefix sums in
    blocks of shards, and over the blocks' sums."""
    rows = manifest.withColumn("block", F.floor(F.col("part") / block))
    prior = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("block").agg(F.sum("tokens").alias("sum"))
    sums = sums.select("block", F.coalesce(F.sum("sum").over(prior.orderBy("block")), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("tokens").over(prior.partitionBy("block").orderBy("part")), F.lit(0))
    return rows.withColumn("inside", inside).join(sums, "block").select(*manifest.columns, (F.col("above") + F.col("inside")).alias("base"))


def read(manifest: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` for each document in the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _mapped(row["file"] + ".off") as off, _mapped(row["file"] + ".doc") as doc, _mapped(row["file"] + ".ids") as ids:
                    kind = np.dtype(row["kind"])
                    for k in range(0, row["docs"], 4096):
                        n = min(4096, row["docs"] - k)
                        offsets = np.frombuffer(off.read_at((n + 1) * 8, k * 8), "<u8").astype(np.int64)
                        names = np.frombuffer(doc.read_at(n * 8, k * 8), "<i8")
                        sums = np.zeros(n, np.int64)
                        for j, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                            sums[j] = zlib.crc32(np.frombuffer(ids.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind).astype("<u4"))
                        yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == NONE), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(sums)], ["id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` under the shared folder and read the files back."""
    folder = new_path(docs.sparkSession, "tokens")
    manifest = bases(keep(write(docs, folder, tokenizer, end_id, id_col, text_col), "manifest"))
    return read(manifest.repartition(max(manifest.count(), 1))).withColumnRenamed("id", id_col)
