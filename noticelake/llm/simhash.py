"""Near-duplicate groups by SimHash, alone or checked by the likeness of shingle sets.

``fingerprints`` gives each text a 64-bit SimHash.  ``components`` links texts
whose fingerprints differ in at most ``max_bits`` bits and returns the connected
groups.  With least shingle hashes (``mins``), such links count only between
texts that share one of them and whose sets of shingles are alike, exactly, by at
least ``share``: by the cosine that SimHash estimates (shared shingles over the
geometric mean of the sizes; a Jaccard share of 0.8 is a cosine of 0.89 in sets
of one size), or by the Jaccard share.

Links are found by a self-join of binary tries: a node pair starts at (root,
root), its children are paired, the bits in which the two paths differ are added
up, and a pair over the error budget is dropped with all below it.  Node pairs
of a few fingerprints are compared at once.

To spread the work of fingerprints alone, the 64 bits are cut into ``max_bits + c``
blocks.  Two fingerprints within the budget agree on at least ``c`` blocks, so
one trie is built for every choice of ``c`` blocks and every value of them (a
shard).  ``c`` grows with the number of distinct fingerprints, so that a shard
has some thousands at most on average.  A shard with more than ``shard_limit``
fingerprints is dealt by the top levels of its trie: each pair of nodes within
the budget is a task, so copies are pruned like the walk itself; node pairs that
are still too large are dealt in pairs of chunks.  No pair is lost.

With ``mins``, a shard is the texts that share a least hash, one hash after the
other; its trie's pairs are the candidates.  In a shard one text is held against
all its candidates of like size at once, until all texts of it are linked or
were held against the rest; a shard over ``shard_limit`` texts or ``MASS``
shingles is dealt in chunk pairs.  Only texts that share a least hash have their
shingles written.

A shard returns a spanning forest of its links, so what is moved grows with the
texts and not with the square of a group.

Defined results: a null or blank text has fingerprint zero and is linked like
any other (with ``mins``, to those without words alone); equal rows have equal
results; a null id gets a fingerprint and its group, whose name is the smallest
id in it that is not null (null if none is).  Long texts are read in pieces.  An
empty table gives an empty result.  Other columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, keep

PIECE = 1 << 20  # bytes of a text that are split into words at a time
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ODD = np.random.default_rng(7).integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, n: int) -> Iterator[list[bytes]]:
    """The ``n``-word shingles of a text, repeats included, a piece at a time."""
    raw, at, before, full = raw.lower(), 0, [], False
    while at < len(raw):
        gap = SPACE.search(raw, min(len(raw), at + PIECE))
        end = gap.start() if gap else len(raw)
        words = before + raw[at:end].split()
        at = end
        if len(words) >= n:
            full = True
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: len(words) - n + 1].tolist()
            line = b" ".join(words)
            yield [line[a:b] for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)]
            words = words[len(words) - n + 1 :]
        before = words
    if not full and before:
        yield [b" ".join(before)]


def sketch(raw: bytes | None, n: int, mins: int = 0) -> tuple[int, list[int]]:
    """The fingerprint of a text, each of whose 64 bits is 1 if it is set in over
    half of the shingles' XXH64, and ``mins`` least values of scrambled hashes
    (none for a text without words)."""
    ones, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    least = np.full(mins, np.iinfo(np.uint64).max, np.uint64)
    for part in shingles(raw or b"", n):
        hashes = np.fromiter((digest(s, 42) for s in part), np.dtype(">u8"), len(part))
        for k in range(0, len(part), 1 << 14):
            block = hashes[k : k + (1 << 14)]
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            native = block.astype(np.uint64)
            for m in range(mins):
                mixed = (native ^ (native >> np.uint64(29 + m))) * ODD[m]
                least[m] = min(least[m], (mixed ^ (mixed >> np.uint64(32))).min())
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big"), least.view(np.int64).tolist() if total else []


def fingerprint(raw: bytes | None, n: int) -> int:
    """The fingerprint of one text."""
    return sketch(raw, n)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, mins: int = 0) -> DataFrame:
    """``id_col``, ``fp`` (the fingerprint as a signed 64-bit number) and the
    ``mins`` least shingle hashes, and ``node``, a digest of the text (0 for one
    without words)."""

    def run(batches):
        for batch in batches:
            found = [sketch(x.as_py(), n, mins) for x in batch.column(1).cast(pa.binary())]
            fps = np.fromiter((f for f, _ in found), np.uint64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array([m for _, m in found], pa.list_(pa.int64())), batch.column(2)], ["id", "fp", "mins", "node"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("node"))
    out = rows.mapInArrow(run, "id long, fp long, mins array<long>, node long").withColumnRenamed("id", id_col)
    return out.withColumn("node", F.when(F.size("mins") > 0, F.col("node")).otherwise(F.lit(0).cast("long"))) if mins else out.drop("node")


# ---------------------------------------------------------------- trie join


def close_pairs(keys: np.ndarray, groups: np.ndarray, budget: int, leaf: int = 4, width: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions i < j in one group whose keys differ in <= budget bits.

    ``keys`` are unsigned and ascending within each group; ``groups`` ascend.
    One trie for each group, all walked together: a frontier row is a pair of
    key ranges [a0, a1), [b0, b1) below two nodes of equal depth, with the
    number of differing bits on the way.  Small ranges are compared at once.
    """
    n = len(keys)
    if n < 2:
        return
    edge = np.flatnonzero(np.diff(groups)) + 1
    starts, ends = np.r_[0, edge], np.r_[edge, n]
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, dist = stack.pop()
        if len(a0) > width:
            half = len(a0) // 2
            stack.append((depth, a0[half:], a1[half:], b0[half:], b1[half:], dist[half:]))
            stack.append((depth, a0[:half], a1[:half], b0[:half], b1[:half], dist[:half]))
            continue
        small = ((a1 - a0) * (b1 - b0) <= leaf * leaf) | (depth == 64)
        if small.any():
            yield from _compare(keys, a0[small], a1[small], b0[small], b1[small], budget)
            rest = ~small
            a0, a1, b0, b1, dist = a0[rest], a1[rest], b0[rest], b1[rest], dist[rest]
        if not len(a0):
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        out = [(a0, am, b0, bm, dist), (am, a1, bm, b1, dist), (a0, am, bm, b1, dist + 1), (am[~same], a1[~same], b0[~same], bm[~same], dist[~same] + 1)]
        a0, a1, b0, b1, dist = (np.concatenate(x) for x in zip(*out, strict=True))
        ok = (a1 > a0) & (b1 > b0) & (dist <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        stack.append((depth + 1, a0[ok], a1[ok], b0[ok], b1[ok], dist[ok]))


def _compare(keys, a0, a1, b0, b1, budget, most: int = 1 << 21):
    """All pairs below node pairs, some two million at a time."""
    size = (a1 - a0) * (b1 - b0)
    cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1, len(size)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if lo == hi:
            continue
        width, m = (b1 - b0)[lo:hi], size[lo:hi]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        w = np.repeat(width, m)
        i, j = np.repeat(a0[lo:hi], m) + at // w, np.repeat(b0[lo:hi], m) + at % w
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        if near.any():
            yield i[near], j[near]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each pair the smaller label, until nothing changes."""
    while True:
        a, b = label[i], label[j]
        move = a != b
        if not move.any():
            return
        i, j, a, b = i[move], j[move], a[move], b[move]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _forest(groups: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest position's fingerprint linked to it) for each group."""
    keys = fps.view(np.uint64)
    order = np.lexsort((keys, groups))
    keys, groups = keys[order], groups[order]
    label = np.arange(len(keys))
    for i, j in close_pairs(keys, groups, budget):
        merge(label, i, j)
    moved = label != np.arange(len(label))
    return keys[moved].view(np.int64), keys[label[moved]].view(np.int64)


def blocks(distinct: int, budget: int, target: int = 4096) -> tuple[int, list[int]]:
    """How many blocks must agree, and a 64-bit mask for each choice of them."""
    for agree in range(1, 9):
        count = budget + agree
        if count > 64 or distinct / 2 ** (64 * agree / count) <= target:
            break
    count = min(count, 64)
    agree = count - budget
    edge = [64 * k // count for k in range(count + 1)]
    part = [((1 << edge[k + 1]) - (1 << edge[k])) for k in range(count)]
    return agree, [sum(part[k] for k in pick) for pick in combinations(range(count), agree)]


def prefixes(fps: np.ndarray, mask: int, levels: int) -> np.ndarray:
    """The first ``levels`` bits of fingerprints that are not in ``mask``: a node
    of their trie."""
    out, bit = np.zeros(len(fps), np.uint64), 64
    for _ in range(levels):
        bit -= 1
        while bit and mask >> bit & 1:
            bit -= 1
        out = (out << np.uint64(1)) | ((fps >> np.uint64(bit)) & np.uint64(1))
    return out.astype(np.int64)


def node_pairs(rows: DataFrame, masks: list[int], budget: int) -> DataFrame:
    """``fp, trie, key, low, high``: the fingerprints of large tries (``levels`` to
    split by) at each pair of nodes that they are part of."""

    def run(batches):
        for batch in batches:
            trie, levels = (batch.column(k).to_numpy() for k in (1, 3))
            for t, n in {*zip(trie.tolist(), levels.tolist(), strict=True)}:
                at = np.flatnonzero((trie == t) & (levels == n))
                own = prefixes(batch.column(0).to_numpy()[at].view(np.uint64), masks[t], n)
                for step in (sum(1 << b for b in pick) for k in range(min(budget, n) + 1) for pick in combinations(range(n), k)):
                    part = batch.take(pa.array(at)).select(["fp", "trie", "key"])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.minimum(own, own ^ step)), pa.array(np.maximum(own, own ^ step))], ["fp", "trie", "key", "low", "high"])

    return rows.select("fp", "trie", "key", "levels").mapInArrow(run, "fp long, trie int, key long, low long, high long")


def chunked(rows: DataFrame, limit: int) -> DataFrame:
    """``fp, shard`` with the rows of each shard over ``limit`` dealt in pairs of chunks."""
    sizes = rows.groupBy("shard").count().where(F.col("count") > limit)
    sizes = keep(sizes.select("shard", F.ceil(2 * F.col("count") / F.lit(limit)).cast("int").alias("chunks")), "chunks")
    rows = rows.join(sizes, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", "shard"), F.col("chunks")).cast("int"))
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))))
    rows = rows.withColumn("other", other)
    return rows.select("fp", F.when(F.col("chunks") == 1, F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).alias("shard"))


def links(marked: DataFrame, max_bits: int = 4, shard_limit: int = 8192) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``).

    They join exactly the pairs within ``max_bits`` bits: as a spanning forest of
    every shard, not as all pairs.
    """
    if not 0 <= max_bits < 64:
        raise ValueError("max_bits must be from 0 to 63")
    nodes = marked.select("fp").distinct()
    rows = nodes.count()
    _, masks = blocks(max(rows, 1), max_bits)
    rows *= len(masks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("trie", "mask"))
    keyed = keyed.select("fp", "trie", F.col("mask").bitwiseAND(F.col("fp")).alias("key"))
    sizes = keyed.groupBy("trie", "key").count().where("count > 1")
    levels = F.least(F.greatest(F.ceil(F.log2(F.col("count") / F.lit(shard_limit))), F.lit(0)), F.lit(20)).cast("int")
    # kept, so that the join has a shuffle of its own on this side and a hot shard's rows can be split
    sizes = keep(sizes.select("trie", "key", levels.alias("levels")), "shards")
    keyed = keyed.join(sizes, ["trie", "key"])
    dealt = keyed.where("levels = 0").select("fp", F.xxhash64("trie", "key").alias("shard"))
    if sizes.where("levels > 0").first() is not None:
        large = node_pairs(keyed.where("levels > 0"), masks, max_bits)
        large = keep(large.select("fp", F.xxhash64("trie", "key", "low", "high").alias("shard")), "large")
        dealt = dealt.union(chunked(large, 4 * shard_limit))

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(table):
            found = _forest(table.column("shard").to_numpy(), table.column("fp").to_numpy(), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:  # up to the last shard's start, whose rest may follow
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table.column("shard").to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))
                if cut:
                    yield solve(table.slice(0, cut))
                    held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    parts = max(dealt.sparkSession.sparkContext.defaultParallelism, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / 500_000))
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- exact links


def alike(sets: list[np.ndarray], share: tuple[int, int] = (4, 5), pairs: np.ndarray | None = None, cosine: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (of different values, none empty)
    whose Jaccard share (or cosine) is at least ``share``; of the candidates ``pairs`` alone (a
    symmetric matrix of flags), if given."""
    by_size = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    if pairs is not None:
        pairs = pairs[np.ix_(by_size, by_size)]
    sizes = np.array([len(sets[k]) for k in by_size], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    vocabulary, codes = np.unique(np.concatenate([sets[k] for k in by_size]), return_inverse=True)
    mark = np.zeros(len(vocabulary), np.int32)
    group, open_, active, out = np.arange(len(sets)), np.ones(len(sets), bool), np.ones(len(sets), bool), []
    up, down = (share[0] ** 2, share[1] ** 2) if cosine else share
    while True:
        living = np.flatnonzero(np.bincount(group[active], minlength=len(sets)))
        if len(living) < 2:
            return out
        left = np.bincount(group[active & open_], minlength=len(sets))[living]
        own = living[left.argmin()]  # a small group is done first, so that a large one is seldom gone through
        if not left.min():
            active[group == own] = False
            continue
        x = int(np.flatnonzero(open_ & (group == own))[0])
        open_[x] = False
        lo = int(np.searchsorted(sizes * down, sizes[x] * up))
        hi = int(np.searchsorted(sizes * up, sizes[x] * down, "right"))
        at = np.flatnonzero(active[lo:hi] & (group[lo:hi] != own) & (pairs is None or pairs[x, lo:hi])) + lo
        if not len(at):
            continue
        mine = codes[starts[x] : starts[x + 1]]
        mark[mine] = 1
        if 2 * len(at) < hi - lo:
            n = sizes[at]
            first = np.cumsum(n) - n
            shared = np.add.reduceat(mark[codes[np.repeat(starts[at] - first, n) + np.arange(n.sum())]], first)
        else:
            shared = np.add.reduceat(mark[codes[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo])[at - lo]
        mark[mine] = 0
        shared = shared.astype(np.int64)
        at = at[down * shared**2 >= up * sizes[at] * sizes[x] if cosine else down * shared >= up * (sizes[at] + sizes[x] - shared)]
        others, first = np.unique(group[at], return_index=True)
        ends = at[first]
        out += [(by_size[x], by_size[int(y)]) for y in ends]
        group[np.isin(group, others)] = own


#: Shingles of a chunk of a shard.
MASS = 1 << 22


def candidates(shards: np.ndarray, fps: np.ndarray, budget: int) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(first row, end, flags) of each shard whose trie has node pairs within the
    budget: ``flags`` says which of its rows are candidates of each other.  Rows
    of a shard stand together."""
    edge = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
    starts, sizes = edge[:-1], np.diff(edge)
    run = np.repeat(np.arange(len(starts)), sizes)
    order = np.lexsort((fps, run))
    few = (sizes <= 64)[run]

    def flags(lo, hi, i, j):
        out = np.zeros((hi - lo, hi - lo), bool)
        out[i - lo, j - lo] = out[j - lo, i - lo] = True
        return out

    some = order[few[order]]
    found = [(some[i], some[j]) for i, j in close_pairs(fps[some], run[some], budget)]
    if found:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(run[i], kind="stable")
        i, j = i[by], j[by]
        cut = np.r_[0, np.flatnonzero(np.diff(run[i])) + 1, len(i)].tolist()
        for a, b in zip(cut, cut[1:]):
            k = run[i[a]]
            yield int(starts[k]), int(starts[k] + sizes[k]), flags(starts[k], starts[k] + sizes[k], i[a:b], j[a:b])
    for k in np.flatnonzero(sizes > 64).tolist():
        lo, hi = int(starts[k]), int(starts[k] + sizes[k])
        mine, out = order[lo:hi], np.zeros((hi - lo, hi - lo), bool)
        for i, j in close_pairs(fps[mine], run[mine], budget):
            out[mine[i] - lo, mine[j] - lo] = out[mine[j] - lo, mine[i] - lo] = True
        yield lo, hi, out


def set_links(marked: DataFrame, texts: DataFrame, n: int, mins: int, max_bits: int, share: tuple[int, int] = (4, 5), cosine: bool = False, shard_limit: int = 4096) -> DataFrame:
    """Links ``a``, ``b`` between texts (``node``, ``fp`` and ``mins`` of ``marked``,
    ``node`` and ``t`` of ``texts``) that share one of their ``mins``, whose
    fingerprints are within ``max_bits`` and whose sets of ``n``-word shingles have a
    Jaccard share (or cosine) of at least ``share``: a spanning forest of every shard."""
    spark = marked.sparkSession
    keyed = marked.select("node", "fp", F.posexplode("mins").alias("trie", "key")).distinct()
    many = keep(keyed.groupBy("trie", "key").count().where("count > 1").select("trie", "key"), "many")
    hot = keep(keyed.join(many, ["trie", "key"]).groupBy("node", "fp").agg(F.collect_list(F.struct("trie", "key")).alias("keys")), "hot")

    def run(batches):
        for batch in batches:
            found = []
            for x in batch.column(2).cast(pa.binary()):
                hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for part in shingles(x.as_py(), n) for s in part), np.uint64))
                found.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([len(f) // 8 for f in found], pa.int64()), pa.array(found, pa.binary())], ["node", "fp", "keys", "size", "shingles"])

    wanted = texts.dropDuplicates(["node"]).join(hot, "node").select("node", "fp", "t", "keys")
    sets = keep(wanted.mapInArrow(run, "node long, fp long, keys array<struct<trie:int,key:long>>, size long, shingles binary"), "sets")
    mass = sets.agg(F.sum("size")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(mass / MASS))

    def solve_all(batches):
        def solve(table):
            ids, nodes, fps = (table.column(k).to_numpy() for k in range(3))
            held = table.column(3).combine_chunks()
            names, at = np.unique(nodes, return_inverse=True)
            label = np.arange(len(names))
            for lo, hi, flags in candidates(ids, fps.view(np.uint64), max_bits):
                rows = np.flatnonzero(flags.any(axis=1))  # the others have no candidate
                found = alike([np.frombuffer(held[lo + k].as_buffer(), np.uint64) for k in rows.tolist()], share, flags[np.ix_(rows, rows)], cosine)
                if found:
                    i, j = at[lo + rows[np.array(found)]].T
                    merge(label, i, j)
            moved = label != np.arange(len(label))  # stars, which take fewer rounds to connect than chains
            return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 1 << 26:  # up to the last shard's start, whose rest may follow
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table.column(0).to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))
                if cut:
                    yield solve(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    found = []
    for k in range(mins):  # one at a time, so that only one copy of the sets is moved
        mine = sets.select("node", "fp", "size", "shingles", F.explode(F.filter("keys", lambda x: x["trie"] == k)["key"]).alias("key"))
        sizes = mine.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / F.lit(shard_limit), F.sum("size") / F.lit(MASS))).cast("int").alias("chunks"))
        # chunks of large shards alone are looked up; a row of any other shard has one
        sizes = keep(sizes.where("chunks > 1"), "shards")
        dealt = mine.join(sizes, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int"))
        other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))))
        dealt = dealt.withColumn("other", other)
        shard = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select(shard.alias("shard"), "node", "fp", "shingles").repartition(parts, "shard").sortWithinPartitions("shard")
        found.append(keep(dealt.mapInArrow(solve_all, "a long, b long"), "links"))
    for old in (many, hot, sets):
        forget(old)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for each end of the links ``a``, ``b``: groups by their
    smallest node.

    Large star and small star take turns until nothing moves; every round is
    written to the shared folder.  A node's neighbours are never gathered: their
    smallest is an aggregate that is joined back.
    """

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = keep(edges, "edges")
    was = state(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "large")
        forget(least)
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = keep(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
        for old in (edges, large, least):
            forget(old)
        edges, now = small, state(small)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, max_bits: int = 24, mins: int = 8, share: tuple[int, int] = (4, 5), cosine: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (16 hex digits)
    and ``component_id``, the smallest id that links lead to, its own included.

    By default texts are linked whose sets of ``n``-word shingles have a Jaccard
    share (with ``cosine``, a cosine) of at least ``share``, taken exactly for those
    that have one of ``mins`` least shingle hashes in common and fingerprints within
    ``max_bits``.  Texts with a Jaccard share of 0.8 miss each other in the first
    with a probability of 0.2 to the power ``mins``, and with a cosine of 0.8 and one
    size of 0.33 to that power; they differ in 10 and in 13 bits on average, with
    a deviation of 3.  With ``mins`` of 0 the fingerprints alone decide.
    """
    marked = keep(fingerprints(docs, id_col, text_col, n, mins), "fingerprints").withColumnRenamed(id_col, "id")
    node = "node" if mins else "fp"
    nodes = keep(marked.groupBy(node).agg(F.min("id").alias("first")), "nodes")
    if mins:
        text = F.col(text_col).cast("string")
        found = set_links(marked, docs.select(F.xxhash64(text).alias("node"), text.alias("t")), n, mins, max_bits, share, cosine)
    else:
        found = links(nodes, max_bits)
    roots = connected(found).withColumnRenamed("node", node)
    named = nodes.join(roots, node, "left").withColumn("root", F.coalesce("root", node))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(named.join(least, "root").select(node, "component_id"), "named")
    out = marked.join(named, node)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
