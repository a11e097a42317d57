"""Exact top-k by inner product with MaxScore.

A vector component is a query term; its postings are the candidates of a shard
with their values.  A query's terms are split by score bounds: with its terms in
order of their weight, the non-essential ones are the longest tail whose whole
contribution, at most the tail's length times the longest candidate's, stays
below the k-th best score known.  The essential postings are traversed for all
candidates; a candidate stays competitive while its score so far and the bound
of what its other terms can add (which falls with its score so far, by the
inequality of Cauchy and Schwarz) reach the threshold, and only competitive ones
are probed for the other terms, a few terms at a time.  The threshold is seeded
with exact scores of a first block, the shard's longest candidates, and raised
with those of the best candidates after the essential terms.  A candidate is
dropped only if its bound is below the threshold, so results are exact, ties
included.

Queries and candidates meet in blocks of fixed sizes (``candidate_rows`` by
``query_rows``); a task holds one pair of blocks.  Each block gives at most k
rows for a query, which are merged by a ranking for each query.

Scores are integers of any size: where 53 bits might not hold a sum, vectors are
multiplied in whole numbers without a limit.  A score beyond 64 bits is ranked
by its value and shown as the nearest 64-bit number.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part; neither do rows with a null id or vectors whose length
isn't the most common one's in the table (the smaller length of equally common
ones).  Rows that repeat an id are candidates of their own, but none is a
candidate of a query with its id; a repeated query id with different vectors is
one query for each vector's best rows, ranked together.  Fewer than k
candidates give fewer rows, an empty table none.  Other columns are not used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED_ROWS = 1024
LARGEST = (1 << 63) - 1


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: the vectors that take part, their components as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.size("v") == (size["dims"] if size else 0))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as numbers without a limit."""
    out = np.empty(x.shape, object)
    out[...] = [[(n * scale) // d for n, d in map(float.as_integer_ratio, row)] for row in x.tolist()]
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Shard:
    """Candidates with integer components, in order of falling length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        squares = np.einsum("ij,ij->i", rows, rows, dtype=np.float64)
        order = np.argsort(-squares, kind="stable")
        self.ids, self.rows, self.squares = ids[order], rows[order], squares[order]
        self.postings = np.ascontiguousarray(self.rows.T)
        self.wide = self.postings.max(axis=1) - self.postings.min(axis=1) if len(ids) else None
        self.products = 0  # terms times candidates that were multiplied

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, step: int = 8):
        """Ids and scores of the k best candidates for each query in turn."""
        seed = self.rows[: max(SEED_ROWS, k)]
        for lo in range(0, len(queries), 256):
            part = queries[lo : lo + 256]
            self.products += part.size * len(seed)
            first = part @ seed.T
            for query, ident, known in zip(part, query_ids[lo : lo + 256].tolist(), first, strict=True):
                yield self._one(query, ident, known, k, step)

    def _one(self, query, ident, known, k, step):
        own = self.ids == ident  # however many rows the query's id has, none holds up the threshold
        known = known[~own[: len(known)]]
        floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
        order = np.argsort(-np.abs(query) * self.wide, kind="stable")
        tail = np.sqrt(np.r_[np.cumsum(query[order][::-1].astype(np.float64) ** 2)[::-1], 0])  # length of a query's last terms
        terms = int(np.argmax(tail * math.sqrt(self.squares[0]) < floor)) if floor > 0 else len(order)
        terms = min(max(terms, step), len(order))
        essential = order[:terms]
        scores = query[essential] @ self.postings[essential]
        self.products += terms * len(self.ids)
        scores[own] = -np.inf
        alive = np.flatnonzero(~own)
        if terms < len(order) and len(alive) > k:
            some = alive[np.argpartition(-scores[alive], min(4 * k, len(alive) - 1))[: 4 * k]]
            exact = self.rows[some] @ query
            self.products += len(some) * len(order)
            floor = max(floor, np.partition(exact, len(exact) - k)[len(exact) - k])
        scores = scores[alive]
        while terms < len(order):
            weight = float((query[order[:terms]].astype(np.float64) ** 2).sum())
            rest = self.squares[alive] - (scores.astype(np.float64) ** 2 / weight if weight else 0)
            bound = scores + tail[terms] * np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-3
            keep = bound >= floor
            alive, scores = alive[keep], scores[keep]
            part = order[terms : terms + step]
            scores = scores + self.rows[alive][:, part] @ query[part]
            self.products += len(part) * len(alive)
            terms += len(part)
        found = self.ids[alive]
        at = best(found, scores, k)
        return found[at], scores[at]


def _beyond(score: int) -> bytes:
    """Orders scores that are shown as the same 64-bit number."""
    more = score - max(-LARGEST - 1, min(LARGEST, score))
    size = (abs(more).bit_length() + 7) // 8
    if more < 0:
        return b"\x7f" + (0xFFFF - size).to_bytes(2, "big") + (256**size - 1 + more).to_bytes(size, "big")
    return b"\x80" + (size.to_bytes(2, "big") + more.to_bytes(size, "big") if more else b"")


def solve(ids: np.ndarray, x: np.ndarray, is_query: np.ndarray, k: int, scale: int) -> tuple[list, list, list, list]:
    """``query_id, vec_id, score, beyond`` of a pair of blocks."""
    dims = x.shape[1]
    with np.errstate(over="ignore"):
        reach = np.abs(x).max(axis=1) * scale + 1
    large = reach >= 2.0 ** ((53 - dims.bit_length()) // 2)
    out: tuple[list, list, list, list] = ([], [], [], [])

    def put(ident, found, scores):
        out[0].extend([ident] * len(found))
        out[1].extend(found)
        out[2].extend(max(-LARGEST - 1, min(LARGEST, s)) for s in scores)
        out[3].extend(map(_beyond, scores))

    small, there = ~large, ~is_query
    near = np.flatnonzero(there & small)
    most = [reach[m].max(initial=0) for m in (near, is_query & small)]
    kind = np.float32 if most[0] * most[1] * dims < 2.0**24 else np.float64
    shard = Shard(ids[near], np.floor(x[near] * scale).astype(kind)) if len(near) else None
    far = np.flatnonzero(there & large)
    far_rows = whole(x[far], scale) if len(far) else None
    asked = np.flatnonzero(is_query & small)
    answers = shard.search(np.floor(x[asked] * scale).astype(kind), ids[asked], k) if shard else iter(())
    for at in asked:
        found, scores = next(answers) if shard else ([], [])
        pairs = [(-int(s), int(i)) for s, i in zip(scores, found, strict=True)]
        if len(far):
            exact = far_rows @ whole(x[at : at + 1], scale)[0]
            pairs += [(-s, i) for s, i in zip(exact.tolist(), ids[far].tolist(), strict=True) if i != ids[at]]
            pairs = sorted(pairs)[:k]
        put(int(ids[at]), [i for _, i in pairs], [-s for s, _ in pairs])
    asked = np.flatnonzero(is_query & large)
    if len(asked) and there.any():
        every, names = whole(x[there], scale), ids[there].tolist()
        for at in asked:
            exact = (every @ whole(x[at : at + 1], scale)[0]).tolist()
            pairs = sorted((-s, i) for s, i in zip(exact, names, strict=True) if i != ids[at])[:k]
            put(int(ids[at]), [i for _, i in pairs], [-s for s, _ in pairs])
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, candidate_rows: int = 32_768, query_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` for tables ``id, v`` (see :func:`vectors`);
    a component counts as floor(scale * component)."""
    blocks = [max(1, math.ceil(t.count() / n)) for t, n in ((queries, query_rows), (candidates, candidate_rows))]

    def dealt(table, own, other, columns, kind):
        table = table.select("id", "v", F.monotonically_increasing_id().alias("place"))  # equal rows are spread too
        block = F.pmod(F.xxhash64("id", "v", "place"), F.lit(own)).cast("int")
        return table.select(F.lit(kind).alias("is_query"), "id", "v", block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other")).select("is_query", "id", "v", *columns)

    rows = dealt(queries, blocks[0], blocks[1], [F.col("own").alias("q"), F.col("other").alias("c")], True)
    rows = rows.union(dealt(candidates, blocks[1], blocks[0], [F.col("other").alias("q"), F.col("own").alias("c")], False))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks]).to_numpy()
        found = solve(ids, flat.reshape(len(ids), -1), table.column("is_query").to_numpy(), k, scale)
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["query_id", "vec_id", "score", "beyond"])

    found = rows.groupBy("q", "c").applyInArrow(lambda key, table: run(table), "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
