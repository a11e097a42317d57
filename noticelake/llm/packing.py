"""Conflict-constrained best-fit packing of documents into sequences.

Documents are dealt to shards by a hash of id, size, cluster and place in the
input (so neither a hot source or cluster nor equal rows meet), and each shard is packed alone, by
falling size.  Open bins are ordered by residual.  A document goes to the bin
with the smallest residual that holds it and conflicts with nothing in it: a
bin carries a bitmap of the sources and one of the duplicate clusters it has,
and the successor search goes on to the next larger residual until a compatible
bin is found; if there is none, a bin is opened.  Counters for each source and
each large cluster tell the search at which residuals a compatible bin can be.

A document of more than ``capacity`` tokens is cut into pieces of ``capacity``,
which fill bins of their own; the rest is packed like a document.  No token is
dropped.

Defined results: every row gets at least one piece; with ``end_tokens`` (1) for
each document's end an empty or null text has that size.  A null source is a
source of its own, and a null cluster never conflicts.  Rows that repeat an id
are packed as documents of their own, and equal ones may be numbered either
way.  An empty table gives no rows.  Only the columns named are used.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 20_000
MANY = 32  # members from which a cluster has counters of its own


class Packer:
    """Best fit with conflicts over the bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.total = np.zeros(capacity + 1, np.int32)
        self.having: dict[object, np.ndarray] = {}
        self.at: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.labels: list[tuple] = []

    def _put(self, b: int, sign: int) -> None:
        r = self.residual[b]
        key = (self.sources[b], self.clusters[b])
        if sign > 0:
            self.at[r].setdefault(key, []).append(b)
        else:
            held = self.at[r][key]
            held.remove(b) if held[-1] != b else held.pop()
            if not held:
                del self.at[r][key]
        self.total[r] += sign
        for label in self.labels[b]:
            self.having.setdefault(label, np.zeros(self.capacity + 1, np.int32))[r] += sign

    def place(self, size: int, source: int, cluster: int, labels: tuple) -> int:
        """The bin for a document; ``source`` and ``cluster`` are bits (0: none)."""
        free = self.total[size:] > 0
        for label in labels:
            if label in self.having:
                free &= self.total[size:] > self.having[label][size:]
        for r in np.flatnonzero(free).tolist():
            for key, held in self.at[size + r].items():
                if not (key[0] & source or key[1] & cluster):
                    b = held[-1]
                    self._put(b, -1)
                    break
            else:
                continue
            break
        else:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            self.labels.append(())
        self.residual[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.labels[b] += labels
        self._put(b, 1)
        return b


def pack_shard(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins for the documents ``id, size, source, cluster`` of one shard."""
    frame = frame.sort_values(["size", "id", "cluster", "source"], ascending=[False, True, True, True], na_position="last", kind="stable")
    source = pd.factorize(frame["source"], use_na_sentinel=False)[0]
    cluster, names = pd.factorize(frame["cluster"])
    count = np.bincount(cluster[cluster >= 0], minlength=len(names))
    bit = np.cumsum(count > 1) - 1
    size = frame["size"].to_numpy()
    packer, out = Packer(capacity), []
    rest = np.where(size % capacity == 0, capacity, size % capacity)
    order = np.lexsort((np.arange(len(size)), -rest))
    for k in order.tolist():
        c = cluster[k]
        cbit = 1 << int(bit[c]) if c >= 0 and count[c] > 1 else 0
        labels = (("s", int(source[k])),) + ((("c", int(c)),) if cbit and count[c] >= MANY else ())
        out.append((k, int(size[k] - rest[k]), int(rest[k]), packer.place(int(rest[k]), 1 << int(source[k]), cbit, labels)))
    bins = len(packer.residual)
    for k in np.flatnonzero(size > capacity).tolist():
        for start in range(0, int(size[k] - rest[k]), capacity):
            out.append((k, start, capacity, bins))
            bins += 1
    table = pd.DataFrame(out, columns=["row", "start", "n_tokens", "bin"]).sort_values(["bin", "row"], kind="stable")
    table["doc_id"] = frame["id"].to_numpy()[table["row"]]
    table["piece"] = (table["start"] // capacity).astype(np.int32)
    table["bin_offset"] = table.groupby("bin")["n_tokens"].cumsum() - table["n_tokens"]
    return table[["bin", "bin_offset", "doc_id", "piece", "start", "n_tokens"]]


SCHEMA = "shard int, bin long, bin_offset long, doc_id long, piece int, start long, n_tokens long"


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = 2048, end_tokens: int = 1, id_col: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``bin_id`` (unique over all shards), ``bin_offset``, ``doc_id``, ``piece``,
    ``start`` in the document and ``n_tokens`` of every piece."""
    if capacity < 1 or end_tokens < 0:
        raise ValueError("capacity must be positive and end_tokens not negative")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(size, F.lit(0)) + end_tokens, F.lit(1)).cast("long").alias("size"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    shards = max(1, math.ceil(docs.count() / shard_rows))
    rows = rows.withColumn("place", F.monotonically_increasing_id())  # spreads equal rows
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "size", "cluster", "place"), F.lit(shards)).cast("int")).drop("place")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(frame.astype({"id": "Int64", "cluster": "Int64"}), capacity)
        out.insert(0, "shard", frame["shard"].iloc[0])
        return out

    packed = rows.groupBy("shard").applyInPandas(run, SCHEMA)
    bin_id = F.shiftleft(F.col("shard").cast("long"), 32) + F.col("bin")
    return packed.select(bin_id.alias("bin_id"), "bin_offset", "doc_id", "piece", "start", "n_tokens")
