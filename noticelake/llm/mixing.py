"""Mixing sources to target weights by hierarchical budgeting, in DataFrame
operations alone.

A document is a leaf of a tree: domain, language, source.  The token budget is
shared out from the root.  Among siblings it goes by weight, but none gets more
than its documents hold (tokens below it times ``max_epochs``); what one can't
use is shared among its siblings by weight, and only if all of them are full
does it come back to the level above, where the same holds.  This is the water
level of the siblings, found with running sums over capacity / weight.

A leaf takes whole epochs while its budget lasts and then a prefix of one more,
whose order is that of ``md5(seed:epoch:id)``: documents are taken as long as
the tokens before them are fewer than the budget left, so the last one may
exceed it.  The prefix's end is found by radix selection: token sums over the
first three hex digits, then over the next three in the one bucket where the
budget ends, then over the documents of that bucket.  So no leaf, however
large, is sorted or met in one task.

Defined results: a null or blank text has no tokens, and such documents are
taken where their turn comes before the budget's end; null tree columns count
as empty strings; a null id is ordered by the empty string; rows that repeat an
id have one place in the order and are taken together.  A weight of zero, or of
a name not listed where others are (and no ``*``), keeps a branch out.  Budgets are rounded
down to tokens at every node.  An empty table gives no rows.  Columns that are
not used are passed through, whatever their names.  A text of any length is
counted whole, in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import free_names, keep

WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(name: str, given: Mapping[str, int] | None) -> Column:
    if not given:
        return F.lit(1).cast("long")
    pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
    return F.coalesce(F.create_map(*pairs)[F.col(name)], F.lit(given.get("*", 0)).cast("long"))


def share(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``children`` (``parent``, ``name``, ``w``, ``cap``, ``budget`` of the
    parent) with ``alloc``: the water level of each family."""
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    rising = family.orderBy((F.col("cap") / F.col("w")), name).rowsBetween(W.unboundedPreceding, -1)
    rows = children.where("w > 0")
    rows = rows.withColumns({"before": F.coalesce(F.sum("cap").over(rising), F.lit(0)), "wide": F.sum("w").over(family) - F.coalesce(F.sum("w").over(rising), F.lit(0))})
    full = F.expr("cast(cap as decimal(38,0)) * wide <= cast(budget - before as decimal(38,0)) * w")
    rows = rows.withColumn("full", full)
    rows = rows.withColumns({"left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family), "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family)})
    part = F.expr("cast((cast(left as decimal(38,0)) * w) div open as long)")
    return rows.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("before", "wide", "full", "left", "open", "budget")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (``levels``, ``tokens``) with ``alloc``, the budget of each."""
    rows = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for level in levels:
        rows = rows.withColumn(f"w_{level}", _weight(level, weights.get(level)))
    rows = rows.where(" AND ".join(f"w_{x} > 0" for x in levels))
    found = None
    for depth, level in enumerate(levels):
        parent = list(levels[:depth])
        nodes = rows.groupBy(*parent, level).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("w"))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if found is None else nodes.join(found, parent)
        found = share(nodes, parent, level).withColumnRenamed("alloc", "budget").select(*parent, level, "budget")
    return leaves.join(found.withColumnRenamed("budget", "alloc"), list(levels))


def _cut(rows: DataFrame, levels: Sequence[str], key: str) -> DataFrame:
    """For each leaf the ``key`` at which ``need`` tokens are reached, and the
    tokens still needed there; none where all of them are fewer."""
    sums = rows.groupBy(*levels, key).agg(F.sum("n_tokens").alias("s"), F.first("need").alias("need"))
    upto = F.sum("s").over(W.partitionBy(*levels).orderBy(key))
    return sums.withColumn("upto", upto).where("upto >= need AND upto - s < need").select(*levels, F.col(key).alias("at"), (F.col("need") - F.col("upto") + F.col("s")).alias("need"))


def order_key(seed: str, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


def plan(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share_of_tokens: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each leaf: ``tokens``, ``alloc``, ``epochs`` (whole ones) and
    ``last_key``, the greatest order key that is taken of the next epoch (null:
    none).  The budget is the fraction ``share_of_tokens`` of all tokens."""
    names = list(levels)
    rows = docs.select(F.col(id_col).alias("id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()], n_tokens(F.col(text_col)).alias("n_tokens"))
    rows = keep(rows, "lengths")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = total * share_of_tokens[0] // share_of_tokens[1]
    leaves = budgets(leaves, names, weights, budget, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(0).cast("int")
    leaves = keep(leaves.withColumn("epochs", epochs).withColumn("need", F.expr("alloc - epochs * tokens")), "leaves")
    partial = rows.join(leaves.where("need > 0").select(*names, "need", "epochs"), names)
    partial = partial.withColumn("k", order_key(seed, F.col("epochs") + 1, F.col("id")))
    partial = partial.select(*names, "n_tokens", "need", "k", F.substring("k", 1, 3).alias("k1"), F.substring("k", 4, 3).alias("k2"))
    for key in ("k1", "k2"):
        cut = _cut(partial, names, key)
        partial = partial.drop("need").join(cut, names).where(F.col(key) == F.col("at")).drop("at")
    last = _cut(partial, names, "k").select(*names, F.col("at").alias("last_key"))
    return keep(leaves.join(last, names, "left").select(*names, "tokens", "alloc", "epochs", "last_key"), "mix")


def select(docs: DataFrame, levels: Mapping[str, Column], mix: DataFrame, seed: str = "0", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``mix`` (from :func:`plan`) takes, once for each
    epoch, with the columns of ``levels`` as ``mix_<name>`` and ``epoch``, each with
    underscores before it if ``docs`` has such a column."""
    *names, whole, last, times, epoch = free_names(docs, *[f"mix_{n}" for n in levels], "mix_epochs", "mix_last", "mix_times", "epoch")
    named = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels.values(), strict=True)})
    few = mix.select(*[F.col(n).alias(m) for n, m in zip(levels, names, strict=True)], F.col("epochs").alias(whole), F.col("last_key").alias(last))
    rows = named.join(few, names)
    more = F.coalesce(order_key(seed, F.col(whole) + 1, F.col(id_col)) <= F.col(last), F.lit(False))
    rows = rows.withColumn(times, F.col(whole) + more.cast("int")).where(F.col(times) > 0)
    return rows.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns, *names, epoch)
