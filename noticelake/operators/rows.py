"""Row operators: ordered dedup, best match with a margin, ranking, batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str], copies: str | None = None) -> DataFrame:
    """One row for each key: the first by ``order``, with the number of its rows as
    ``copies`` if named.  One aggregate, so that rows are combined before they are
    moved and no key is gathered."""
    names = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*names), F.struct(*order)).alias("row")
    more = [F.count("*").alias(copies)] if copies else []
    return rows.groupBy(*keys).agg(first, *more).select(*keys, "row.*", *([copies] if copies else [])).select(*rows.columns, *([copies] if copies else []))


def best_with_margin(scored: DataFrame, item: str, candidate: str, least: int, margin: int) -> DataFrame:
    """For each item the best candidate by ``score`` (ties by name) with a status:
    ``no_match`` below ``least``, ``ambiguous`` if the second is nearer than
    ``margin``, else ``matched``."""
    order = W.partitionBy(item).orderBy(F.desc("score"), candidate)
    ranked = scored.withColumns({"rank": F.row_number().over(order), "second_score": F.coalesce(F.lead("score").over(order), F.lit(0)), "competing": F.coalesce(F.lead(candidate).over(order), F.lit(""))})
    near = (F.col("competing") != "") & (F.col("score") - F.col("second_score") < margin)
    status = F.when(F.col("score") < least, "no_match").when(near, "ambiguous").otherwise("matched")
    return ranked.where("rank = 1").select(item, candidate, "score", "second_score", "competing", status.alias("status"))


def best_of(scores: Mapping[str, Column], least: int, margin: int) -> Column:
    """As :func:`best_with_margin` for candidates that are columns of one row: a
    struct, without a shuffle."""
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("less"), F.lit(name).alias("candidate")) for name, s in scores.items()]))
    score, second = -ranked[0]["less"], F.coalesce(-F.get(ranked, F.lit(1))["less"], F.lit(0))
    competing = F.coalesce(F.get(ranked, F.lit(1))["candidate"], F.lit(""))
    status = F.when(score < least, "no_match").when((competing != "") & (score - second < margin), "ambiguous").otherwise("matched")
    return F.struct(ranked[0]["candidate"].alias("candidate"), score.alias("score"), second.alias("second_score"), competing.alias("competing"), status.alias("status"))


def top_within(rows: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, numbered."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def batches(rows: DataFrame, key: str, order: Sequence[Column], size: int) -> DataFrame:
    """Rows of a key in batches of ``size``, numbered from one."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("batch", F.ceil(place / F.lit(size)).cast("int"))


def greedy_budget(rows: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """``key``, ``order``, ``cost``, ``admitted``, ``left``: rows of a key in order; each
    is admitted if its cost fits what is left, and a refused one doesn't stop later
    ones.  A key's rows are sorted by Spark, which spills, and streamed past a
    running sum, so the work is linear and memory is a batch's, however long a key."""

    def run(batches):
        now, left = object(), budget
        for batch in batches:
            keys, costs = (batch.column(k).to_pylist() for k in (0, 2))
            fits, rest = [], []
            for name, amount in zip(keys, costs, strict=True):
                if name != now:
                    now, left = name, budget
                fits.append(amount is not None and amount <= left)
                left -= amount if fits[-1] else 0
                rest.append(left)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.bool_()), pa.array(rest, pa.int64())], [*batch.schema.names, "admitted", "left"])

    each = rows.select(F.col(key), F.col(order).cast("long").alias(order), F.col(cost).cast("long").alias(cost))
    each = each.repartition(key).sortWithinPartitions(key, order, cost)
    schema = T.StructType([*each.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("left", T.LongType())])
    return each.mapInArrow(run, schema)
