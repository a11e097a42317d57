"""Keyed state between runs, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discover(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet."""
    return rows.join(known.select(key), key, "left_anti")


def outdated(rows: DataFrame, fingerprint: str, current: Column) -> DataFrame:
    """Rows that were evaluated under another fingerprint, or never."""
    return rows.where(~F.col(fingerprint).eqNullSafe(current))


def observe(previous: DataFrame, current: DataFrame, key: str, revision: str) -> DataFrame:
    """Every key with ``status``: baselined (first seen), unchanged, changed or
    missing."""
    old, new = previous.select(key, F.col(revision).alias("previous")), current.select(key, F.col(revision).alias("current"))
    status = F.when(F.col("previous").isNull() & F.col("current").isNotNull(), "baselined").when(F.col("current").isNull(), "missing").when(F.col("previous") == F.col("current"), "unchanged").otherwise("changed")
    return old.join(new, key, "full_outer").select(key, "previous", "current", status.alias("status"))


def upsert(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The snapshot after a run: current rows, and previous ones that have none."""
    return current.unionByName(previous.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row")).select(key, "row.*")
