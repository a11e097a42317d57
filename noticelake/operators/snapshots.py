"""Kept tables: snapshots behind a pointer, insert-or-ignore, set-once fields,
keyed caches, added columns, and flat exports.

A snapshot is a folder of its own; the pointer file that names the current one
is replaced only after it is written whole, so readers see the old state or the
new one.  Defined results: no pointer means an empty table of the given schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "current.txt"


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the current snapshot."""
    fs, path = _store(spark, folder)
    if not fs.exists(path(f"{folder}/{POINTER}")):
        return None
    return spark.read.text(f"{folder}/{POINTER}").first()[0]


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The current snapshot, with columns that it was written without as null."""
    at = current(spark, folder)
    return spark.createDataFrame([], schema) if at is None else spark.read.schema(schema).parquet(f"{folder}/{at}")


def save(table: DataFrame, folder: str) -> str:
    """Write a new snapshot and turn the pointer to it."""
    spark, name = table.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/{name}")
    fs, path = _store(spark, folder)
    fresh, pointer = path(f"{folder}/{POINTER}.{name}"), path(f"{folder}/{POINTER}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext
    context.getFileContext(fresh.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri()).rename(fresh, pointer, _overwrite(spark))
    return name


def _overwrite(spark: SparkSession):
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    return options


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``table`` with the rows of new keys; of rows with equal keys the first."""
    new = rows.join(table.select(key), key, "left_anti")
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return table.unionByName(new.groupBy(key).agg(first).select("row.*"), allowMissingColumns=True)


def set_once(table: DataFrame, keys: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """``table`` with ``values`` where they are null and the key is among ``keys``."""
    mark = "marked"
    while mark.lower() in {c.lower() for c in table.columns}:
        mark = "_" + mark
    marked = table.join(keys.select(key).distinct().withColumn(mark, F.lit(True)), key, "left")
    columns = [F.when(F.col(mark), F.coalesce(F.col(c), values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns]
    return marked.select(*columns)


def put(cache: DataFrame, entries: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A cache with new entries; keys that it has stay as they are."""
    return insert_or_ignore(cache, entries, key, order)


def delete(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """A cache without the entries of some keys."""
    return cache.join(keys.select(key), key, "left_anti")


def cached(requests: DataFrame, cache: DataFrame, key: str, errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """Requests that a cache answers, with its columns, and those it doesn't.
    Without ``errors`` an entry whose ``status`` is error answers nothing."""
    usable = cache if errors else cache.where(~F.col("status").eqNullSafe("error"))
    return requests.join(usable, key), requests.join(usable.select(key), key, "left_anti")


def migrate(table: DataFrame, schema: str, fill: Mapping[str, Column]) -> DataFrame:
    """``table`` with all columns of ``schema``; ``fill`` for those that are null."""
    wanted = T._parse_datatype_string(schema)
    add = lambda f: F.col(f.name) if f.name in table.columns else F.lit(None)
    typed = table.select(*[add(f).cast(f.dataType).alias(f.name) for f in wanted])
    return typed.select(*[F.coalesce(F.col(n), fill[n]).alias(n) if n in fill else F.col(n) for n in typed.columns])


def flat(table: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return table.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in table.schema])


def json_list(cell: Column) -> Column:
    """A JSON cell as a list of texts; empty if it isn't one."""
    return F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))


def export(table: DataFrame, folder: str) -> None:
    """``table`` as JSON lines and as flat CSV in two folders."""
    table.write.json(f"{folder}/json")
    flat(table).write.option("header", True).option("escape", '"').csv(f"{folder}/csv")
