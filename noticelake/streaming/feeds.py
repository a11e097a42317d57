"""Keyed state over an unbounded feed; each run takes what is available."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder of ``spark.checkpoint.dir``.  Only a
    session that runs in one process may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="noticelake-")
    return f"{base.rstrip('/')}/noticelake/{name}-{uuid.uuid4().hex}"


def available(feed: DataFrame, name: str) -> DataFrame:
    """Run a streaming plan over what its source has now; the table it wrote."""
    spark = feed.sparkSession
    out, point = folder(spark, name), folder(spark, f"{name}-state")
    query = feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(feed.schema).parquet(out)


def discovered_once(feed: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, whenever it is first seen; the state holds every key."""
    return feed.select(*keys).dropDuplicates(keys)


def revisions(feed: DataFrame, key: str, revision: str, order: str, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Changes (``key``, ``previous``, ``current``, ``status``, ``batch``) and the
    snapshot (``key``, ``revision``, ``at``, its place in the order) after a feed.

    A key's last revision is kept in Spark's keyed state, so a batch costs what it
    touches.  Of a key's rows in a batch the last by ``order`` counts; revisions
    themselves have no order.  A batch that is run again overwrites its own changes
    alone.  A later run takes the snapshot as ``previous``, which is asked only for
    keys without a state."""
    spark = feed.sparkSession
    base, point = folder(spark, "revisions"), folder(spark, "revisions-state")
    rows = feed.select(key, F.col(revision).alias("revision"), F.col(order).alias("at"))
    kinds = {f.name: f.dataType for f in rows.schema}
    if previous is None:
        previous = spark.createDataFrame([], rows.schema)
    known = previous.select(key, F.col("revision").alias("known"))
    rows = rows.join(known, key, "left")
    out = T.StructType([T.StructField(key, kinds[key]), *[T.StructField(n, kinds["revision"]) for n in ("previous", "current")], T.StructField("status", T.StringType()), T.StructField("at", kinds["at"])])

    def step(name, frames, state):
        last = pd.concat(frames).sort_values("at", kind="stable").iloc[-1]
        seen = state.get[0] if state.exists else (None if pd.isna(last["known"]) else last["known"])
        now = last["revision"]
        status = "baselined" if seen is None else "unchanged" if seen == now else "changed"
        state.update((now,))
        yield pd.DataFrame([[name[0], seen, now, status, last["at"]]], columns=out.names)

    changed = rows.groupBy(key).applyInPandasWithState(step, out, T.StructType([T.StructField("revision", kinds["revision"])]), "append", "NoTimeout")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={n}")

    query = changed.writeStream.foreachBatch(put).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    stored = T.StructType([*out.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], stored).drop("batch").write.mode("overwrite").parquet(f"{base}/batch=-1")  # so that a feed without rows has a table
    changes = spark.read.schema(stored).parquet(base).where("batch >= 0")
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col("current").alias("revision"), "at"), F.struct("batch", "at")).alias("x")).select(key, "x.revision", "x.at")
    kept = previous.select(key, "revision", "at").join(last.select(key), key, "left_anti")
    return changes.select(key, "previous", "current", "status", "batch"), kept.unionByName(last)
