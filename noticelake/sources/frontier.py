"""Pages that can be reached from a start, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.feeds import folder


def reach(links: DataFrame, start: DataFrame, rounds: int = 200) -> DataFrame:
    """``node`` and the ``depth`` at which it is first seen, over ``links`` (node,
    target).  ``rounds`` bounds how deep a crawl goes.  Each round is a join on the
    key and a partition of one table, so a lost executor repeats one round at most.
    Cycles and repeated links add nothing; nulls are no nodes."""
    spark, base = links.sparkSession, folder(links.sparkSession, "frontier")
    nodes = start.select("node").where("node IS NOT NULL").distinct()
    schema = nodes.withColumn("depth", F.lit(0)).schema
    for depth in range(rounds + 1):
        nodes.write.parquet(f"{base}/depth={depth}")
        last = spark.read.schema(nodes.schema).parquet(f"{base}/depth={depth}")
        if last.isEmpty():
            break
        seen = spark.read.schema(schema).parquet(base).select("node")
        new = links.join(last, "node", "left_semi").select(F.col("target").alias("node")).where("node IS NOT NULL").distinct()
        nodes = new.join(seen, "node", "left_anti")
    return spark.read.schema(schema).parquet(base)
