"""A notice's life as rows of one state table: found, evaluated, evaluated again,
revised, told once.

The table has a row for each notice, by ``content_hash``: ``published_date``,
``profile_hash``, ``notice_kind``, ``application_status``, ``hard_status``,
``resolution_status``, ``action_status``, ``notified_at`` and ``baseline_at``.
Every step returns the next table or the rows to work on; nothing is changed in
place.  Defined results: null hashes and statuses are ones that were never set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .notices import action_status

# Periods and actions that are worth telling.
TOLD_PERIODS = ["open", "upcoming", "deadline_unknown", "evergreen"]
TOLD_ACTIONS = ["apply_candidate", "verify_source", "manual_review"]
DECIDED = ["notice_kind", "application_status", "hard_status", "resolution_status", "action_status", "profile_hash", "evaluated_at"]


def fresh() -> Column:
    """Neither told nor there from the start."""
    return F.col("notified_at").isNull() & F.col("baseline_at").isNull()


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def to_evaluate(table: DataFrame, profile_hash: Column) -> DataFrame:
    """Fresh rows that were never evaluated, for another profile, or in part."""
    return table.where(fresh() & (F.col("hard_status").isNull() | ~F.col("profile_hash").eqNullSafe(profile_hash) | _blank("hard_status") | _blank("action_status")))


def decide(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """The table with decisions (``content_hash`` and the columns of ``DECIDED``) on
    its fresh rows.  A decision without an action gets the one that follows."""
    found = F.when(
        F.coalesce(F.col("action_status"), F.lit("")) != "", F.col("action_status")
    ).otherwise(action_status(F.col("hard_status"), F.col("resolution_status"), F.col("notice_kind"), F.col("application_status")))
    new = decisions.withColumn("action_status", found).select("content_hash", F.struct(*DECIDED).alias("new"))
    joined = table.join(new, "content_hash", "left")
    use = fresh() & F.col("new").isNotNull()
    return joined.select(*[F.when(use, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in DECIDED else F.col(c) for c in table.columns])


def reopen(table: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with its rows whose revision changed (``content_hash``) open again:
    not evaluated, not told, and not there from the start."""
    marked = table.join(changed.select("content_hash").distinct().withColumn("again", F.lit(True)), "content_hash", "left")
    clear = ["hard_status", "action_status", "profile_hash", "evaluated_at", "notified_at", "baseline_at"]
    return marked.select(*[F.when(F.col("again"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in clear else F.col(c) for c in table.columns])


def baseline(table: DataFrame, now: Column) -> DataFrame:
    """The table with all fresh rows marked as there from the start."""
    return table.withColumn("baseline_at", F.when(fresh(), now).otherwise(F.col("baseline_at")))


def to_tell(table: DataFrame, profile_hash: Column, review: bool = False) -> DataFrame:
    """Fresh rows of applications that a person may act on, by this profile."""
    wanted = ["eligible", "review"] if review else ["eligible"]
    return table.where(
        fresh() & (F.col("profile_hash") == profile_hash) & (F.col("notice_kind") == "application") & F.col("application_status").isin(TOLD_PERIODS) & F.col("hard_status").isin(wanted) & F.col("action_status").isin(TOLD_ACTIONS)
    )


def messages(rows: DataFrame, person: str, order: Sequence[Column], title: str, url: str, size: int = 5) -> DataFrame:
    """``person``, ``batch``, ``batches``, ``message``, ``hashes``: each person's rows in
    order, ``size`` to a message.  A person's news of one run are numbered in a window
    of their own; a message holds its own rows alone."""
    if size <= 0:
        raise ValueError("size must be above 0")
    mine = W.partitionBy(person)
    numbered = rows.withColumns({"place": F.row_number().over(mine.orderBy(*order)), "total": F.count("*").over(mine)})
    inside = (F.col("place") - 1) % size + 1
    lines = F.concat(inside.cast("string"), F.lit(". "), F.col(title), F.lit("\n"), F.col(url))
    each = numbered.select(person, (F.floor((F.col("place") - 1) / size) + 1).cast("int").alias("batch"), F.ceil(F.col("total") / size).cast("int").alias("batches"), "place", lines.alias("line"), "content_hash")
    batched = each.groupBy(person, "batch", "batches").agg(F.array_sort(F.collect_list(F.struct("place", "line", "content_hash"))).alias("x"))
    head = F.concat(F.lit("【符合資格獎學金｜第 "), F.col("batch").cast("string"), F.lit("/"), F.col("batches").cast("string"), F.lit(" 則】\n"))
    return batched.select(person, "batch", "batches", F.concat(head, F.array_join("x.line", "\n")).alias("message"), F.col("x.content_hash").alias("hashes"))


def told(table: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """The table with the rows of sent messages (``hashes``) marked, once."""
    done = sent.select(F.explode("hashes").alias("content_hash")).distinct().withColumn("done", F.lit(True))
    marked = table.join(done, "content_hash", "left")
    return marked.select(*[F.when(F.col("done"), F.coalesce(F.col(c), now)).otherwise(F.col(c)).alias(c) if c == "notified_at" else F.col(c) for c in table.columns])
