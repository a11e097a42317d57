"""Decision forms: cascades, weighted scores, tri-state comparisons, dates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cascade(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; unknown conditions don't."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def weighted(rules: Sequence[tuple[Column, int]]) -> Column:
    """The sum of the weights of the conditions that hold."""
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w in rules], F.lit(0))


def tri_state(value: Column, least: Column) -> Column:
    """``match``, ``excluded`` or ``unknown``: zero and null values are missing,
    and without a requirement everything matches."""
    return F.when(least.isNull(), "match").when(value.isNull() | (value == 0), "unknown").when(value >= least, "match").otherwise("excluded")


def decision(states: Sequence[Column]) -> Column:
    """Excluded by any, else in review for any unknown, else eligible."""
    some = lambda s: reduce(lambda a, b: a | b, [x == s for x in states])
    return F.when(some("excluded"), "ineligible").when(some("unknown"), "review").otherwise("eligible")


def calendar_date(year: Column, month: Column, day: Column, published: Column) -> Column:
    """A date from text parts: a year of three digits counts from 1911; without
    one it is the publication's, or the next if the month lies more than six
    before it.  Impossible dates are null."""
    own = F.when(F.length(year) == 3, year.cast("int") + 1911).when(year != "", year.cast("int"))
    month_no = month.cast("int")
    guess = F.year(published) + F.when(F.month(published) - month_no > 6, 1).otherwise(0)
    text = F.concat_ws("-", F.coalesce(own, guess).cast("string"), month_no.cast("string"), day.cast("int").cast("string"))
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def period_status(start: Column, deadline: Column, as_of: Column) -> Column:
    """Where a day lies against an application period."""
    return F.when(deadline < as_of, "expired").when(start > as_of, "upcoming").when(deadline.isNotNull(), "open").otherwise("deadline_unknown")
