import datetime

from pyspark.sql import functions as F

from noticelake.functions import logic, text
from noticelake.operators import notices, rows, state


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first().x


def test_normalised_and_stable(spark):
    assert one(spark, text.normalised(F.lit("　a \n\t b "))) == "a b"
    assert one(spark, text.stable(F.lit("正文 瀏覽人次: 12 尾"))) == "正文 尾"
    assert one(spark, text.normalised(F.lit(None).cast("string"))) == ""


def test_dates(spark):
    date = lambda y, m, d, p: one(spark, logic.calendar_date(F.lit(y), F.lit(m), F.lit(d), F.lit(p).cast("date")))
    assert date("115", "8", "31", "2026-07-01") == datetime.date(2026, 8, 31)
    assert date("2026", "2", "30", "2026-07-01") is None
    assert date("", "1", "5", "2025-12-01") == datetime.date(2026, 1, 5)
    assert date("", "6", "5", "2025-12-01") == datetime.date(2025, 6, 5)
    assert one(spark, text.iso_date(F.lit("2026-7-1"))) == "2026-07-01"
    assert one(spark, text.iso_date(F.lit("soon"))) == "soon"


def test_canonical_url(spark):
    assert one(spark, text.canonical_url(F.lit("HTTP://A.example/x//y/?utm_source=q&b=2&a=1#top"))) == "http://a.example/x/y?a=1&b=2"
    assert one(spark, text.canonical_url(F.lit("https://a.example"))) == "https://a.example/"


def test_evidence_and_score(spark):
    body = F.lit("申請資格 申請期間 截止日期")
    no = F.lit(False)
    score = notices.evidence_score(body, notices.CJK_EVIDENCE, no, no)
    assert one(spark, score) == 6
    assert one(spark, notices.evidence_status(score, no, no)) == "valid_application_detail"
    assert one(spark, notices.match_score(F.lit(True), no, no, F.lit(2), F.lit(1), F.lit(True))) == 55
    assert one(spark, notices.health_score(F.lit(True), no, F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 100


def test_state_and_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, r string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "n")], "k int, r string")
    assert {r.k: r.status for r in state.observe(a, b, "k", "r").collect()} == {1: "unchanged", 2: "changed", 3: "baselined", 4: "missing"}
    assert sorted(r.k for r in state.discover(b, a, "k").collect()) == [3]
    assert {r.k: r.r for r in state.upsert(a, b, "k").collect()} == {1: "x", 2: "z", 3: "n", 4: "w"}
    scored = spark.createDataFrame([(1, "p", 90), (1, "q", 80), (2, "p", 100), (3, "p", 10)], "i int, c string, score int")
    assert {r.i: r.status for r in rows.best_with_margin(scored, "i", "c", 80, 15).collect()} == {1: "ambiguous", 2: "matched", 3: "no_match"}
    turns = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4)], "k int, t int, c int")
    assert [r.admitted for r in rows.greedy_budget(turns, "k", "t", "c", 10).orderBy("t").collect()] == [True, False, True]
    assert rows.first_wins(scored.limit(0), ["i"], ["score"]).count() == 0
