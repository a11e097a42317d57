import json

import pytest
from pyspark.sql import functions as F

from noticelake.operators import attachments, structured
from noticelake.operators.eligibility import manual_checks

WHOLE = {"document_type": "scholarship_rules", "criteria_complete": True, "needs_more_pages": False, "evidence": [{"page": 1, "text": "限 進修部"}]}
WHO = {"program_type": "進修部", "degree_level": "學士", "department": "電子工程系", "residence": "桃園市", "year": 3, "special_statuses": ["低收入戶"], "has_failed_courses": False}
CASES = [
    (WHOLE | {"program_types_included": ["日間部", "進修部"]}, WHO, "eligible", ["公告包含目前學制。"]),
    (WHOLE | {"program_types_excluded": ["在職專班"]}, WHO | {"employed": True}, "ineligible", ["公告排除「在職專班」。"]),
    (WHOLE | {"degree_levels": ["碩士"]}, WHO, "ineligible", ["公告限定的學位層級與目前不符。"]),
    (WHOLE | {"departments_included": ["資訊相關"]}, WHO, "eligible", ["科系或研究領域符合公告。"]),
    (WHOLE | {"departments_excluded": ["電子類"]}, WHO, "ineligible", ["公告排除「電子類」相關科系。"]),
    (WHOLE | {"required_special_statuses": ["中低收入戶", "具領導力"]}, WHO, "eligible", ["具備必要身分選項之一：「低收入戶」。"]),
    (WHOLE | {"required_special_statuses": ["原住民"]}, WHO, "ineligible", ["須具備以下任一身分：原住民。"]),
    (WHOLE | {"residence_requirement": "設籍桃園市"}, WHO, "eligible", ["戶籍條件符合公告。"]),
    (WHOLE | {"residence_requirement": "設籍臺北市"}, WHO | {"residence": None}, "review", ["profile 缺少戶籍資料。"]),
    (WHOLE | {"year_requirements": ["二年級以上"]}, WHO, "eligible", ["年級條件符合公告。"]),
    (WHOLE | {"year_requirements": ["大一至大二"]}, WHO, "ineligible", ["目前年級不在公告允許範圍。"]),
    (WHOLE | {"year_requirements": ["不含新生"]}, WHO, "eligible", ["目前年級未落入公告排除範圍。"]),
    (WHOLE | {"year_requirements": ["應屆"]}, WHO, "review", ["年級條件語意仍需人工確認：應屆"]),
    (WHOLE | {"explicit_exclusions": ["休學者"]}, WHO, "review", ["沒有足夠的結構化硬性條件可證明適用對象。"]),
    (WHOLE | {"explicit_exclusions": ["不得重複領取"]}, WHO | {"has_received_similar_scholarship": True}, "ineligible", ["重複領取條件命中公告排除條件。"]),
    (WHOLE | {"other_required_conditions": ["無不及格科目"]}, WHO, "eligible", ["無不及格科目條件符合。"]),
    (WHOLE | {"other_required_conditions": ["品行端正"]}, WHO, "review", ["其他必要條件仍需人工確認：品行端正"]),
    (WHOLE | {"criteria_complete": False, "program_types_included": ["進修部"]}, WHO, "review", [structured.INCOMPLETE]),
    (WHOLE | {"minimum_average_grade": 80.0, "rank_requirement": " "}, {}, "review", [structured.UNPROVEN]),
    ({}, WHO, "review", [structured.INCOMPLETE]),
]


def test_decisions_over_the_matrix(spark):
    rows = [(k, json.dumps(req), json.dumps(who)) for k, (req, who, _, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, (99, "not json", "{}")], "id int, req string, who string")
    df = df.select("id", structured.parsed(F.col("req")).alias("req"), F.from_json("who", structured.PROFILE).alias("who"))
    df = df.withColumn("matrix", structured.conditions(F.col("req"), F.col("who"), manual_checks))
    found = {r.id: r.d for r in df.select("id", structured.decide(F.col("req"), F.col("matrix")).alias("d")).collect()}
    for k, (_, _, status, reasons) in enumerate(CASES):
        assert (found[k].status, list(found[k].reasons)) == (status, reasons), k
    assert found[99].status == "review" and found[8].review_kind == "profile_missing" and found[0].review_kind is None
    assert "請自行確認：學業平均須達 80 分門檻。" in found[18].manual_checks
    assert found[5].manual_checks == ["請自行確認：是否符合「具領導力」評選條件。"]


def test_canonical_rule_text_and_scope(spark):
    req = WHOLE | {"program_types_included": ["進修部", "電機學系", " 進修部 "], "degree_levels": ["大專", "碩士", "高中"], "minimum_average_grade": 82.5, "explicit_exclusions": [" "]}
    part = {"document_type": "other", "criteria_complete": False, "evidence": [{"page": 2, "text": "本 案不含 在職專班"}], "program_types_excluded": ["在職專班，", "夜間部"]}
    rows = spark.createDataFrame([(1, json.dumps(req)), (2, json.dumps(part)), (3, "{}")], "id int, j string").select("id", structured.parsed(F.col("j")).alias("r"))
    clean = rows.withColumn("r", structured.canonical(F.col("r")))
    one = clean.where("id = 1").select("r.*", structured.rule_text(F.col("r")).alias("text")).first()
    assert one.program_types_included == ["進修部"] and one.departments_included == ["電機學系"] and one.degree_levels == ["大學生", "研究生", "高中"]
    assert one.text == "申請對象限於大學生及研究生及高中。申請對象為進修部學生。申請資格限於電機學系相關科系。學業平均82.5分以上。"
    scope = {r.id: tuple(r.u) for r in rows.select("id", structured.usable(F.col("r")).alias("u")).collect()}
    assert scope[1][0] == "complete" and scope[2] == ("partial_exclusions", "不包括在職專班，。") and scope[3] == ("none", None)


def test_year_set(spark):
    values = {"大二或大四": [2, 4], "二年級至四年級": [2, 3, 4], "第1年": [1], "新生": [1], "不限": []}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", structured.year_set(F.col("v")).alias("y")).collect()
    assert {r.v: r.y for r in rows} == values


def test_veto_and_conflict(spark):
    states = ["eligible", "review", "ineligible", None]
    rows = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    rows = rows.withColumn("f", structured.veto(F.col("a"), F.col("b"))).withColumn("c", structured.hard_conflict(F.col("a"), F.col("b"), F.col("f")))
    for r in rows.collect():
        assert r.f == ("ineligible" if r.b == "ineligible" else r.a)
        assert r.c is False  # a veto settles one kind, and an ineligible rule decision the other


def test_links_of_a_notice(spark):
    links = [
        (1, 0, "http://a/x.pdf", "申請辦法"), (1, 1, "http://a/y.docx?x=1", "申請表"), (1, 2, "http://a/z.odt", "附件"), (1, 3, "http://a/x.pdf", "切結書"),
        (1, 4, "http://a/page", "辦法"), (1, 5, "https://drive.google.com/f", "簡章下載"), (2, 0, "http://a/q", "同意書.pdf。"), (2, 1, None, None),
    ]
    best, counts = attachments.inventory(spark.createDataFrame(links, "id int, spot int, url string, label string"), "id", 3)
    assert [(r.id, r.url, r.role, r.score) for r in best.orderBy("id", "place").collect()] == [
        (1, "http://a/x.pdf", "rules", 110), (1, "https://drive.google.com/f", "rules", 105), (1, "http://a/z.odt", "generic_attachment", 57),
    ]
    assert [tuple(r) for r in counts.collect()] == [(1, 4, 2, 1)]


def test_content_role_and_status(spark):
    texts = [("", None, "uncertain"), (None, "rules", "uncertain"), ("切結書 申請資格 成績 排名", None, "supporting_document"), ("申請資格 成績 排名", None, "scholarship_rules"), ("姓名 學號 簽章", None, "application_form"), ("成績 可申請", "rules", "scholarship_rules"), ("成績 可申請", None, "uncertain"), ("字" * 40, None, "other")]
    rows = spark.createDataFrame(texts, "t string, h string, want string").select("want", attachments.content_role(F.col("t"), F.col("h")).alias("have")).collect()
    assert [r.have for r in rows] == [r.want for r in rows]
    grid = [([("success", "scholarship_rules", "x")], True, 0, 0, 0, "resolved"), ([], True, 0, 0, 0, "declared_but_missing"), (None, True, 2, 1, 0, "discovered_but_unresolved"), ([], False, 2, 0, 1, "generic_document_unconfirmed"), ([("error", "other", None)], False, 1, 0, 0, "discovered_but_unresolved"), ([("success", "other", "x")], False, 1, 0, 0, "not_required")]
    df = spark.createDataFrame(grid, f"a {attachments.attachments_type()}, q boolean, d int, r int, g int, want string")
    for r in df.select("want", attachments.rules_status(*[F.col(c) for c in "aqdrg"]).alias("have")).collect():
        assert r.have == r.want


def test_evaluation_text(spark):
    kind = f"b string, a {attachments.attachments_type()}, m string, s string"
    read = [("success", "scholarship_rules", "rules"), ("success", "other", "no"), ("error", "scholarship_rules", None)]
    column = attachments.evaluation_text(*[F.col(c) for c in "bams"]).alias("t")
    rows = spark.createDataFrame([("body", read, "model", "complete"), (None, None, None, None), ("body", read, None, "none")], kind).select(column).collect()
    assert [r.t for r in rows] == ["body\nrules\nmodel", "", "body\nrules"]
    with pytest.raises(Exception, match="contradict"):
        spark.createDataFrame([("body", read, "model", "none")], kind).select(column).collect()


def test_related(spark):
    rows = [("獎學金甲乙", "申請 截止", [], True), ("校慶", "天氣", [], False), ("補助", "申請", [], True), ("甲乙丙丁戊己", "有甲乙丙丁戊己", None, True), ("校慶活動", "申請 校慶活動", ["校慶活動"], True), ("校慶", "", [], False)]
    df = spark.createDataFrame(rows, "t string, b string, a array<string>, want boolean")
    for r in df.select("t", "want", attachments.related(F.col("t"), F.col("b"), F.col("a")).alias("have")).collect():
        assert r.have == r.want, r.t
