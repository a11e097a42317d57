"""Queries over eligibility: limits, statuses, facts and what is left to check."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import verdicts
from .announcements import values, with_cases
from .queries import _table, query

#: A person of the rules' own examples, and another one.
EVENING = {
    "school": "測試科技大學", "degree_level": "學士", "program_type": "進修部四技", "department": "電子工程系", "year": 2, "employed": True,
    "residence": "新北市", "special_statuses": [], "research_keywords": ["電力電子", "能源"], "nationality": "中華民國", "enrollment_status": "在學",
    "academic_year_average": 90.0, "has_major_discipline": False, "special_statuses_confirmed": True,
}
DAY = {"school": "示範大學", "degree_level": "碩士", "program_type": "日間部", "department": "會計系", "year": 4, "employed": False, "residence": "", "special_statuses": ["低收入戶"], "research_keywords": []}
PEOPLE = {"evening": EVENING, "day": DAY}

COLLEGE, NOTHING, THRESHOLDS = verdicts.COLLEGE_MATCH, verdicts.NOTHING, verdicts.ONLY_THRESHOLDS
#: id, person, title, detail, status, reasons
CASES = [
    (-1, "evening", "甲獎學金", "申請對象：大專院校在學生，每學期成績平均八十分。", "eligible", COLLEGE),
    (-2, "evening", "乙獎學金", "申請資格限日間部學生。", "ineligible", "公告限定日間部，與目前學制不符。"),
    (-3, "evening", "丙獎學金", "日間部及進修部大學生均可申請。", "eligible", f"公告明確包含進修部學生。|{COLLEGE}"),
    (-4, "evening", "丁獎學金", "本獎學金不包括進修推廣部學生。", "ineligible", "公告明確排除進修部或進修推廣學制。"),
    (-5, "evening", "研究生獎學金", "申請方式如下。", "ineligible", "公告限定研究所或博士生層級。"),
    (-6, "evening", "大學生暨研究生獎學金", "申請方式如下。", "review", NOTHING),
    (-7, "evening", "戊獎學金", "僅限國中、高中學生申請。", "ineligible", "公告限定非大專學制。"),
    (-8, "evening", "己獎學金", "限護理相關科系學生申請。", "ineligible", "公告限定「護理」相關科系，與目前科系不符。"),
    (-9, "evening", "庚獎學金", "申請資格：電機、機械相關科系大學生。", "eligible", f"{verdicts.FIELD_MATCH}|{COLLEGE}"),
    (-10, "evening", "辛獎學金", "請寄電子郵件至學務處。", "review", NOTHING),
    (-11, "evening", "新生入學獎學金", "", "ineligible", "公告限定新生或大一學生。"),
    (-12, "evening", "壬獎學金", "申請資格限應屆畢業生。", "ineligible", "公告限定應屆或畢業年級學生。|公告限定應屆畢業生。"),
    (-13, "evening", "癸獎學金", "大專校院大學部大三以上學生得申請。", "ineligible", "公告限定大學 3 年級以上。"),
    (-14, "evening", "低收入戶助學金", "", "ineligible", "公告限定「低收入戶」身分。"),
    (-15, "day", "低收入戶助學金", "凡大專院校學生均可申請。", "eligible", COLLEGE),
    (-16, "evening", "子獎學金", "申請資格為符合下列任一：。低收入戶；家境清寒", "ineligible", "須具備以下任一身分：低收入戶、清寒。"),
    (-17, "day", "丑獎學金", "申請資格為符合下列任一：。低收入戶；家境清寒", "review", NOTHING),
    (-18, "evening", "寅獎學金", "大學生均可申請，清寒者優先。", "eligible", COLLEGE),
    (-19, "evening", "卯獎學金", "凡大學生可申請，以弱勢為原則之經濟弱勢學生。", "review", verdicts.VAGUE),
    (-20, "evening", "辰獎學金", "須設籍於臺中市者，限大專在校生。", "ineligible", "公告限設籍於 臺中市，與目前居住地不符。"),
    (-21, "day", "巳獎學金", "須設籍於臺中市者，限大專在校生。", "review", "公告有戶籍限制，但 profile.json 未填居住地。"),
    (-22, "evening", "午獎學金", "須設籍新北市之學生。", "review", THRESHOLDS),
    (-23, "evening", "未獎學金", "申請對象限全職學生之大學生。", "review", "公告要求全職學生，與進修／在職背景的適用性需人工確認。"),
    (-24, "evening", "申獎學金", "申請資格詳見附件。", "review", verdicts.ATTACHED),
    (-25, "evening", "酉獎學金", "限測試科技大學學生。前一學年學業平均須達 95 分。", "ineligible", "前一學年平均 90 未達 95 分門檻。"),
    (-26, "evening", "戌獎學金", "申請對象為測試科技大學學生，須具中華民國國籍，未受記過處分。", "eligible", f"{verdicts.SCHOOL_MATCH}|中華民國國籍符合公告要求。|無記過或重大懲處，符合公告要求。"),
    (-27, "evening", "亥獎學金", "大學生，須由學校推薦。", "review", "公告需要推薦，須向學校、導師或系主任確認。"),
    (-28, "evening", "技藝獎學金", "限大學生，不包含商管類、電機電子資訊類。", "ineligible", "公告明確排除電機、電子或資訊相關專長。"),
    (-29, "evening", None, None, "review", NOTHING),
    (-30, "evening", "碩士班獎學金、大學部獎學金", "申請資格限碩士班，但大學部學生可申請。", "review", NOTHING),
]
#: A sentence for each class of documents, with the outcome.
SAID = [
    ("申請對象限國內大專院校學生。", "eligible", COLLEGE),
    ("申請資格限日間部學生。", "ineligible", "公告限定日間部，與目前學制不符。"),
    ("", "review", NOTHING),
    ("申請對象限低收入戶之大專院校學生。", "ineligible", "公告限定「低收入戶」身分。"),
    ("相關內容請參閱附件。", "review", verdicts.ATTACHED),
    ("申請對象為大專院校學生，須修滿 60 學分。", "review", "公告有學分門檻，但 profile.json 未填累積通過學分。"),
]


def _person(who: str):
    return F.lit(json.dumps(PEOPLE[who], ensure_ascii=False))


@query(f"""
WITH s(k, status, reasons) AS ({values([(k, s, r) for k, (_, s, r) in enumerate(SAID)])})
SELECT doc_id AS id, status, reasons FROM documents JOIN s ON k = doc_id % {len(SAID)} UNION ALL SELECT a, e, f FROM ({values(CASES)}) t(a, b, c, d, e, f)
""")
def q49_eligibility(spark, sf_dir):
    """E01 to E09, E12 to E14 over every text, led by a sentence of the domain, and
    over the rules' cases for two people."""
    lead = F.element_at(F.array(*[F.lit(x) for x, _, _ in SAID]), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("evening").alias("who"), F.lit("示範獎學金").alias("title"), F.concat(lead, F.lit("\n"), "text").alias("detail"))
    rows = with_cases(rows, [r[:4] for r in CASES], "id long, who string, title string, detail string")
    person = F.when(F.col("who") == "day", _person("day")).otherwise(_person("evening"))
    found = rows.select("id", verdicts.decisions(F.col("title"), F.col("detail"), person).alias("x"))
    return found.select("id", "x.status", F.array_join("x.reasons", "|").alias("reasons"))


@query(f"""
WITH c AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal * 100) END AS income, c_custkey % 130 AS credits, c_custkey % 5 AS loan, c_custkey % 3 AS home FROM customer
), r AS (
  SELECT id, list_filter([CASE WHEN credits > 0 AND credits < 60 THEN '累積通過學分 ' || credits || ' 未達 60 學分門檻。' END,
      CASE WHEN home = 1 THEN '公告限設籍於 新北市新莊區，與目前戶籍地不符。' END, CASE WHEN income > 500000 THEN '家庭年所得超過公告上限 500000 元。' END,
      CASE WHEN loan = 1 THEN '公告要求曾申請就學貸款，但目前已確認不符合。' END], lambda x: x IS NOT NULL) AS out,
    list_filter([CASE WHEN home = 2 THEN '公告有戶籍限制，但 profile.json 未填居住地。' END, CASE WHEN credits = 0 THEN '公告有學分門檻，但 profile.json 未填累積通過學分。' END,
      CASE WHEN home = 2 THEN '公告有限定行政區戶籍，但 profile.json 未填完整戶籍地。' END, CASE WHEN income IS NULL THEN '公告有家庭所得限制，但 profile.json 未填家庭年所得。' END,
      CASE WHEN loan = 2 THEN '公告要求曾申請就學貸款，但 profile.json 尚未確認。' END], lambda x: x IS NOT NULL) AS open,
    ['戶籍條件符合公告限制。', '{COLLEGE}', '累積通過學分符合至少 60 學分門檻。', '戶籍地符合 新北市新莊區 限制。', '家庭年所得符合公告上限。', '已確認曾申請就學貸款。'] AS good FROM c
)
SELECT id, CASE WHEN len(out) > 0 THEN 'ineligible' WHEN len(open) > 0 THEN 'review' ELSE 'eligible' END AS status,
  CASE WHEN len(out) > 0 THEN out WHEN len(open) > 0 THEN open ELSE good END AS reasons,
  CASE WHEN len(out) = 0 AND len(open) > 0 THEN 'profile_missing' ELSE '' END AS review_kind FROM r
""")
def q68_fact_rules(spark, sf_dir):
    """Facts of many people for one notice."""
    k = F.col("c_custkey")
    income = F.when(k % 7 > 0, F.round(F.col("c_acctbal") * 100))
    loan = F.when(k % 5 == 1, F.lit(False)).when(k % 5 != 2, F.lit(True))
    home = F.when(k % 3 == 0, "新北市新莊區中正路").when(k % 3 == 1, "新北市板橋區").otherwise("")
    who = F.to_json(F.struct((k % 130).alias("credits_earned"), income.alias("household_income"), loan.alias("has_student_loan"), home.alias("residence"), F.lit(2).alias("year")))
    detail = F.lit("申請對象為大學生，須修滿60學分。須設籍新北市新莊區。須家庭年所得未超過50萬元。須曾申請就學貸款。")
    rows = _table(spark, sf_dir, "customer").select(k.alias("id"), verdicts.decisions(F.lit("示範獎學金"), detail, who).alias("x"))
    return rows.select("id", "x.status", "x.reasons", "x.review_kind")


@query(f"""
WITH c AS (
  SELECT c_custkey AS id, c_custkey % 4 AS rules, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS has, c_custkey % 3 > 0 AS sure FROM customer
)
SELECT id, CASE WHEN rules = 3 THEN 'review' WHEN has = 0 AND sure THEN 'ineligible' WHEN NOT sure THEN 'review' ELSE 'eligible' END AS status,
  CASE WHEN rules = 3 THEN CASE WHEN NOT sure THEN ['{verdicts.UNCONFIRMED}', '{verdicts.RULES_MISSING["discovered_but_unresolved"]}'] ELSE ['{verdicts.RULES_MISSING["discovered_but_unresolved"]}'] END
    WHEN has = 0 AND sure THEN ['須具備以下任一身分：低收入戶、清寒。'] WHEN NOT sure THEN ['{verdicts.UNCONFIRMED}'] ELSE ['{COLLEGE}'] END AS reasons
FROM c
""")
def q69_status_aliases(spark, sf_dir):
    """E09 and the state of a notice's own rules, for many people."""
    k = F.col("c_custkey")
    own = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit("低收學生"))).when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("家境清寒"))).otherwise(F.array().cast("array<string>"))
    who = F.to_json(F.struct(own.alias("special_statuses"), (k % 3 > 0).alias("special_statuses_confirmed")))
    rules = F.when(k % 4 == 3, "discovered_but_unresolved").when(k % 4 == 2, "resolved").when(k % 4 == 1, "not_required").otherwise("unknown")
    detail = F.lit("凡大專院校學生均可申請。申請條件為符合下列之一：。低收入戶；家庭清寒。")
    rows = _table(spark, sf_dir, "customer").select(k.alias("id"), verdicts.decisions(F.lit("示範獎學金"), detail, who, rules).alias("x"))
    return rows.select("id", "x.status", "x.reasons")


CHECKED = [
    (-1, "學業平均須達 80 分，操行成績 82 分以上。", "請自行確認：學業平均成績須達 82 分門檻。|請自行確認：學業平均成績須達 80 分門檻。"),
    (-2, "班級排名前 10%；GPA 不得低於 3.2。系排名在前 5 名", "請自行確認：GPA 須達 3.2 門檻。|請自行確認：班級排名須為前 10%。|請自行確認：系排名須為前 5 名。"),
    (-3, "須繳交推薦函並參加面試。不得有不及格科目。", "請自行確認：是否符合公告的無不及格科目條件。|需準備：推薦函（屬申請準備，不影響硬性資格判定）。|需準備：面試（屬申請準備，不影響硬性資格判定）。"),
    (-4, "學業成績 85 分以上、學業成績 85 分以上。", "請自行確認：學業平均成績須達 85 分門檻。"),
    (-5, "無其他條件", ""),
    (-6, None, ""),
]


@query(f"""
SELECT doc_id AS id, '請自行確認：操行成績須達 ' || doc_id % 100 || ' 分門檻。|請自行確認：班級排名須為前 ' || doc_id % 30 || '%。|需準備：作品集（屬申請準備，不影響硬性資格判定）。' AS checks FROM documents
UNION ALL SELECT a, c FROM ({values(CHECKED)}) t(a, b, c)
""")
def q28_manual_checks(spark, sf_dir):
    """E15 over every text, led by three conditions, and the rule's cases."""
    n = F.col("doc_id")
    said = F.concat(F.lit("操行成績達 "), (n % 100).cast("string"), F.lit(" 分，班級排名前 "), (n % 30).cast("string"), F.lit("%。請附上傳作品集。"), "text")
    rows = with_cases(_table(spark, sf_dir, "documents").select(n.alias("id"), said.alias("t")), [r[:2] for r in CHECKED], "id long, t string")
    found = rows.select("id", verdicts.decisions(F.lit(""), F.col("t"), F.lit("{}")).alias("x"))
    return found.select("id", F.array_join("x.checks", "|").alias("checks"))
