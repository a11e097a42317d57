"""Decisions from structured requirements: a matrix of conditions for every pair
of requirements and profile, the decision over it, and its veto.

Everything is an expression over two struct columns, so any number of profiles
meets any number of notices in one projection after their join.

Defined results: a null list is an empty one and blank entries are dropped; null
requirements are incomplete, thus in review; a null profile field is unknown
where that is a state of its own and matches nothing elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logic import cascade
from ..functions.text import contains_any

LISTS = ["applicant_groups", "degree_levels", "program_types_included", "program_types_excluded", "departments_included", "departments_excluded", "year_requirements", "required_special_statuses", "explicit_exclusions", "other_required_conditions"]
REQUIREMENTS = ", ".join(
    [
        "document_type string, criteria_complete boolean, needs_more_pages boolean",
        *[f"{name} array<string>" for name in LISTS],
        "minimum_average_grade double, minimum_conduct_grade double, rank_requirement string, residence_requirement string, application_deadline string",
        "evidence array<struct<page:int,text:string>>",
    ]
)
PROFILE = "program_type string, degree_level string, department string, research_keywords array<string>, special_statuses array<string>, residence string, year int, employed boolean, enrollment_status string, school string, has_received_similar_scholarship boolean, has_failed_courses boolean, can_obtain_recommendation boolean"
CONDITION = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("field", "requirement", "status", "reason")]))

# Terms that requirements and profiles are compared by.
PROGRAMS = ["進修", "日間", "在職"]
COLLEGE = ["大學生", "大學部", "學士", "大專"]
GRADUATE = ["研究生", "碩士", "博士"]
FIELDS = ["電子", "電機", "電力", "能源", "資通訊", "資訊", "通訊", "工程", "理工", "電資"]
STATUS_TERMS = ["低收入", "中低收入", "清寒", "弱勢", "原住民", "身心障礙", "新住民", "單親", "特殊境遇", "失親", "孤兒", "隔代教養", "育幼", "燒傷", "心臟病", "罕見疾病", "重大傷病", "勞工子女", "農漁民", "遺族", "受刑人子女"]
EXCEPT_YEARS = ["不含", "不包括", "排除", "不得為", "非"]
TWICE = ["不得重複", "已獲得其他單位獎學金", "重複申請"]
FRESH = ["新生", "大一", "一年級"]
NUMERALS = "一二三四五六"
DEPARTMENT_MARKS = ["科系", "學系", "系所", "學院", "學門", "專業"]
COLLEGE_LEVELS = ["大專", "大學", "學院", "大學部", "學士"]
GRADUATE_LEVELS = ["研究所", "研究生", "碩士", "博士"]
INCOMPLETE = "Gemini 抽取的資格文件不完整或證據不足。"
UNPROVEN = "沒有足夠的結構化硬性條件可證明適用對象。"


def parsed(json: Column) -> Column:
    """Requirements from their JSON; null if it isn't JSON."""
    return F.from_json(json, REQUIREMENTS)


def _list(values: Column) -> Column:
    """Trimmed entries, each once, in order."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.regexp_replace(v, r"(?U)^\s+|\s+$", "")))
    return F.array_distinct(F.filter(clean, lambda v: v.isNotNull() & (v != "")))


def _any(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def canonical(req: Column, department_marks: Sequence[str] = DEPARTMENT_MARKS) -> Column:
    """Requirements with departments moved out of the programmes and degree
    levels by their common names."""
    own = {n: _list(req[n]) for n in LISTS}
    for kind in ("included", "excluded"):
        programs = own[f"program_types_{kind}"]
        own[f"program_types_{kind}"] = F.filter(programs, lambda v: ~contains_any(v, department_marks))
        own[f"departments_{kind}"] = F.array_distinct(F.concat(own[f"departments_{kind}"], F.filter(programs, lambda v: contains_any(v, department_marks))))

    def level(v: Column) -> Column:
        named = F.filter(F.array(F.when(contains_any(v, COLLEGE_LEVELS), "大學生"), F.when(contains_any(v, GRADUATE_LEVELS), "研究生")), lambda x: x.isNotNull())
        return F.when(F.size(named) > 0, named).otherwise(F.array(v))

    own["degree_levels"] = F.array_distinct(F.flatten(F.transform(own["degree_levels"], level)))
    names = [part.strip().split(" ")[0] for part in REQUIREMENTS.replace("struct<page:int,text:string>", "struct").split(",")]
    return F.struct(*[(own[n] if n in own else req[n]).alias(n) for n in names])


def number(value: Column) -> Column:
    """A number without a point where it is whole."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def rule_text(req: Column) -> Column:
    """The requirements as sentences, for the rules over text."""

    def joined(before: str, name: str, after: str = "") -> Column:
        return F.when(F.size(_list(req[name])) > 0, F.concat(F.lit(before), F.array_join(_list(req[name]), "及"), F.lit(after)))

    def each(before: str, name: str) -> Column:
        return F.transform(_list(req[name]), lambda v: F.concat(F.lit(before), v))

    def grade(label: str, name: str) -> Column:
        return F.concat(F.lit(label), number(req[name]), F.lit("分以上"))

    def filled(name: str) -> Column:
        return F.when(F.trim(req[name]) != "", req[name])

    lines = F.concat(
        F.array(joined("申請對象為", "applicant_groups"), joined("申請對象限於", "degree_levels"), joined("申請對象為", "program_types_included", "學生")),
        each("不包括", "program_types_excluded"),
        F.array(joined("申請資格限於", "departments_included", "相關科系")),
        each("不包括相關科系：", "departments_excluded"),
        each("", "year_requirements"),
        F.array(joined("申請資格限於", "required_special_statuses"), grade("學業平均", "minimum_average_grade"), grade("操行成績", "minimum_conduct_grade"), filled("rank_requirement"), filled("residence_requirement")),
        F.array(F.concat(F.lit("申請截止日"), filled("application_deadline"))),
        each("不包括", "explicit_exclusions"),
        each("", "other_required_conditions"),
    )
    kept = F.transform(F.filter(lines, lambda v: F.trim(v) != ""), lambda v: F.regexp_replace(v, "^[。 ]+|[。 ]+$", ""))
    return F.concat(F.array_join(kept, "。"), F.lit("。"))


# ---------------------------------------------------------------- conditions


def _condition(field: str, requirement: Column, status: Column, reason: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), requirement.alias("requirement"), status.alias("status"), reason.alias("reason"))


def _when(condition: Column, *entries: Column) -> Column:
    return F.when(condition, F.array(*entries)).otherwise(F.array().cast(CONDITION))


def _met(field: str, values: Column, met: Column, yes: str, no: str) -> Column:
    """One condition over a whole list, if it isn't empty."""
    met = F.coalesce(met, F.lit(False))
    return _when(F.size(values) > 0, _condition(field, F.array_join(values, "、"), F.when(met, "pass").otherwise("fail"), F.when(met, yes).otherwise(no)))


def _hits(field: str, values: Column, hit, before: str, after: str) -> Column:
    """A failure for each entry that hits."""
    found = F.filter(values, lambda v: F.coalesce(hit(v), F.lit(False)))
    return F.transform(found, lambda v: _condition(field, v, F.lit("fail"), F.concat(F.lit(before), v, F.lit(after))))


def _program(req: Column, who: Column) -> Column:
    own = who["program_type"]

    def same(v: Column) -> Column:
        both = [v.contains(t) & own.contains(t) for t in PROGRAMS]
        return (v == own) | both[0] | both[1] | both[2]

    shut = _hits("program", _list(req["program_types_excluded"]), lambda v: F.coalesce(same(v), F.lit(False)) | (v.contains("在職") & F.coalesce(who["employed"], F.lit(False))), "公告排除「", "」。")
    open_to = _list(req["program_types_included"])
    return F.concat(shut, _met("program", open_to, _any(open_to, same), "公告包含目前學制。", "公告列出的學制不包含目前學制。"))


def _degree(req: Column, who: Column) -> Column:
    levels = _list(req["degree_levels"])
    fits = F.when(who["degree_level"] == "學士", _any(levels, lambda v: contains_any(v, COLLEGE))).otherwise(_any(levels, lambda v: contains_any(v, GRADUATE)))
    return _met("degree", levels, fits, "學位層級符合公告。", "公告限定的學位層級與目前不符。")


def _department(req: Column, who: Column) -> Column:
    own = F.concat(_list(F.array(who["department"])), _list(who["research_keywords"]), F.array(*[F.lit(t) for t in FIELDS]))
    near = lambda v: _any(own, lambda t: v.contains(t))
    shut = _hits("department", _list(req["departments_excluded"]), near, "公告排除「", "」相關科系。")
    open_to = _list(req["departments_included"])
    return F.concat(shut, _met("department", open_to, _any(open_to, near), "科系或研究領域符合公告。", "公告指定科系與目前背景不符。"))


def _statuses(req: Column, who: Column) -> Column:
    bare = lambda v: F.regexp_replace(v, r"(?U)[\s、，,；;／/或與及]+", "")
    wanted = _list(req["required_special_statuses"])
    hard = F.filter(wanted, lambda v: contains_any(bare(v), STATUS_TERMS))
    soft = F.filter(wanted, lambda v: ~contains_any(bare(v), STATUS_TERMS))
    asked = F.transform(soft, lambda v: _condition("qualitative_requirement", v, F.lit("manual"), F.concat(F.lit("請自行確認：是否符合「"), v, F.lit("」評選條件。"))))
    own = _list(who["special_statuses"])
    found = F.flatten(F.transform(hard, lambda v: F.filter(own, lambda o: bare(v).contains(bare(o)) | bare(o).contains(bare(v)))))
    listed, first = F.array_join(hard, "、"), F.get(found, F.lit(0))
    reason = F.when(first.isNotNull(), F.concat(F.lit("具備必要身分選項之一：「"), first, F.lit("」。"))).otherwise(F.concat(F.lit("須具備以下任一身分："), listed, F.lit("。")))
    return F.concat(asked, _when(F.size(hard) > 0, _condition("special_status_any_of", listed, F.when(first.isNotNull(), "pass").otherwise("fail"), reason)))


def _to_check(req: Column) -> Column:
    def grade(field: str, name: str, label: str) -> Column:
        value = number(req[name])
        return _when(req[name].isNotNull(), _condition(field, value, F.lit("manual"), F.concat(F.lit(f"請自行確認：{label}須達 "), value, F.lit(" 分門檻。"))))

    rank = req["rank_requirement"]
    ranked = _when(F.coalesce(rank, F.lit("")) != "", _condition("rank", rank, F.lit("manual"), F.concat(F.lit("請自行確認："), rank, F.lit("。"))))
    return F.concat(grade("average_grade", "minimum_average_grade", "學業平均"), grade("conduct_grade", "minimum_conduct_grade", "操行成績"), ranked)


def _residence(req: Column, who: Column) -> Column:
    plain = lambda v: F.translate(v, "臺 ", "台")
    wanted, own = req["residence_requirement"], who["residence"]
    missing, fits = F.coalesce(own, F.lit("")) == "", plain(wanted).contains(plain(own))
    status = F.when(missing, "unknown").when(fits, "pass").otherwise("fail")
    reason = F.when(missing, "profile 缺少戶籍資料。").when(fits, "戶籍條件符合公告。").otherwise("戶籍條件與公告不符。")
    return _when(F.coalesce(wanted, F.lit("")) != "", _condition("residence", wanted, status, reason))


def year_set(value: Column) -> Column:
    """The years that a requirement names, ranges included, in order."""
    # numerals become digits where they stand for a year
    digits = F.translate(value, NUMERALS, "123456")
    named = F.regexp_extract_all(digits, F.lit(r"(?:大|第)([1-6])|([1-6])\s*年"), F.lit(0))
    single = F.transform(named, lambda v: F.regexp_extract(v, "[1-6]", 0).cast("int"))
    span = r"(?:大|第)?([1-6])\s*(?:年級|年)?\s*(?:至|到|－|-|~)\s*(?:大|第)?([1-6])\s*(?:年級|年)?"
    low, high = (F.regexp_extract(digits, span, k).try_cast("int") for k in (1, 2))
    between = F.when(low.isNotNull() & high.isNotNull(), F.sequence(F.least(low, high), F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    fresh = F.when(value.contains("新生"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.concat(single, between, fresh)))


def _year(req: Column, who: Column) -> Column:
    own = who["year"]

    def bound(v: Column, word: str) -> Column:
        return F.regexp_extract(F.translate(v, NUMERALS, "123456"), rf"(?:大|第)?([1-6])\s*(?:年級|年)?\s*(?:含)?{word}", 1).try_cast("int")

    def one(v: Column) -> Column:
        least, most, years = bound(v, "以上"), bound(v, "以下"), year_set(v)
        shut = least.isNull() & most.isNull() & contains_any(v, EXCEPT_YEARS)
        inside = F.coalesce(F.array_contains(years, own), F.lit(False))
        fits = F.when(least.isNotNull(), own >= least).when(most.isNotNull(), own <= most).when(shut, ~inside).otherwise(inside)
        fits = F.coalesce(fits, F.lit(False))
        vague = least.isNull() & most.isNull() & (F.size(years) == 0)
        status = F.when(vague, "unknown").when(fits, "pass").otherwise("fail")
        reason = (
            F.when(vague, F.concat(F.lit("年級條件語意仍需人工確認："), v))
            .when(shut & fits, "目前年級未落入公告排除範圍。")
            .when(shut, "目前年級屬於公告明確排除範圍。")
            .when(fits, "年級條件符合公告。")
            .otherwise("目前年級不在公告允許範圍。")
        )
        return F.struct(F.when(shut & ~vague, "year_exclusion").otherwise("year").alias("field"), v.alias("requirement"), status.alias("status"), reason.alias("reason"))

    return F.transform(_list(req["year_requirements"]), one)


def _exclusions(req: Column, who: Column) -> Column:
    text = lambda name: F.when(F.coalesce(who[name], F.lit("")) != "", who[name])

    def one(v: Column) -> Column:
        # the first subject that an entry names: what is known of it, its label, the question if nothing is
        subjects = [
            (contains_any(v, FRESH), F.coalesce((who["degree_level"] == "學士") & (who["year"] == 1), F.lit(False)), "目前年級", ""),
            (v.contains("休學"), text("enrollment_status").contains("休學"), "目前學籍", "目前是否為休學狀態"),
            (v.contains("延畢"), text("enrollment_status").contains("延畢"), "目前學籍", "目前是否為延畢狀態"),
            (v.contains("學分班"), F.coalesce(who["program_type"].contains("學分班"), F.lit(False)), "目前學制", ""),
            (v.contains("空中大學"), F.coalesce(who["school"].contains("空中大學"), F.lit(False)), "目前學校", ""),
            (contains_any(v, TWICE), who["has_received_similar_scholarship"], "重複領取條件", "本學年是否已獲其他單位獎學金"),
        ]
        status, reason = F.lit("unknown"), F.concat(F.lit("明確排除條件仍需人工確認："), v)
        for named, known, label, question in reversed(subjects):
            status = F.when(named, F.when(known.isNull(), "manual").when(known, "fail").otherwise("pass")).otherwise(status)
            said = F.when(known.isNull(), f"請自行確認：{question}。").when(known, f"{label}命中公告排除條件。").otherwise(f"{label}未命中公告排除條件。")
            reason = F.when(named, said).otherwise(reason)
        return _condition("explicit_exclusion", v, status, reason)

    return F.transform(_list(req["explicit_exclusions"]), one)


def _others(req: Column, who: Column, checks) -> Column:
    def one(v: Column) -> Column:
        failed, letter = who["has_failed_courses"], who["can_obtain_recommendation"]
        courses = v.contains("不及格科目") | v.contains("無不及格")
        known = F.when(courses, "failed_courses").when(v.contains("推薦") & letter.isNotNull(), "recommendation")
        state = F.when(courses, ~failed).otherwise(letter)
        field = F.when(courses & failed.isNull(), "other_manual").otherwise(known)
        status = F.when(state.isNull(), "manual").when(state, "pass").otherwise("fail")
        said = (
            F.when(state.isNull(), "請自行確認：是否有不及格科目。")
            .when(courses, F.when(state, "無不及格科目條件符合。").otherwise("目前有不及格科目。"))
            .otherwise(F.when(state, "可取得所需推薦。").otherwise("無法取得公告要求的推薦。"))
        )
        settled = F.array(F.struct(field.alias("field"), v.alias("requirement"), status.alias("status"), said.alias("reason")))
        asked = F.transform(checks(v), lambda c: _condition("other_manual", v, F.lit("manual"), c))
        open_ = F.array(_condition("other_required", v, F.lit("unknown"), F.concat(F.lit("其他必要條件仍需人工確認："), v)))
        return F.when(known.isNotNull(), settled).when(F.size(asked) > 0, asked).otherwise(open_)

    return F.flatten(F.transform(_list(req["other_required_conditions"]), one))


def conditions(req: Column, who: Column, checks) -> Column:
    """The matrix: ``field, requirement, status, reason`` of every condition, with
    status ``pass``, ``fail``, ``unknown`` or ``manual``.  ``checks`` gives the
    things that a person has to check in a free requirement."""
    families = [_program(req, who), _degree(req, who), _department(req, who), _statuses(req, who), _to_check(req), _residence(req, who), _year(req, who), _exclusions(req, who), _others(req, who, checks)]
    return F.concat(*[F.coalesce(f.cast(CONDITION), F.array().cast(CONDITION)) for f in families])


def decide(req: Column, matrix: Column) -> Column:
    """``status, reasons, manual_checks, review_kind`` over a matrix: any failure,
    else any unknown, else an incomplete document, else no proof is against it."""

    def reasons(status: str) -> Column:
        return F.array_distinct(F.transform(F.filter(matrix, lambda c: c["status"] == status), lambda c: c["reason"]))

    failed, unknown, passed = reasons("fail"), reasons("unknown"), reasons("pass")
    whole = (req["document_type"] == "scholarship_rules") & req["criteria_complete"] & ~req["needs_more_pages"] & (F.size(req["evidence"]) > 0)
    partial = ~F.coalesce(whole, F.lit(False))
    status = cascade([(F.size(failed) > 0, "ineligible"), (F.size(unknown) > 0, "review"), (partial, "review"), (F.size(passed) == 0, "review")], "eligible")
    why = F.when(F.size(failed) > 0, failed).when(F.size(unknown) > 0, unknown).when(partial, F.array(F.lit(INCOMPLETE))).when(F.size(passed) == 0, F.array(F.lit(UNPROVEN))).otherwise(passed)
    said = F.array_join(unknown, "｜")
    kind = F.when(F.size(unknown) == 0, "source_incomplete").otherwise(cascade([(contains_any(said, ["不完整", "證據", "辦法", "附件"]), "source_incomplete"), (contains_any(said, ["profile", "缺少"]), "profile_missing")], "semantic_ambiguous"))
    return F.struct(status.alias("status"), why.alias("reasons"), reasons("manual").alias("manual_checks"), F.when(status == "review", kind).alias("review_kind"))


def supported(req: Column, name: str) -> Column:
    """Entries of a list that the quoted evidence bears out, white space and
    marks at their ends aside."""
    bare = lambda v: F.regexp_replace(v, r"(?U)\s+", "")
    core = lambda v: F.regexp_replace(bare(v), "^[。；;，,：:]+|[。；;，,：:]+$", "")
    quoted = F.coalesce(F.transform(req["evidence"], lambda e: bare(e["text"])), F.array().cast("array<string>"))
    return F.filter(_list(req[name]), lambda v: (core(v) != "") & _any(quoted, lambda q: q.contains(core(v))))


# Lists that may be relied on entry by entry, with their sentence.
PARTIAL = {"required_special_statuses": "申請資格限於", "program_types_excluded": "不包括", "departments_excluded": "不包括相關科系：", "explicit_exclusions": "不包括"}


def usable(req: Column) -> Column:
    """``scope`` and ``text`` of what may be relied on: all rules of a complete
    document, else the limits borne out by evidence, else nothing."""
    quoted = F.size(req["evidence"]) > 0
    whole = F.coalesce((req["document_type"] == "scholarship_rules") & req["criteria_complete"] & ~req["needs_more_pages"] & quoted, F.lit(False))

    def each(name: str, before: str) -> Column:
        return F.transform(supported(req, name), lambda v: F.concat(F.lit(before), v))

    limits = F.array_distinct(F.concat(*[each(name, before) for name, before in PARTIAL.items()]))
    some = F.coalesce(req["document_type"].isin("scholarship_rules", "other") & quoted, F.lit(False)) & (F.size(limits) > 0)
    scope = cascade([(whole, "complete"), (some, "partial_exclusions")], "none")
    return F.struct(scope.alias("scope"), F.when(whole, rule_text(req)).when(some, F.concat(F.array_join(limits, "。"), F.lit("。"))).alias("text"))


def veto(by_rules: Column, by_structure: Column) -> Column:
    """Only a structured ``ineligible`` overrides; a null one never does."""
    return F.when(by_structure == "ineligible", by_structure).otherwise(by_rules)


def hard_conflict(by_rules: Column, by_structure: Column, final: Column) -> Column:
    """One says eligible and the other ineligible, and no veto settled it."""
    pair = F.array_sort(F.array(by_rules, by_structure))
    against = F.coalesce(pair == F.array(F.lit("eligible"), F.lit("ineligible")), F.lit(False))
    return against & ~F.coalesce(final == "ineligible", F.lit(False))
