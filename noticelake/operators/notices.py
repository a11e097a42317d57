"""Announcement rules: kind, evidence, action, matching, health.

Vocabularies are data: a pack of marker lists.  ``CJK`` is the domain's, and
``LATIN`` one of the same form for the driver's tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.logic import cascade, weighted
from ..functions.text import contains_any

# The marker lists of the domain.
CJK = {
    "result": "獲獎名單 錄取名單 得獎名單 核定名單 結果公告 得獎公告 獲獎公告 審核結果 審查結果 頒發名單 正取名單 備取名單".split(),
    "policy": "修正 修訂 條文 法規 作業要點 函送 廢止 不適用".split(),
    "application": "申請公告 受理申請 開放申請 開始申請 申辦公告 申請資格 申請對象 申請期間 申請方式 截止日期 檢附文件 徵件 報名".split(),
    "information": "說明會 注意事項 相關事宜 宣導 提醒 常見問題 問答集 FAQ".split(),
    "award": "獎學金 助學金 獎助學金 獎助金 助學計畫 獎勵學金 濟助 補助".split(),
    "contract_context": "甄試簡章 甄選簡章 申請簡章 申請公告 受理申請 開放申請 徵件 報名".split(),
}
LATIN = {
    "result": ["idiot", "clown"],
    "policy": ["Licensed under", "license", "©"],
    "application": ["http", "www.", "@"],
    "information": ["***", "$$$", "|"],
    "award": ["the", "der", "les", "ción"],
    "contract_context": ["http"],
}
# Patterns of the domain's titles and openings, in order of precedence.
CALENDAR = ["作息|行事曆|辦公時間|暑假|寒假"]
CONVERSION = ["換算表", "名額.{0,12}換算", "排名.{0,12}換算"]
PROCESS = ["申辦流程|申請流程|作業流程|流程圖|說明會|座談會|宣導"]
EXPECTED = ["(?:將於|預計).{0,24}(?:公布|公告|上線)", "尚未公布"]
CONTRACT = ["(?:行政)?契約書"]
# Weighted groups of evidence markers.
CJK_EVIDENCE = [
    ("申請資格 申請對象 申請人資格 申請條件 資格條件 適用對象 濟助對象".split(), 2),
    ("申請期間 申請日期 受理期間 報名期間".split(), 2),
    ("截止日期 申請截止 收件截止 報名截止".split(), 2),
    ("申請方式 報名方式 送件方式 申辦方式".split(), 2),
    ("檢附文件 應備文件 繳交文件 申請文件 應備資料".split(), 1),
    ("申請表 線上報名 線上申請 報名表".split(), 1),
    ("獎助金額 獎學金額 補助金額 濟助金額 每名核發".split(), 1),
]
LATIN_EVIDENCE = [(["ing", "heit"], 2), (["tion", "ción"], 2), (["ment"], 2), (["!!"], 2), (["***"], 1), (["http"], 1), (["©", "Licensed"], 1)]


def notice_kind(title: Column, detail: Column, pack: Mapping[str, Sequence[str]], rules: bool = True) -> Column:
    """The kind of a notice; the first rule that holds decides.  With ``rules``
    the patterns of the domain's own language apply as well."""
    has = lambda name, text: contains_any(text, pack[name])
    like = lambda text, patterns: text.rlike("|".join(patterns))
    first: list[tuple[Column, str]] = [(has("result", title), "result")]
    if rules:
        head = F.concat(title, F.lit(" "), F.substring(detail, 1, 200))
        first += [
            (like(head, CALENDAR), "information"),
            (like(head, CONVERSION), "policy"),
            (like(head, PROCESS), "information"),
            (like(title, EXPECTED), "information"),
            (like(title, CONTRACT) & ~has("contract_context", title), "information"),
            (title.endswith("辦法") & ~has("application", title), "policy"),
        ]
    later: list[tuple[Column, str]] = [(has("policy", title), "policy"), (has("information", title), "information")]
    if rules:
        later.append((F.contains(title, F.lit("就學貸款")) & contains_any(title, ["申辦", "申請"]), "loan"))
    later += [
        (has("application", title), "application"),
        (~has("result", detail) & (has("application", detail) | has("award", title)), "application"),
    ]
    return cascade(first + later, "unknown")


def evidence_score(text: Column, groups: Sequence[tuple[Sequence[str], int]], scope: Column, action: Column) -> Column:
    """Weight of the marker groups that occur, 2 for scope, 1 for action."""
    return weighted([(contains_any(text, m), w) for m, w in groups] + [(scope, 2), (action, 1)])


def evidence_status(score: Column, scope: Column, action: Column, source_error: Column | None = None) -> Column:
    rules = [(source_error, "source_error")] if source_error is not None else []
    return cascade([*rules, ((score >= 4) | (scope & action), "valid_application_detail"), (score >= 2, "insufficient_evidence")], "navigation_or_wrong_page")


def action_status(eligibility: Column, evidence: Column, kind: Column, period: Column) -> Column:
    """What to do about a notice, from its four axes."""
    complete = evidence == "valid_application_detail"
    return cascade(
        [
            ((kind != "application") | period.isin("expired", "stale_unknown", "not_applicable"), "not_actionable"),
            (eligibility == "ineligible", "reject"),
            (eligibility.isin("eligible", "review") & ~complete, "verify_source"),
            (eligibility == "eligible", "apply_candidate"),
        ],
        "manual_review",
    )


def match_score(alias: Column, equivalent: Column, required: Column, optional_hits: Column, forbidden_hits: Column, single_organizer: Column) -> Column:
    """100 for an alias, 95 for an equivalent one, 60 for all required terms; then
    10 for each optional term, 15 for a single organiser, less 80 for each
    forbidden term; not below 0, and 0 without a base."""
    base = F.when(alias, 100).when(equivalent, 95).when(required, 60).otherwise(0)
    total = base + 10 * optional_hits + F.when(single_organizer, 15).otherwise(0) - 80 * forbidden_hits
    return F.when(base == 0, 0).otherwise(F.greatest(total, F.lit(0))).cast("int")


def source_role(site: Column, official: Sequence[str]) -> tuple[Column, Column]:
    """(role, score) of a host."""
    own = F.lit(False)
    for name in official:
        own = own | (site == name) | site.endswith(f".{name}")
    role = cascade([(own, "official"), (site.endswith(".gov.tw"), "government"), (site.endswith(".edu.tw"), "school")], "other")
    score = F.when(role == "official", 100).when(role == "government", 85).when(role == "school", 75).otherwise(0)
    return role, score


def identity_status(official: Column, relay: Column, program: Column, organizer: Column) -> Column:
    return cascade([(~program, "rejected"), (official | (relay & organizer), "verified"), (relay, "review")], "rejected")


def health_score(complete: Column, partial: Column, pages: Column, rows: Column, children: Column) -> Column:
    """30 for success, 25 or 10 for completeness, then shares of pages (20), rows
    (15) and children (10); rounded half to even and held in 0 to 100."""
    total = 30 + F.when(complete, 25).when(partial, 10).otherwise(0) + 20 * pages + 15 * rows + 10 * children
    return F.least(F.greatest(F.bround(total, 0).cast("int"), F.lit(0)), F.lit(100))


def health_bucket(score: Column) -> Column:
    return cascade([(score >= 85, "healthy"), (score >= 60, "degraded"), (score >= 1, "poor")], "failed")
