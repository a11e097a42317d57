"""Application periods read from free text.

Dates count only in parts of a text that speak of an applicant's act and of a
limit.  Defined results: a null text has no dates; a null or odd publication
date is unknown; impossible dates are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.logic import calendar_date, cascade
from ..functions.text import contains_any

# The markers and patterns of the domain.
ACTIONS = "申請 申辦 報名 受理 收件 繳交 交至 寄至 寄送 送件 上傳 登錄 完成 填寫".split()
LIMITS = "截止 期限 期間 前 至 止 逾期 郵戳".split()
DIRECT = "請於 申請期間 申請時間 申請期限 申請截止 報名期間 報名時間 報名截止 受理期間 收件期間 收件截止 受理截止 完成申請 完成網路報名 線上申請 系統申請 系統報名 上網登錄 自行寄 交至 寄至 上傳".split()
OTHER_TIMES = "職涯輔導時間 輔導時間 活動時間 活動期間 執行期間 服務期間 課程日期 課程時間 上課時間".split()
OFFICE = "校方覆核 學校覆核 函送 彙送 審查期限 核定日期".split()
EVERGREEN = "全年受理 常年受理 全年皆可申請 隨時申請 隨到隨審 長期受理 無申請期限".split()
STALE_DAYS = 180
DATE = r"(?:(20\d{2}|\d{3})(?:年|[\-/.]))?(\d{1,2})(?:月|[\-/.])(\d{1,2})日?"
TOKEN = r"(?:(?:20\d{2}|\d{3})(?:年|[\-/.]))?\d{1,2}(?:月|[\-/.])\d{1,2}日?"
EXPLICIT = [
    rf"於\s*{TOKEN}\s*前.{{0,16}}(?:登錄|申請|送件|繳交|完成)",
    rf"(?:收件|系統|受理).{{0,8}}(?:截止|開放至).{{0,8}}{TOKEN}",
    rf"即日起.{{0,16}}至\s*{TOKEN}\s*(?:止|截止)",
    rf"{TOKEN}.{{0,12}}郵戳為憑",
]
CYCLE = r"(?<!\d)(20\d{2}|1\d{2})\s*(?:學年度|年度)"
FIELD = r"(?:本次)?(?:申請|報名|受理|收件|繳交|職涯輔導|輔導|活動|執行|服務|課程)(?:時間|期間|期限|截止|日期)"


def let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def segments(text: Column) -> Column:
    """The parts of a text by sentence ends and before time fields."""
    parts = F.split(F.regexp_replace(text, f"(?={FIELD})", "\n"), r"[。；;\n]")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def of_applicants(segment: Column) -> Column:
    """Whether a part speaks of an applicant's act and its limit."""
    office = contains_any(segment, OFFICE)
    return ~contains_any(segment, OTHER_TIMES) & contains_any(segment, ACTIONS) & contains_any(segment, LIMITS) & (~office | contains_any(segment, DIRECT))


def published_day(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def _this_cycle(days: Column, published: Column, day=lambda x: x) -> Column:
    """Those of the publication's year or later, if there are any."""

    def kept(all_days: Column) -> Column:
        later = F.filter(all_days, lambda d: F.year(day(d)) >= F.year(published))
        return let(later, lambda some: F.when(published.isNotNull() & (F.size(some) > 0), some).otherwise(all_days))

    return let(days, kept)


def dates(segment: Column, published: Column) -> Column:
    """All dates of a part: years of three digits count from 1911, missing ones
    follow the publication."""
    found = [F.regexp_extract_all(segment, F.lit(DATE), F.lit(k)) for k in (1, 2, 3)]
    parsed = F.transform(F.arrays_zip(*[f.alias(n) for f, n in zip(found, "ymd", strict=True)]), lambda x: calendar_date(x["y"], x["m"], x["d"], published))
    return _this_cycle(F.filter(parsed, lambda d: d.isNotNull()), published)


def deadline(text: Column, published: Column) -> Column:
    """The earliest limit of the most direct parts; of a span its end."""
    ranked = F.struct(F.lit(0).alias("rank"), F.lit(None).cast("date").alias("day"))
    none = F.filter(F.array(ranked), lambda x: F.lit(False))

    def limits(parts: Column, rank) -> Column:
        return F.transform(parts, lambda s: F.struct(rank(s).cast("int").alias("rank"), F.array_max(dates(s, published)).alias("day")))

    found = [limits(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), lambda s: F.lit(0)) for p in EXPLICIT]
    found.append(limits(F.filter(segments(text), of_applicants), lambda s: F.when(contains_any(s, DIRECT), 0).otherwise(1)))
    days = F.filter(F.concat(none, *found), lambda x: x["day"].isNotNull())
    return F.array_min(_this_cycle(days, published, lambda x: x["day"]))["day"]


def start(text: Column, published: Column) -> Column:
    """The earliest start of a span of two dates or more."""
    spans = F.transform(F.filter(segments(text), of_applicants), lambda s: dates(s, published))
    return F.array_min(F.transform(F.filter(spans, lambda d: F.size(d) >= 2), F.array_min))


def cycle_years(text: Column) -> Column:
    """Years of named cycles."""
    years = F.transform(F.regexp_extract_all(text, F.lit(CYCLE), F.lit(1)), lambda y: y.cast("int"))
    return F.transform(years, lambda y: F.when(y < 1000, y + 1911).otherwise(y))


def yearless(text: Column) -> Column:
    """Whether an applicant's part has a date without a year."""
    open_ = lambda s: F.exists(F.regexp_extract_all(s, F.lit(DATE), F.lit(1)), lambda y: y == "")
    return F.exists(segments(text), lambda s: of_applicants(s) & open_(s))


def application_period(text: Column, published: Column, as_of: Column) -> Column:
    """A struct: start, deadline and status on a day."""
    text, published, as_of = F.coalesce(text, F.lit("")), published_day(published), as_of.cast("date")
    found = F.struct(start(text, published).alias("begin"), deadline(text, published).alias("end"), cycle_years(text).alias("cycles"))
    return let(found, lambda x: _period(text, published, as_of, x["begin"], x["end"], x["cycles"]))


def _period(text: Column, published: Column, as_of: Column, begin: Column, end: Column, cycles: Column) -> Column:
    this_year, minguo = F.year(as_of).cast("string"), (F.year(as_of) - 1911).cast("string")
    current = F.contains(text, this_year) | F.contains(text, F.concat(minguo, F.lit("年"))) | F.contains(text, F.concat(minguo, F.lit("學年度")))
    status = cascade(
        [
            (end < as_of, "expired"),
            (begin > as_of, "upcoming"),
            (end.isNotNull(), "open"),
            (F.array_max(cycles) < F.year(as_of), "stale_unknown"),
            (contains_any(text, EVERGREEN), "evergreen"),
            (published.isNull() & ~F.array_contains(cycles, F.year(as_of)) & yearless(text), "stale_unknown"),
            ((F.date_diff(as_of, published) > STALE_DAYS) & ~current, "stale_unknown"),
        ],
        "deadline_unknown",
    )
    return F.struct(begin.alias("start"), F.when(status.isin("expired", "upcoming", "open"), end).alias("deadline"), status.alias("status"))


def deadline_exclusions(period: Column) -> Column:
    """Why a notice is past, if it is."""
    past = F.concat(F.lit("申請截止日 "), F.date_format(period["deadline"], "yyyy-MM-dd"), F.lit(" 已過，不推播。"))
    reasons = F.array(F.when(period["status"] == "expired", past), F.when(period["status"] == "stale_unknown", F.lit("公告發布時間已久且無當年度申請證據，列為歷史期限未知。")))
    return F.filter(reasons, lambda r: r.isNotNull())
