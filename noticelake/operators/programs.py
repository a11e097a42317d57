"""Programs and their sources: names that can be compared, search queries, what
pages showed of each program, and the state that follows.

Defined results: null texts are empty, null counts zero.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.logic import cascade, weighted
from ..functions.text import contains_any, host
from .identity import folded
from .notices import match_score, source_role
from .rows import best_of

# What changes from year to year in a name, and words of one meaning.
YEARS = [r"(?:19|20)\d{2}\s*年?", r"(?:民國\s*)?1\d{2}\s*年", r"第\s*[一二三四五六七八九十百零〇兩\d]+\s*屆"]
PREFIXES = ["轉知", "公告", "申請公告", "開始受理", "開放申請", "獎學金公告"]
SAME = [("大專院校", "大專校院"), ("臺北", "台北"), ("獎助金", "獎助學金"), ("獎勵學金", "獎學金")]
# Kinds of address.
MONITORED = ["url_list", "url_evergreen", "url_annual_detail", "url_relay_list", "url_relay_detail", "url_homepage"]
DIRECT = ["url_evergreen", "url_annual_detail", "url_relay_detail"]
LISTS = ["url_list", "url_relay_list", "url_homepage"]
DETAIL_MARKS = ["/p/404-", "/p/406-", "news_detail", "news_content", "announcement.php?aid=", "/posts/"]
# The state of a source before it is asked.
BEFORE = {
    "url_core_covered": ("core_covered", "已由六個核心來源監測，不重複請求。"),
    "url_application_portal": ("application_portal", "申請系統只作送件入口，不作公告發現來源。"),
    "url_wrong": ("wrong_source", "入口與目標方案無關，禁止產生正式候選。"),
    "url_pending": ("pending_source", "尚無可靠官方或正式機構轉載入口。"),
}
ACCEPTED = ["matched", "no_current_announcement"]
# Scores of a match, and words of a candidate page.
LEAST, MARGIN, SHORTEST = 80, 15, 4
RULE_WORDS = ["簡章", "辦法", "申請資格", "資格", "申請須知"]
LOGIN_WORDS = ["login", "signin", "apply", "報名系統", "登入"]


# Required, optional and forbidden words of each program.
TERMS = {
    "tf4dr-aid": ("賑災 助學", "基金會 獎助學金", ""),
    "foxconn-scholarship-whale": ("獎學鯨", "鴻海 教育基金會", ""),
    "avc-talented-student": ("資優學生", "奇鋐 獎學金", ""),
    "cfh-graduate": ("研究所", "鄭豐喜 獎學金", "大學獎學金 肢障 家庭子女"),
    "cfh-university": ("大學", "鄭豐喜 獎學金", "研究所 肢障 家庭子女"),
    "kumota-flying": ("乘風飛揚", "雲田 獎助學金", ""),
    "lijin-taoyuan": ("利晉 清寒", "桃園 助學金", ""),
    "tcb-foundation": ("台中商", "銀行 文教基金會 獎學金", ""),
    "tainan-kaiji": ("臺疆祖廟", "清寒 優秀 獎學金", ""),
    "songliang-aid": ("松樑", "助學金 教育公益", ""),
    "wang-yun-wu-self-study": ("自學獎學金", "王雲五 基金會", ""),
    "rehe-association": ("熱河同鄉會", "台北 獎助學金", ""),
    "wisdomshare-service-learning": ("青力親為", "千萬祝福 服務學習 獎勵計畫", ""),
    "hsinrong-emergency-aid": ("欣榮 急難救助", "助學金", ""),
    "it-social-care": ("資訊人 社會關懷", "獎學金", ""),
    "you-care-hand-in-hand": ("大手拉小手", "助學計畫 普仁", ""),
    "chiu-filial-piety": ("清寒 孝親", "績優 獎助學金", ""),
    "buddha-charity-progress": ("清寒學生 進步", "誌善 獎學金", ""),
    "yonglin-hope": ("銘日希望", "永齡 獎助學金", ""),
    "cdf-vocational": ("技藝職能", "中華開發 獎學金", ""),
    "ht-emergency": ("急難濟助", "行天宮", "資優學生 長期獎助學金 行天宮助學金"),
    "ht-talented-long-term": ("資優學生", "行天宮 長期 獎助學金", "急難濟助"),
    "ht-student-aid": ("助學金", "行天宮", "資優學生 急難濟助"),
    "cht-fang-hsien-chi": ("方賢齊", "中華電信 獎學金", ""),
    "heart-child": ("心臟病童", "獎勵學金 獎學金", ""),
    "sunshine-scholarship": ("陽光 獎學金", "獎助學金", "萬足"),
    "sunshine-wanzu": ("萬足", "燒傷 勞工子女 大專生 獎助學金", "陽光獎學金"),
    "cfh-disabled-family": ("肢障 家庭子女", "鄭豐喜 獎學金", "研究所獎學金 大學獎學金"),
    "lovepeace-disadvantaged": ("祥和 清寒", "優秀 獎學金", ""),
    "dapeng-aid": ("大鵬", "科技慈善 獎助學金", ""),
    "hndasset-wenxiang": ("文向獎學金", "教育基金會", ""),
    "cy-arch-aid": ("昌益", "慈善基金會 獎助學金", ""),
    "lihpao-fullon": ("麗寶 福容", "獎助學金", ""),
    "gfc-scholarship": ("崇友", "實業 獎學金", ""),
    "auden-innovation-research": ("創新 研究", "耀登 炳南 研究獎", "大專校院優秀人才 優秀人才獎學金"),
    "auden-university-talent": ("大專 優秀人才", "耀登 炳南 獎學金", "創新研究 研究獎"),
    "harmony-stability": ("和諧安定", "獎學金", ""),
    "taishin-youth-volunteer": ("青少年志工 菁英獎", "台新 獎助學金", ""),
}


@dataclass(frozen=True)
class Program:
    """What a program is called, who gives it, and the words that tell it from others."""

    name: str
    aliases: tuple[str, ...]
    organizer: str = ""
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


def comparable(text: Column) -> Column:
    """A name without years, sessions, common prefixes, spaces and signs, in words of
    one spelling."""
    value = folded(F.coalesce(text, F.lit("")))
    for pattern in YEARS:
        value = F.regexp_replace(value, pattern, "")
    for old, new in [*((p, "") for p in PREFIXES), *SAME]:
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.regexp_replace(value, r"[^\p{L}\p{N}]+", "")


def known_program(name: str, aliases: tuple[str, ...], organizer: str = "") -> Program:
    """A program with the words that are known of it."""
    return Program(name, aliases, organizer, *(tuple(x.split()) for x in TERMS.get(name, ("", "", ""))))


def bare(text: Column) -> Column:
    """A text without case, spaces and signs."""
    return F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def plain_name(text: str) -> tuple[str, str]:
    """:func:`bare` and :func:`comparable` of a name in a rule."""
    value = whole = unicodedata.normalize("NFKC", text).casefold()
    for pattern in YEARS:
        value = re.sub(pattern, "", value)
    for old, new in [*((p, "") for p in PREFIXES), *SAME]:
        value = value.replace(old, new)
    return tuple("".join(c for c in x if c.isalnum()) for x in (whole, value))


def matched(rows: DataFrame, text: str, programs: list[Program], into: str = "match") -> DataFrame:
    """``rows`` with a struct ``into``: the program that a text is about, its score, the
    runner-up and whether that is near, among programs that compete.  Only a name or
    all required words give a score; optional words, and an organiser that all
    programs share, add to it, and forbidden words take from it."""
    whole, named = f"{into}_bare", f"{into}_comparable"
    rows = rows.withColumns({whole: bare(F.col(text)), named: comparable(F.col(text))})
    one = len({p.organizer for p in programs}) == 1 and bool(programs[0].organizer)

    def holds(column: str, names: list[str]) -> Column:
        return contains_any(F.col(column), [n for n in names if n])

    def score(p: Program) -> Column:
        count = lambda words: sum((F.when(F.contains(named, F.lit(plain_name(w)[1])), 1).otherwise(0) for w in words), F.lit(0))
        exact = [x for x, _ in map(plain_name, p.aliases) if len(x) >= SHORTEST]
        alike = [y for _, y in map(plain_name, p.aliases) if len(y) >= SHORTEST]
        core = count(p.required) == len(p.required) if p.required else F.lit(False)
        return match_score(holds(whole, exact), holds(named, alike), core, count(p.optional), count(p.forbidden), F.lit(one))

    found = best_of({p.name: score(p) for p in programs}, LEAST, MARGIN)
    return rows.withColumn(into, found).drop(whole, named)


def ranked_candidates(hits: DataFrame, key: str, title: str, organizer: str, aliases: list[str], official: list[str], year: int) -> DataFrame:
    """Search hits (``key``, ``url``, ``title``, ``snippet``, ``published``) with ``role``,
    ``score`` and ``reasons`` by host, name, organiser, year and kind of page, and their
    ``rank`` for each key: by score, then by address."""
    said = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "snippet", "published")])
    rows = hits.withColumn("said", bare(said))
    role, score = source_role(host(F.col("url")), official)
    who = cascade([(role == "official", "官方主辦單位網域"), (role == "government", "政府機關正式來源"), (role == "school", "學校正式轉載")], "尚未驗證來源身分")
    names = [(n, plain_name(n)[0]) for n in dict.fromkeys([title, *aliases])]
    name = F.coalesce(*[F.when(F.contains("said", F.lit(x)), F.lit(f"方案名稱命中：{n}")) for n, x in names])
    years = F.transform(F.regexp_extract_all("said", F.lit(r"(?<!\d)(20\d{2}|1\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    now = F.array_contains(years, year) | F.array_contains(years, year - 1911)
    address = F.lower("url")
    giver = plain_name(organizer)[0]
    points = [
        (name.isNotNull(), 35, name),
        (F.contains("said", F.lit(giver)) if giver else F.lit(False), 30, F.lit("主辦單位名稱命中")),
        (now, 25, F.lit("當年度訊號命中")),
        (~now & (F.size(years) > 0), -30, F.lit("僅命中其他年度")),
        (contains_any(F.col("said"), RULE_WORDS), 15, F.lit("含辦法或資格訊號")),
        (address.endswith(".pdf"), 10, F.lit("直接 PDF 文件")),
        (contains_any(address, LOGIN_WORDS) | contains_any(F.col("said"), LOGIN_WORDS), -40, F.lit("疑似僅為申請登入入口")),
    ]
    total = score + weighted([(c, n) for c, n, _ in points])
    reasons = F.filter(F.array(who, *[F.when(c, r) for c, _, r in points]), lambda r: r.isNotNull())
    rows = rows.select(key, "url", role.alias("role"), total.cast("int").alias("score"), reasons.alias("reasons"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "url")))


def search_queries(title: Column, organizer: Column, aliases: Column, year: int) -> Column:
    """Search terms for a program: by up to three names, then by site and kind of file."""
    own, roc = F.coalesce(title, F.lit("")), str(year - 1911)
    names = F.slice(F.array_distinct(F.concat(F.array(own), F.coalesce(aliases, F.array().cast("array<string>")))), 1, 3)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rest = [
        F.concat(quoted(own), F.lit(f" {year} PDF")),
        F.concat(quoted(F.coalesce(organizer, F.lit(""))), F.lit(" "), quoted(own)),
        *[F.concat(F.lit(f"site:{site} "), quoted(own), F.lit(f" {roc}")) for site in ("edu.tw", "gov.tw")],
        F.concat(quoted(own), F.lit(" 簡章 資格 附件")),
    ]
    return F.array_distinct(F.concat(F.transform(names, lambda n: F.concat(quoted(n), F.lit(f" {roc} 申請辦法"))), F.array(*rest)))


def url_type(url: Column, host: Column, given: Column) -> Column:
    """The kind of an address that is tried in place of another."""
    relay = host.endswith("edu.tw") | host.endswith("gov.tw")
    return F.when(contains_any(url, DETAIL_MARKS), F.when(relay, "url_relay_detail").otherwise("url_annual_detail")).otherwise(given)


def discovered_type(role: Column) -> Column:
    """The kind of an address that a search found, by its host's role."""
    return cascade([(role.isin("government", "school"), "url_relay_detail"), (role == "official", "url_annual_detail")], "url_pending")


def observations(rows: DataFrame, *keys: str) -> DataFrame:
    """What pages showed of a program, rolled up by ``keys``: candidates and ambiguous
    ones are added, and the best score keeps its runner-up and how it was found (of
    equal scores the earliest page's, by ``page``)."""
    best = F.max_by(F.struct("top_score", "second_score", "method", "competing"), F.struct("top_score", -F.col("page"))).alias("best")
    return rows.groupBy(*keys).agg(F.sum("raw").alias("raw"), F.sum("ambiguous").alias("ambiguous"), best).select(*keys, "raw", "ambiguous", "best.*")


def program_state(kind: Column, pages: Column, errors: Column, matched: Column, ambiguous: Column, top: Column, second: Column, method: Column, competing: Column, links: Column, generic: Column, siblings: Column, completeness: Column, stop: Column) -> Column:
    """A struct of ``status`` and ``reason``: the first stage that a program's crawl
    did not get past."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    n = lambda c: F.coalesce(c, F.lit(0))
    blocked = [(kind == k, *BEFORE[k]) for k in ("url_application_portal", "url_wrong")]
    failed = F.when(text(errors) != "", errors).otherwise("入口頁未成功下載。")
    close = F.concat(F.lit("候選無法唯一區分；最高 "), text(n(top)), F.lit("，次高 "), text(n(second)), F.lit("，競爭方案 "), F.when(text(competing) != "", competing).otherwise("未知"), F.lit("。"))
    low = F.concat(F.lit("候選最高分 "), text(n(top)), F.lit(" 未達唯一匹配條件；方法 "), text(method), F.lit("。"))
    others = F.concat(F.lit("找到 "), text(n(generic)), F.lit(" 個一般獎助候選，但沒有命中本方案規則。"))
    stages = [
        (n(matched) > 0, "matched", F.lit("已找到唯一方案候選，將進入正文與公告分類。")),
        (n(ambiguous) > 0, "match_ambiguous", close),
        (n(top) > 0, "matcher_miss", low),
        (kind.isin(LISTS) & (n(links) == 0), "source_structure_changed", F.lit("入口可讀，但找不到可供年度公告發現的連結結構。")),
        ((n(siblings) == 1) & (n(generic) > 0), "matcher_miss", others),
        (F.lit(True), "no_current_announcement", F.lit("入口與結構正常，本次未找到可確認的當年度方案公告。")),
    ]
    part = F.when(completeness == "partial", F.concat(F.lit(" 分頁部分完成："), text(stop), F.lit("。"))).otherwise("")
    out = F.struct(F.lit("").alias("status"), F.lit("").alias("reason"))
    for condition, status, reason in reversed(stages):
        out = F.when(condition, F.struct(F.lit(status).alias("status"), F.concat(reason, part).alias("reason"))).otherwise(out)
    out = F.when(n(pages) == 0, F.struct(F.lit("fetch_failed").alias("status"), failed.alias("reason"))).otherwise(out)
    for condition, status, reason in reversed(blocked):
        out = F.when(condition, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def replaced_entry(urls: list[Column], original: Column, preferred: Column) -> Column:
    """Whether a row points back at an entry that preferred ones replace."""

    def address(url: Column) -> Column:
        head, rest = F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
        path = F.regexp_replace(rest, "/+$", "")
        return F.concat(head, F.when(path == "", "/").otherwise(path))

    own = address(original)
    points = F.lit(False)
    for url in urls:
        points = points | ((F.coalesce(url, F.lit("")) != "") & (address(url) == own))
    known = (F.coalesce(original, F.lit("")) != "") & (F.size(F.coalesce(preferred, F.array().cast("array<string>"))) > 0)
    return F.coalesce(known & ~F.exists(preferred, lambda p: address(p) == own) & points, F.lit(False))


def scanned_document(documents: Column) -> Column:
    """The first scanned PDF that failed, rules before unknown and unrelated ones."""
    found = F.filter(documents, lambda d: (d["status"] == "error") & (d["kind"] == "pdf") & contains_any(F.coalesce(d["error"], F.lit("")), ["沒有可擷取文字", "掃描檔"]))
    first = lambda role: F.get(F.filter(found, lambda d: d["role"] == role), F.lit(0))
    return F.coalesce(*map(first, ("rules", "unknown", "unrelated")))


def year_hint(title: Column) -> Column:
    """The first day of the year that a title names; empty if none."""
    roc, full = F.regexp_extract(title, r"(?<!\d)(1\d{2})年", 1), F.regexp_extract(title, r"(?<!\d)(20\d{2})(?!\d)", 1)
    year = F.when(roc != "", (roc.try_cast("int") + 1911).cast("string")).when(full != "", full)
    return F.coalesce(F.concat(year, F.lit("-01-01")), F.lit(""))


def contract(states: DataFrame, expected: int) -> DataFrame:
    """One row: how many programs are in an accepted state, which are not, and
    whether all that are expected are."""
    ok = F.col("status").isin(ACCEPTED)
    out = states.agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.array_sort(F.collect_list(F.when(~F.coalesce(ok, F.lit(False)), F.col("program_id")))).alias("failed"))
    return out.withColumn("passed", (F.size("failed") == 0) & (F.col("total") == expected))


def byte_size(size: Column, largest: str = "MiB") -> Column:
    """Bytes as people read them, in units up to the ``largest`` (KiB or MiB)."""
    shown = lambda n, unit: F.format_string(f"%.1f {unit}", F.bround(size / n, 1))
    less = size < 1 << 20 if largest == "MiB" else F.lit(True)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(less, shown(1024, "KiB")).otherwise(shown(1 << 20, "MiB"))


def resource_line(status: Column, kind: Column, content_type: Column, size: Column, length: Column, fallback: Column, largest: str = "MiB") -> Column:
    """One resource on a line; ``largest`` as in :func:`byte_size`."""
    said = F.when(F.coalesce(content_type, F.lit("")) != "", content_type).otherwise("unknown")
    text = F.concat(F.lit("文字 "), F.coalesce(length, F.lit(0)).cast("string"), F.lit(" 字"), F.when(fallback, " | SSL 相容重試").otherwise(""))
    return F.concat_ws(" | ", status, kind, said, byte_size(size, largest), text)
