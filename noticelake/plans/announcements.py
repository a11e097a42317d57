"""Queries over announcements: identity, keys, categories and periods.

Each runs over a whole table, to which the rule's own cases are added: the
tables' texts are Latin, and the rules' vocabulary is not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import identity, notices, periods
from .queries import _table, _title, query


def with_cases(table, cases: list[tuple], schema: str):
    """``table`` and its cases, as rows of one schema."""
    return table.unionByName(table.sparkSession.createDataFrame(cases, schema))


def values(rows: list[tuple]) -> str:
    """Rows as SQL."""

    def cell(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


URLS = [
    (-1, "HTTPS://School.EDU.tw//news///1/?utm_source=line&b=2&a=1#top", "https://school.edu.tw/news/1?a=1&b=2"),
    (-2, "https://school.edu.tw/news/1?ref=home&fbclid=x", "https://school.edu.tw/news/1?ref=home"),
    (-3, "/news/1", "/news/1"),
    (-4, "/news/2/", "/news/2"),
    (-5, "https://a.tw/?t=%E7%8D%8E", "https://a.tw/?t=%E7%8D%8E"),
    (-6, "https://a.tw?t=獎", "https://a.tw/?t=%E7%8D%8E"),
    (-7, "https://a.tw/x?b&a=1+2&a=1%202", "https://a.tw/x?a=1+2&a=1+2&b="),
    (-8, "", "/"),
    (-9, " https://a.tw/x?t=~*&GCLID=1 ", "https://a.tw/x?t=~%2A"),
]
CANON = r"""
  raw AS (SELECT id, regexp_replace(url, '^\s+|\s+$', '', 'g') AS url FROM u),
  cut AS (
    SELECT id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS r FROM raw
  ), part AS (
    SELECT id, s, lower(regexp_extract(r, '^//([^/?#]*)', 1)) AS h, regexp_replace(regexp_replace(regexp_extract(r, '^(?://[^/?#]*)?([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '') AS p,
      list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''),
        lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=?(.*)$', 1), '+', ' '))}),
        lambda x: lower(x.k) NOT IN ('fbclid', 'gclid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS q
    FROM cut
  ), canon AS (
    SELECT id, CASE WHEN s = '' THEN '' ELSE s || ':' END || CASE WHEN h = '' THEN '' ELSE '//' || h END || CASE WHEN p = '' THEN '/' ELSE p END
      || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(q, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') END AS url
    FROM part
  )
"""


def _addresses(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return with_cases(pages, [r[:2] for r in URLS], "id long, url string")


@query(f"""
WITH u AS (SELECT page_id AS id, url FROM pages), {CANON}
SELECT id AS page_id, url AS canonical_url FROM canon UNION ALL SELECT a, c FROM ({values(URLS)}) t(a, b, c)
""")
def q02_canonical_url(spark, sf_dir):
    """F05 over all pages and the rule's cases."""
    return _addresses(spark, sf_dir).select(F.col("id").alias("page_id"), text.canonical_url(F.col("url")).alias("canonical_url"))


TITLES = [
    (-1, "115學年度就學貸款申辦公告", "loan", "115學年度就學貸款申辦公告"),
    (-2, "【轉知】公告：王雲五獎學金 申請", "scholarship", "王雲五獎學金申請"),
    (-3, "清寒助學金補助辦法", "student_aid", "清寒助學金補助辦法"),
    (-4, "學雜費減免說明", "subsidy", "學雜費減免說明"),
    (-5, "ＡＢＣ 獎助學金", "scholarship", "abc獎助學金"),
    (-6, "獎學金公告", "scholarship", "獎學金公告|2026-07-01"),
    (-7, "函轉有關｜扶助學生計畫", "student_aid", "扶助學生計畫"),
    (-8, "校園活動", "other", "校園活動"),
    (-9, "公告：獎助學金", "scholarship", "獎助學金|2026-07-01"),
    (-10, None, "other", ""),
]


def _titles(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", _title().alias("title"))
    return with_cases(docs, [r[:2] for r in TITLES], "doc_id long, title string")


@query(f"SELECT doc_id, 'other' AS category FROM documents UNION ALL SELECT a, c FROM ({values(TITLES)}) t(a, b, c, d)")
def q04_category_cascade(spark, sf_dir):
    """F04; no title of the tables has a category's words."""
    return _titles(spark, sf_dir).select("doc_id", identity.category(F.col("title")).alias("category"))


@query(rf"""
SELECT doc_id, regexp_replace(replace(regexp_replace(lower(regexp_replace(trim(regexp_extract(text, '^[^\n]*')), '\s+', ' ', 'g')), '^\[[^\]]{{1,24}}\]\s*', ''), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key
FROM documents UNION ALL SELECT a, d FROM ({values(TITLES)}) t(a, b, c, d)
""")
def q08_cross_source_key(spark, sf_dir):
    """F07 over all titles and the rule's cases."""
    return _titles(spark, sf_dir).select("doc_id", identity.cross_source_key(F.col("title"), F.lit("2026-07-01")).alias("key"))


@query(f"""
WITH u AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT a, b FROM ({values(URLS)}) t(a, b, c)), {CANON}, k AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN 'tun-program-p' || id % 3 ELSE 'lhu' END AS source, url FROM canon
)
SELECT id, CASE WHEN source = 'lhu' THEN '' ELSE substr(source, 13) END AS program_id, sha256(source || '|' || CASE WHEN source = 'lhu' THEN url ELSE substr(source, 13) END) AS announcement_id FROM k
""")
def q55_announcement_identity(spark, sf_dir):
    """a program's pages are one announcement, others go by address."""
    source = F.when(F.col("id") % 5 == 0, F.concat(F.lit("tun-program-p"), (F.col("id") % 3).cast("string"))).otherwise("lhu")
    rows = _addresses(spark, sf_dir).select("id", identity.announcement(source, F.lit("t"), F.lit(""), F.col("url")).alias("row"))
    ident = identity.announcement_id(F.col("row.source"), F.col("row.program_id"), F.col("row.detail_url"), F.col("row.source_url"))
    return rows.select("id", "row.program_id", ident.alias("announcement_id"))


@query(r"""
WITH b AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, sha256('id' || E'\n---\n' || 'https://a.tw/n' || E'\n---\n' || t || CASE WHEN doc_id % 3 = 0 THEN E'\n---\nA rule\n---\nB rule' WHEN doc_id % 3 = 1 THEN E'\n---\nB rule' ELSE '' END
  || E'\n---\n' || 'ready' || E'\n---\n' || 'p1' || E'\n---\n' || '') AS revision, doc_id % 3 = 0 AS reordered_equal
FROM b
""")
def q56_revision_hash(spark, sf_dir):
    """stable text and rule attachments in any order; counters don't count."""
    part = lambda text, role="scholarship_rules", status="success": F.struct(F.lit(status).alias("status"), F.lit(role).alias("content_role"), F.lit(text).alias("text"))
    a, b, noise = part("A   rule"), part("B rule\n瀏覽次數：77"), part("form", "application_form")
    files = F.when(F.col("doc_id") % 3 == 0, F.array(b, noise, a)).when(F.col("doc_id") % 3 == 1, F.array(part("  "), b, part("x", status="error"))).otherwise(F.array(noise))
    turned = F.when(F.col("doc_id") % 3 == 0, F.array(a, b))
    body = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, " 瀏覽人次: 12").otherwise(" 最後更新：2026-07-01"))
    revision = lambda of: identity.revision_hash(F.lit("id"), F.lit("https://A.tw/n/?gclid=1"), body, of, F.lit("ready"), F.lit("p1"), F.lit(None).cast("string"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", revision(files).alias("revision"), revision(turned).alias("turned"))
    return rows.select("doc_id", "revision", F.coalesce(F.col("revision") == F.col("turned"), F.lit(False)).alias("reordered_equal"))


PERIODS = [
    (-1, "請於7/24前交至課指組，逾期不受理。", "2026-06-30", "2026-07-28", None, "2026-07-24", "expired"),
    (-2, "申請期間：115/03/10~115/04/20，請至協會網站登錄提出申請。", "2026-03-19", "2026-03-20", "2026-03-10", "2026-04-20", "open"),
    (-3, "申請時間：即日起至額滿為止。職涯輔導時間：115年3月至6月12日止。", "2026-03-05", "2026-03-06", None, None, "deadline_unknown"),
    (-4, "線上申請自115年4月1日至4月20日止。校方覆核至5月22日止。", "2026-03-19", "2026-03-20", "2026-04-01", "2026-04-20", "upcoming"),
    (-5, "申請期間：115/08/03至115/09/11止。", "2026-06-09", "2026-07-28", "2026-08-03", "2026-09-11", "upcoming"),
    (-6, "申請期間：115/07/01至115/09/11止。", "2026-06-09", "2026-07-28", "2026-07-01", "2026-09-11", "open"),
    (-7, "相關資訊請自行下載，並於申請截止日前完成申請。", "2026-07-06", "2026-07-28", None, None, "deadline_unknown"),
    (-8, "相關資訊請自行下載，並於申請截止日前完成申請。", "2025-07-01", "2026-08-01", None, None, "stale_unknown"),
    (-9, "〔114年度｜雲田乘風飛揚獎助學金計畫〕申請辦法請見附件。", "2026-08-01", "2026-08-02", None, None, "stale_unknown"),
    (-10, "115年度獎學金申請辦法請見附件。", "2026-08-01", "2026-08-02", None, None, "deadline_unknown"),
    (-11, "2026年度仍受理申請，詳細期限請見附件。", "2025-07-01", "2026-08-01", None, None, "deadline_unknown"),
    (-12, "本計畫全年受理，申請資格與申請方式如下。", "2024-01-01", "2026-08-01", None, None, "evergreen"),
    (-13, "申請期間10/1至10/31止", "", "2026-08-01", None, None, "stale_unknown"),
    (-14, "請於9月15日前完成申請，10月2日郵戳為憑", "2026-08-01", "2026-08-02", "2026-09-15", "2026-09-15", "upcoming"),
    (-15, "即日起受理至 115年8月9日止", "2026-07-01", "2026-08-02", None, "2026-08-09", "open"),
    (-16, "申請期限2月30日前", "2026-01-01", "2026-01-05", None, None, "deadline_unknown"),
    (-17, "請於1/15前送件申請", "2025-12-20", "2026-01-05", None, "2026-01-15", "open"),
    (-18, None, None, "2026-01-05", None, None, "deadline_unknown"),
]


@query(f"""
WITH o AS (SELECT o_orderkey AS k, (o_orderdate + INTERVAL 300 MONTH)::DATE AS d FROM orders), r AS (
  SELECT k, k % 4 AS v, d, DATE '2020-06-15' AS today,
    CASE WHEN k % 4 = 0 THEN d + 5 END AS s, CASE WHEN k % 4 = 0 THEN d + 40 WHEN k % 4 = 1 THEN d + 21 END AS e FROM o
)
SELECT k AS id, CASE WHEN v = 0 THEN s END AS start, e AS deadline, CASE WHEN e < today THEN 'expired' WHEN s > today THEN 'upcoming' WHEN e IS NOT NULL THEN 'open'
  WHEN v = 2 THEN 'evergreen' WHEN today - d > 180 THEN 'stale_unknown' ELSE 'deadline_unknown' END AS status,
  CASE WHEN e < today THEN ['申請截止日 ' || strftime(e, '%Y-%m-%d') || ' 已過，不推播。'] WHEN v = 3 AND today - d > 180 THEN ['公告發布時間已久且無當年度申請證據，列為歷史期限未知。'] ELSE [] END AS reasons
FROM r
UNION ALL SELECT a, e::DATE, f::DATE, g, CASE g WHEN 'expired' THEN ['申請截止日 ' || f || ' 已過，不推播。'] WHEN 'stale_unknown' THEN ['公告發布時間已久且無當年度申請證據，列為歷史期限未知。'] ELSE [] END
FROM ({values(PERIODS)}) t(a, b, c, d, e, f, g)
""")
def q57_application_period(spark, sf_dir):
    """C02 and C03 over a text for each order, in four forms, and the rule's cases."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 300)
    minguo = lambda d: F.concat_ws("/", (F.year(d) - 1911).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))
    spell = lambda d: F.concat((F.year(d)).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    form = F.col("o_orderkey") % 4
    said = (
        F.when(form == 0, F.concat(F.lit("活動期間：2001/1/1至2031/1/1。申請期間："), minguo(day + F.lit(5)), F.lit("至"), minguo(day + F.lit(40)), F.lit("止。")))
        .when(form == 1, F.concat(F.lit("請於"), spell(day + F.lit(21)), F.lit("前交至課指組，逾期不受理")))
        .when(form == 2, "常年受理申請")
        .otherwise("申請辦法請見附件")
    )
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), said.alias("t"), F.date_format(day, "yyyy-MM-dd").alias("published"), F.lit("2020-06-15").alias("today"))
    rows = with_cases(rows, [r[:4] for r in PERIODS], "id long, t string, published string, today string")
    rows = rows.select("id", periods.application_period(F.col("t"), F.col("published"), F.col("today")).alias("p"))
    return rows.select("id", "p.start", "p.deadline", "p.status", periods.deadline_exclusions(F.col("p")).alias("reasons"))


KINDS = [
    (-1, "113學年度獎學金獲獎名單", "", "result"), (-2, "獎學金作業要點修正", "", "policy"), (-3, "就學貸款申辦須知", "", "loan"), (-4, "清寒助學金開放申請", "", "application"),
    (-5, "獎學金說明會", "", "information"), (-6, "獎助學金", "請於期限內完成", "application"), (-7, "校園新聞", "無", "unknown"), (-8, "獎學金行政契約書", "", "information"),
    (-9, "獎學金設置辦法", "", "policy"), (-10, "名單", "檢附文件", "application"), (-11, None, None, "unknown"),
]
#: A title of the domain for each class of documents, with its kind.
ENDS = [("得獎名單", "result"), ("線上申請報名", "application"), ("說明會", "information"), ("", "unknown")]


@query(f"""
SELECT doc_id AS id, ['result', 'application', 'information', 'unknown'][doc_id % 4 + 1] AS kind FROM documents UNION ALL SELECT a, d FROM ({values(KINDS)}) t(a, b, c, d)
""")
def q24_notice_kind_cjk(spark, sf_dir):
    """C01 over a title of the domain for every document, and the rule's cases."""
    end = F.element_at(F.array(*[F.lit(e) for e, _ in ENDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), end.alias("title"), F.col("text").alias("detail"))
    rows = with_cases(rows, [r[:3] for r in KINDS], "id long, title string, detail string")
    return rows.select("id", notices.notice_kind(text.normalised(F.col("title")), text.normalised(F.col("detail")), notices.CJK).alias("kind"))
