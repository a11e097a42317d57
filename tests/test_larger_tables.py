"""Queries against their SQL on rows that only larger tables have."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import same
from pyspark.sql import functions as F

from noticelake import registry
from noticelake.operators import programs
from noticelake.sources import scans


def equals_its_sql(spark, name, at, table, columns):
    pq.write_table(pa.table(columns), at / f"{table}.parquet")
    same(registry.queries()[name](spark, str(at)), registry.oracle_sql()[name], str(at))


def test_document_rows_of_large_keys(spark, tmp_path):
    keys = [0, 1023, 1024, 1100, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 1_199_999, 1_310_720, 3 << 40]
    equals_its_sql(spark, "q79_document_rows", tmp_path, "part", {"p_partkey": pa.array(keys, pa.int64())})


def test_byte_sizes_by_unit(spark):
    rows = spark.createDataFrame([(1023,), (1 << 20,), (5 << 19,)], "n long")
    got = rows.orderBy("n").select(programs.byte_size(F.col("n")), programs.byte_size(F.col("n"), "KiB")).collect()
    assert [tuple(r) for r in got] == [("1023 B", "1023 B"), ("1.0 MiB", "1024.0 KiB"), ("2.5 MiB", "2560.0 KiB")]


TITLES = [
    "Plain title",
    "Cut &amp;&amp;&amp",
    "&amp",
    "Cut &lt &gt &copy &#39 &quot",
    "Other &eacute; &#233; &AMP; names",
    "a & b &am &quo &amp;amp; &amp;lt; &middot;",
    "Und der 31.164.68.184 im enchie",
    "An address 31.115.6.18 of some host",
    "Address 115.10.20.5 and 10.0.115.7",
    "Number 164.68.18 or 115-13-40 alone",
    "On 115年13月40日 or",
    "On 2025年2月30日 or",
    "x",
    "",
]


def has_titles(spark, name, at):
    html = [f"<html><body><nav>x &amp</nav><article><h1>{t}</h1><p>{t}</p><p>and some more words of this page</p></article></body></html>" for t in TITLES]
    ids = pa.array([k * 7 for k in range(len(html))], pa.int64())
    equals_its_sql(spark, name, at, "pages", {"page_id": ids, "url": [f"https://site{k}.example/p" for k in range(len(html))], "html": html})


@pytest.mark.parametrize("name", ["q63_dated_headings", "q61_marked_anchors", "q13_main_text_length", "q44_listing_rows", "q58_undated_table", "q59_linked_news", "q62_relevant_rows", "q60_detail_links"])
def test_titles_with_cut_references_and_addresses(spark, tmp_path, name):
    has_titles(spark, name, tmp_path)


ANY_TITLE = [
    "甲\u3000獎學金\u2003公告",
    "\u3000 &nbsp;\u2009of blank ends\u3000&nbsp; ",
    "\u3000",
    "\x0bone\x1c two\x85three\u2028four \u2029",
    "\rof\rlines",
    "of\ntwo lines",
    "<b>marked</b> title<br> and </a></td></tr></table><!-- more",
    "1 <2 <i>3</i> &lt;p&gt; <script>x",
    "[day] {day} {id} [when]",
    "on 2025-03-04 or 115.6.30",
    "115/6/18",
    "\ufdefx \u200b \ufeff",
]


@pytest.mark.parametrize("name", ["q44_listing_rows", "q58_undated_table", "q59_linked_news", "q62_relevant_rows"])
def test_titles_that_hold_anything(spark, tmp_path, name):
    html = [f"<article><h1>{t}</h1></article>" for t in ANY_TITLE] + ["<h1>without a number</h1>", None]
    ids = pa.array([*range(5, 5 + len(ANY_TITLE)), None, 3], pa.int64())
    equals_its_sql(spark, name, tmp_path, "pages", {"page_id": ids, "url": ["https://a.example/p"] * len(html), "html": html})


def test_dates_that_do_not_exist_are_passed_over():
    assert scans.listed_date("115.13.40 and 115.6.30") == "2026-06-30" and scans.listed_date("115.13.40") == ""
    assert scans.listed_date("31.115.6.18 2026/13/1 2026/1/2-2026/1/9 115.2.3") == "2026-01-02"
    assert scans.listed_date("115.6.18") == "2026-06-18" and scans.listed_date("10.115.6.18") == ""
