"""The library's queries over the driver's tables, each beside its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logic, text
from ..operators import evidence, notices, rows, snapshots, state
from ..sources import frontier, listing
from ..streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "1997-06-01"
TITLE = "regexp_extract(text, '^[^\\n]*')"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _title():
    return F.regexp_extract("text", r"^[^\n]*", 0)


@query(r"""
SELECT doc_id, sha256(source || '|' || trim(regexp_replace(regexp_extract(text, '^[^\n]*'), '\s+', ' ', 'g')) || '|' || '2026-07-01' || '|' || trim(lang)) AS content_hash
FROM documents
""")
def q01_content_hash(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", text.content_hash(F.col("source"), _title(), F.lit("2026-7-1"), F.col("lang")).alias("content_hash"))


OFFICIAL = ("example.org",)


@query("""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS site FROM pages)
SELECT page_id, site, CASE WHEN site = 'example.org' OR site LIKE '%.example.org' THEN 'official' WHEN site LIKE '%.gov.tw' THEN 'government'
  WHEN site LIKE '%.edu.tw' THEN 'school' ELSE 'other' END AS role,
  CASE WHEN site = 'example.org' OR site LIKE '%.example.org' THEN 100 WHEN site LIKE '%.gov.tw' THEN 85 WHEN site LIKE '%.edu.tw' THEN 75 ELSE 0 END AS score
FROM h
""")
def q03_url_host_role(spark, sf_dir):
    site = text.host(F.col("url"))
    role, score = notices.source_role(site, OFFICIAL)
    return _table(spark, sf_dir, "pages").select("page_id", site.alias("site"), role.alias("role"), score.alias("score"))


@query("""
SELECT doc_id, contains(text, 'http') OR contains(text, '@') AS relevant FROM documents
""")
def q05_relevance_split(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.contains_any(F.col("text"), ["http", "@"]).alias("relevant"))


@query("""
SELECT count(*) AS raw, count(*) FILTER (contains(text, 'http')) AS accepted, count(*) FILTER (NOT contains(text, 'http')) AS excluded,
  count(*) = count(*) FILTER (contains(text, 'http')) + count(*) FILTER (NOT contains(text, 'http')) AS reconciled FROM documents
""")
def q06_pipeline_reconcile(spark, sf_dir):
    has = F.contains("text", F.lit("http"))
    out = _table(spark, sf_dir, "documents").agg(F.count("*").alias("raw"), F.count_if(has).alias("accepted"), F.count_if(~has).alias("excluded"))
    return out.withColumn("reconciled", F.col("raw") == F.col("accepted") + F.col("excluded"))


@query("""
SELECT min(doc_id) AS doc_id, sha256(text) AS key, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY text
""")
def q07_first_wins_dedup(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "source")
    return rows.first_wins(d, ["key"], ["doc_id"], copies="copies")


@query("""
SELECT page_id FROM pages WHERE sha256(url) NOT IN (SELECT sha256(url) FROM pages WHERE page_id % 3 = 0)
""")
def q09_discover_antijoin(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("key"))
    return state.discover(p, p.where("page_id % 3 = 0").select("key").distinct(), "key").select("page_id")


@query("""
WITH p AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'view' GROUP BY 1),
     c AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT coalesce(p.user_id, c.user_id) AS user_id, p.r AS previous, c.r AS current,
  CASE WHEN p.r IS NULL THEN 'baselined' WHEN c.r IS NULL THEN 'missing' WHEN p.r = c.r THEN 'unchanged' ELSE 'changed' END AS status
FROM p FULL JOIN c USING (user_id)
""")
def q10_revision_observe(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    last = lambda kinds: e.where(F.col("event_type").isin(*kinds)).groupBy("user_id").agg(F.max("event_id").alias("revision"))
    return state.observe(last(["view"]), last(["view", "click"]), "user_id", "revision")


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN sha256(c_mktsegment) END AS fingerprint FROM customer)
SELECT c_custkey, fingerprint FROM c WHERE fingerprint IS NULL OR fingerprint <> sha256('BUILDING')
""")
def q11_reevaluate_on_fingerprint(spark, sf_dir):
    """Rows that were evaluated for another profile, or for none."""
    seen = F.when(F.col("c_custkey") % 10 > 0, F.sha2("c_mktsegment", 256))
    return state.outdated(_table(spark, sf_dir, "customer").select("c_custkey", seen.alias("fingerprint")), "fingerprint", F.sha2(F.lit("BUILDING"), 256))


BODY = r"(?s)<article>(.*?)</article>"


@query("""
WITH l AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) AS pos FROM pages
), d AS (SELECT page_id, href, min(pos) AS pos FROM l GROUP BY 1, 2)
SELECT page_id, href, (row_number() OVER (PARTITION BY page_id ORDER BY length(href) DESC, pos))::INTEGER AS place FROM d
QUALIFY place <= 3
""")
def q14_link_inventory_top3(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1))
    each = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return rows.top_within(each, "page_id", [F.desc(F.length("href")), F.col("pos")], 3).select("page_id", "href", "place")


@query(r"""
WITH b AS (
  SELECT page_id, unnest(['article', 'nav', 'footer']) AS tag, unnest([regexp_extract(html, '(?s)<article>(.*?)</article>', 1),
    regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)]) AS h FROM pages
), s AS (
  SELECT page_id, tag, length(regexp_replace(h, '<[^>]*>', '', 'g')) - 100 * len(regexp_extract_all(h, '<a ')) AS score FROM b
)
SELECT page_id, arg_max(tag, (score, tag)) AS tag, max(score)::BIGINT AS score FROM s GROUP BY 1
""")
def q15_link_density_argmax(spark, sf_dir):
    block = lambda t: F.regexp_extract("html", f"(?s)<{t}>(.*?)</{t}>", 1)
    score = lambda b: (F.length(F.regexp_replace(b, "<[^>]*>", "")) - 100 * F.regexp_count(b, F.lit("<a "))).cast("long")
    best = F.array_max(F.array(*[F.struct(score(block(t)).alias("score"), F.lit(t).alias("tag")) for t in ("article", "nav", "footer")]))
    return _table(spark, sf_dir, "pages").select("page_id", best.alias("b")).select("page_id", "b.tag", "b.score")


EVIDENCE = """
  CASE WHEN contains(text, 'ing') OR contains(text, 'heit') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'tion') OR contains(text, 'ción') THEN 2 ELSE 0 END
  + CASE WHEN contains(text, 'ment') THEN 2 ELSE 0 END + CASE WHEN contains(text, '!!') THEN 2 ELSE 0 END + CASE WHEN contains(text, '***') THEN 1 ELSE 0 END
  + CASE WHEN contains(text, 'http') THEN 1 ELSE 0 END + CASE WHEN contains(text, '©') OR contains(text, 'Licensed') THEN 1 ELSE 0 END
  + CASE WHEN contains(text, 'der') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'que') THEN 1 ELSE 0 END
"""


@query(f"""
WITH s AS (SELECT doc_id, ({EVIDENCE})::INTEGER AS score, contains(text, 'der') AS scope, contains(text, 'que') AS act FROM documents)
SELECT doc_id, score, CASE WHEN score >= 4 OR (scope AND act) THEN 'valid_application_detail' WHEN score >= 2 THEN 'insufficient_evidence' ELSE 'navigation_or_wrong_page' END AS status FROM s
""")
def q16_evidence_score(spark, sf_dir):
    scope, action = F.contains("text", F.lit("der")), F.contains("text", F.lit("que"))
    score = notices.evidence_score(F.col("text"), notices.LATIN_EVIDENCE, scope, action)
    return _table(spark, sf_dir, "documents").select("doc_id", score.cast("int").alias("score"), notices.evidence_status(score, scope, action).alias("status"))


#: name, alias, required, optional, forbidden
PROGRAMS = [("p1", "theation", "of the", "and", "***"), ("p2", "and the", "the", "of", "zzz"), ("p3", "der die", "ein", "und", "zzz"), ("p4", "de la", "que", "los", "zzz")]


@query("""
WITH r(program, alias, required, optional, forbidden) AS (VALUES ('p1', 'theation', 'of the', 'and', '***'), ('p2', 'and the', 'the', 'of', 'zzz'),
  ('p3', 'der die', 'ein', 'und', 'zzz'), ('p4', 'de la', 'que', 'los', 'zzz')
), s AS (
  SELECT doc_id, program, CASE WHEN contains(text, alias) THEN 100 WHEN contains(text, required) THEN 60 ELSE 0 END AS base,
    CASE WHEN contains(text, optional) THEN 10 ELSE 0 END - CASE WHEN contains(text, forbidden) THEN 80 ELSE 0 END AS more FROM documents, r
), t AS (SELECT doc_id, program, (CASE WHEN base = 0 THEN 0 ELSE greatest(base + more, 0) END)::INTEGER AS score FROM s
), k AS (
  SELECT doc_id, program, score, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0)::INTEGER AS second_score, coalesce(lead(program) OVER w, '') AS competing
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, program)
)
SELECT doc_id, program, score, second_score, competing, CASE WHEN score < 80 THEN 'no_match' WHEN competing <> '' AND score - second_score < 15 THEN 'ambiguous' ELSE 'matched' END AS status
FROM k WHERE n = 1
""")
def q17_program_match_margin(spark, sf_dir):
    has = lambda x: F.contains("text", F.lit(x))
    scores = {p: notices.match_score(has(alias), F.lit(False), has(required), has(optional).cast("int"), has(forbidden).cast("int"), F.lit(False)) for p, alias, required, optional, forbidden in PROGRAMS}
    return _table(spark, sf_dir, "documents").select("doc_id", rows.best_of(scores, 80, 15).alias("best")).select("doc_id", F.col("best.candidate").alias("program"), "best.score", "best.second_score", "best.competing", "best.status")


@query("""
SELECT lang, count(*) AS n, max(length(text))::BIGINT AS longest, arg_max(doc_id, (length(text), -doc_id)) AS top FROM documents GROUP BY 1
""")
def q18_match_rollup(spark, sf_dir):
    size = F.length("text").cast("long")
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.max_by("doc_id", F.struct(size, -F.col("doc_id"))).alias("top"))


@query("""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS site, html FROM pages)
SELECT page_id, (CASE WHEN site LIKE '%.example.org' OR site = 'example.org' THEN 100 ELSE 0 END + CASE WHEN contains(html, 'Licensed') THEN 35 ELSE 0 END
  + CASE WHEN contains(url, '/en/') THEN 25 ELSE -30 END + CASE WHEN contains(html, '***') THEN 15 ELSE 0 END - CASE WHEN contains(url, 'ref=') THEN 40 ELSE 0 END)::INTEGER AS score
FROM h ORDER BY score DESC, url, page_id LIMIT 25
""")
def q19_candidate_rank(spark, sf_dir):
    _, base = notices.source_role(text.host(F.col("url")), OFFICIAL)
    more = logic.weighted([(F.contains("html", F.lit("Licensed")), 35), (F.contains("url", F.lit("/en/")), 25), (~F.contains("url", F.lit("/en/")), -30), (F.contains("html", F.lit("***")), 15), (F.contains("url", F.lit("ref=")), -40)])
    p = _table(spark, sf_dir, "pages").select("page_id", "url", (base + more).cast("int").alias("score"))
    return p.orderBy(F.desc("score"), "url", "page_id").limit(25).select("page_id", "score")


@query("""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS site, contains(html, 'the') AS p, contains(html, 'of') AS o FROM pages)
SELECT page_id, CASE WHEN NOT p THEN 'rejected' WHEN site LIKE '%.example.org' OR (site LIKE '%.example.com' AND o) THEN 'verified' WHEN site LIKE '%.example.com' THEN 'review' ELSE 'rejected' END AS status FROM h
""")
def q20_source_identity(spark, sf_dir):
    site = text.host(F.col("url"))
    status = notices.identity_status(site.endswith(".example.org"), site.endswith(".example.com"), F.contains("html", F.lit("the")), F.contains("html", F.lit("of")))
    return _table(spark, sf_dir, "pages").select("page_id", status.alias("status"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: contains(x, 'the ') OR contains(x, 'der ')) AS a FROM documents)
SELECT doc_id, len(a)::INTEGER AS mentions, len(list_filter(a, lambda x: contains(x, ',')))::INTEGER AS excluded FROM s
""")
def q21_sentence_exclusion_scope(spark, sf_dir):
    found = F.filter(F.split("text", r"\."), lambda s: F.contains(s, F.lit("the ")) | F.contains(s, F.lit("der ")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("mentions"), F.size(F.filter(found, lambda s: F.contains(s, F.lit(",")))).alias("excluded"))


@query(f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS deadline, CAST(o_orderdate AS DATE) - 30 AS start FROM orders)
SELECT o_orderkey, start, deadline, CASE WHEN deadline < DATE '{AS_OF}' THEN 'expired' WHEN start > DATE '{AS_OF}' THEN 'upcoming' ELSE 'open' END AS status FROM o
""")
def q22_roc_period(spark, sf_dir):
    """Dates rendered as text with years from 1911 and read back."""
    when = F.col("o_orderdate").cast("date")
    said = lambda d: F.concat(F.lpad((F.year(d) - 1911).cast("string"), 3, "0"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("申請期間:"), said(F.date_sub(when, 30)), F.lit("至"), said(when)).alias("t"))
    pattern = r"(\d{3})年(\d{1,2})月(\d{1,2})日"
    part = lambda n, k: F.element_at(F.regexp_extract_all("t", F.lit(pattern), F.lit(k)), n)
    read = lambda n: logic.calendar_date(part(n, 1), part(n, 2), part(n, 3), F.lit(None).cast("date"))
    o = o.select("o_orderkey", read(1).alias("start"), read(2).alias("deadline"))
    return o.withColumn("status", logic.period_status(F.col("start"), F.col("deadline"), F.lit(AS_OF).cast("date")))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p, (o_orderkey % 12 + 1)::INTEGER AS m FROM orders)
SELECT o_orderkey, make_date(year(p) + CASE WHEN month(p) - m > 6 THEN 1 ELSE 0 END, m, 15) AS due FROM o
""")
def q23_yearless_rollover(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    due = logic.calendar_date(F.lit(""), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("15"), F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", due.alias("due"))


@query("""
WITH p AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer), r AS (SELECT n_nationkey, (n_nationkey * 200)::DOUBLE AS need FROM nation),
s AS (SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 'unknown' WHEN c_acctbal >= need THEN 'match' ELSE 'excluded' END AS balance,
  CASE WHEN c_nationkey = 0 THEN 'unknown' WHEN c_nationkey >= 5 THEN 'match' ELSE 'excluded' END AS region FROM p JOIN r ON n_nationkey = c_nationkey)
SELECT c_custkey, balance, region, CASE WHEN balance = 'excluded' OR region = 'excluded' THEN 'ineligible' WHEN balance = 'unknown' OR region = 'unknown' THEN 'review' ELSE 'eligible' END AS decision FROM s
""")
def q25_tri_state_thresholds(spark, sf_dir):
    needs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 200).cast("double").alias("need"))
    c = _table(spark, sf_dir, "customer").join(needs, "c_nationkey")
    c = c.select("c_custkey", logic.tri_state(F.col("c_acctbal"), F.col("need")).alias("balance"), logic.tri_state(F.col("c_nationkey"), F.lit(5)).alias("region"))
    return c.withColumn("decision", logic.decision([F.col("balance"), F.col("region")]))


@query("""
SELECT doc_id, array_to_string(list_filter(['http', '@', '***', '|'], lambda m: contains(text, m)), ';') AS reasons FROM documents
""")
def q26_reason_arrays(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(text.hits(F.col("text"), ["http", "@", "***", "|", "http"])), ";").alias("reasons"))


@query("""
WITH a(status, term) AS (VALUES ('english', 'the '), ('english', 'of '), ('german', 'der '), ('german', 'und '), ('french', 'les '), ('spanish', 'los '))
SELECT doc_id, status, count(*) AS hits, count(*) = (SELECT count(*) FROM a b WHERE b.status = a.status) AS every FROM documents, a WHERE contains(text, term) GROUP BY doc_id, status
""")
def q27_alias_any_all(spark, sf_dir):
    aliases = {"english": ["the ", "of "], "german": ["der ", "und "], "french": ["les "], "spanish": ["los "]}
    each = F.array(*[F.struct(F.lit(s).alias("status"), F.size(text.hits(F.col("text"), ts)).cast("long").alias("hits"), F.lit(len(ts)).alias("n")) for s, ts in aliases.items()])
    out = _table(spark, sf_dir, "documents").select("doc_id", F.explode(each).alias("x")).where("x.hits > 0")
    return out.select("doc_id", "x.status", "x.hits", (F.col("x.hits") == F.col("x.n")).alias("every"))


AXES = {"eligibility": ["eligible", "review", "ineligible", "not_applicable"], "evidence": ["valid_application_detail", "insufficient_evidence", "source_error"], "kind": ["application", "loan", "unknown"], "period": ["open", "expired", "stale_unknown", "deadline_unknown"]}


@query("""
SELECT eligibility, evidence, kind, period, CASE WHEN kind <> 'application' OR period IN ('expired', 'stale_unknown', 'not_applicable') THEN 'not_actionable'
  WHEN eligibility = 'ineligible' THEN 'reject' WHEN eligibility = 'eligible' AND evidence = 'valid_application_detail' THEN 'apply_candidate'
  WHEN eligibility = 'review' AND evidence = 'valid_application_detail' THEN 'manual_review' WHEN eligibility IN ('eligible', 'review') THEN 'verify_source' ELSE 'manual_review' END AS action
FROM (SELECT unnest(['eligible', 'review', 'ineligible', 'not_applicable']) AS eligibility), (SELECT unnest(['valid_application_detail', 'insufficient_evidence', 'source_error']) AS evidence),
     (SELECT unnest(['application', 'loan', 'unknown']) AS kind), (SELECT unnest(['open', 'expired', 'stale_unknown', 'deadline_unknown']) AS period)
""")
def q29_action_status(spark, sf_dir):
    grid = spark.range(1).drop("id")
    for name, values in AXES.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return grid.withColumn("action", notices.action_status(*[F.col(c) for c in AXES]))


@query("""
WITH e AS (SELECT event_id, (props->>'k')::INTEGER AS k FROM events)
SELECT event_id, k, CASE WHEN k IS NULL THEN 'unknown' WHEN k >= 50 THEN 'match' WHEN k = 0 THEN 'unknown' ELSE 'excluded' END AS status FROM e
""")
def q30_structured_matrix(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))["k"].alias("k"))
    return e.withColumn("status", logic.tri_state(F.col("k"), F.lit(50)))


@query("""
SELECT doc_id, quality = 1 AS model, length(text) >= 500 AS rule, (quality = 1) <> (length(text) >= 500) AS conflict FROM documents JOIN labels USING (doc_id)
""")
def q31_shadow_compare(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 500).alias("rule"))
    d = d.join(_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("model")), "doc_id")
    return d.select("doc_id", "model", "rule", (F.col("model") != F.col("rule")).alias("conflict"))


@query("""
SELECT reason, count(*) AS n, min(doc_id) AS example FROM (SELECT doc_id, CASE WHEN length(text) < 100 THEN 'short' WHEN contains(text, '***') THEN 'junk' WHEN contains(text, '!!') THEN 'shouting' END AS reason FROM documents)
WHERE reason IS NOT NULL GROUP BY 1
""")
def q32_rejection_ledger(spark, sf_dir):
    reason = logic.cascade([(F.length("text") < 100, "short"), (F.contains("text", F.lit("***")), "junk"), (F.contains("text", F.lit("!!")), "shouting")], "")
    return _table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(bool_or(o_orderstatus = 'F'), false) AS finished
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def q33_acceptance_rows(spark, sf_dir):
    # Orders are summed by customer before the join, and customers by nation after it.
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.bool_or(F.col("o_orderstatus") == "F").alias("finished"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(o, "c_custkey", "left")
    c = c.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.bool_or("finished").alias("finished"))
    n = _table(spark, sf_dir, "nation").join(c, "n_nationkey", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return n.select("n_name", zero("customers"), zero("orders"), F.coalesce("finished", F.lit(False)).alias("finished"))


@query("""
SELECT event_type, bool_and(value >= 0) AS all_counted, bool_or(value > 100) AS some_large, count(*) FILTER (value IS NULL) AS missing FROM events GROUP BY 1
""")
def q34_acceptance_gates(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.bool_and(F.col("value") >= 0).alias("all_counted"), F.bool_or(F.col("value") > 100).alias("some_large"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("""
WITH s AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u, count(*) FILTER (value > 50) AS v FROM events GROUP BY 1),
t AS (SELECT event_type, least(greatest(round_even(30 + CASE WHEN v * 2 > n THEN 25 WHEN v > 0 THEN 10 ELSE 0 END + 20 * (u / n) + 15 * (v / n) + 10.0, 0)::INTEGER, 0), 100) AS score FROM s)
SELECT event_type, score, CASE WHEN score >= 85 THEN 'healthy' WHEN score >= 60 THEN 'degraded' WHEN score >= 1 THEN 'poor' ELSE 'failed' END AS bucket FROM t
""")
def q35_health_score(spark, sf_dir):
    s = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.count_if(F.col("value") > 50).alias("v"))
    score = notices.health_score(F.col("v") * 2 > F.col("n"), F.col("v") > 0, F.col("u") / F.col("n"), F.col("v") / F.col("n"), F.lit(1.0))
    return s.select("event_type", score.alias("score"), notices.health_bucket(score).alias("bucket"))


@query("""
SELECT o_custkey, o_orderkey, ceil(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) / 5)::INTEGER AS batch FROM orders
""")
def q36_batches_of_five(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rows.batches(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "batch")


@query("""
WITH u AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS site, page_id FROM pages)
SELECT site, min(page_id) AS page_id FROM u GROUP BY 1 ORDER BY 2 LIMIT 20
""")
def q37_digest_merge(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select(text.host(F.col("url")).alias("site"), "page_id")
    return rows.first_wins(p, ["site"], ["page_id"]).orderBy("page_id").limit(20)


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS n FROM conversations),
f AS (
  SELECT conv_id, turn, cost, n, cost <= 600 AS admitted, (CASE WHEN cost <= 600 THEN 600 - cost ELSE 600 END)::BIGINT AS remaining FROM t WHERE n = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.cost, t.n, t.cost <= f.remaining, CASE WHEN t.cost <= f.remaining THEN f.remaining - t.cost ELSE f.remaining END FROM f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1
)
SELECT conv_id, turn, cost, admitted, remaining AS left FROM f
""".replace("AS left", 'AS "left"'))
def q38_budget_fold(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return rows.greedy_budget(c, "conv_id", "turn", "cost", 600)


STRONG, WEAK, AGAINST = ["theation", "der die", "de la"], ["the", "und", "les", "los"], ["Licensed", "***"]


@query()
def q39_evidence_compaction(spark, sf_dir):
    out = evidence.compact(F.col("text"), STRONG, WEAK, AGAINST)
    d = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), out.alias("evidence"))
    return d.select("doc_id", "n_chars", F.length("evidence").cast("long").alias("kept_chars"), F.sha2("evidence", 256).alias("kept_sha256"))


def _anchor_sql(name: str) -> str:
    return f"CASE WHEN {name} = '' THEN [] WHEN length({name}) <= 8 THEN [{name}] ELSE list_distinct(list_transform(range(1, length({name}) - 2), lambda k: substring({name}, k::INTEGER, 4))) END"


@query(rf"""
WITH b AS (
  SELECT doc_id, regexp_replace(lower(regexp_extract(text, '^[^\n]*')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS t,
    regexp_replace(lower(regexp_replace(text, '^[^\n]*', '')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS r FROM documents
), a AS (SELECT doc_id, {_anchor_sql("t")} AS title, {_anchor_sql("r")} AS body FROM b)
SELECT doc_id, len(title)::INTEGER AS anchors, len(list_intersect(title, body))::INTEGER AS shared FROM a
""")
def q40_ngram_anchor_relevance(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", _title().alias("title"), F.regexp_replace("text", r"^[^\n]*", "").alias("body"))
    return d.select("doc_id", F.size(evidence.anchors(F.col("title"))).alias("anchors"), evidence.shared_anchors(F.col("title"), F.col("body")).alias("shared"))


@query("""
WITH d AS (SELECT doc_id, sha256(lang || doc_id % 10) AS key FROM documents), a AS (SELECT key, min(doc_id) AS value FROM d GROUP BY 1),
b AS (SELECT key, value, CASE WHEN value % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM a WHERE value % 4 > 0)
SELECT doc_id, b.value FROM d LEFT JOIN b ON b.key = d.key AND status = 'ok'
""")
def q41_cache_hit_join(spark, sf_dir):
    """Entries are put once, a key's are deleted, and errors answer nothing."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("lang", (F.col("doc_id") % 10).cast("string")), 256).alias("key"))
    entries = d.select("key", F.col("doc_id").alias("value"), F.when(F.col("doc_id") % 3 == 0, "error").otherwise("ok").alias("status"))
    cache = snapshots.put(entries.limit(0), entries, "key", ["value"])
    cache = snapshots.delete(cache, cache.where("value % 4 = 0").select("key"), "key")
    hit, missed = snapshots.cached(d, cache, "key", errors=False)
    return hit.select("doc_id", "value").unionByName(missed.select("doc_id"), allowMissingColumns=True)


@query("""
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1
""")
def q42_latest_snapshot(spark, sf_dir):
    return state.latest(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"])


@query("""
WITH RECURSIVE l AS (
  SELECT page_id AS node, page_id * 2 + unnest(range(1, len(regexp_extract_all(html, '<a href="[^"]*">')) + 1)) AS target FROM pages
), e AS (SELECT node, target FROM l WHERE target IN (SELECT page_id FROM pages)),
f(node, depth) AS (SELECT min(page_id), 0 FROM pages UNION SELECT e.target, f.depth + 1 FROM f JOIN e ON e.node = f.node WHERE f.depth < 40)
SELECT node AS page_id, min(depth)::INTEGER AS depth FROM f GROUP BY 1
""")
def q43_pagination_frontier(spark, sf_dir):
    """Link k of a page leads to page 2 * page_id + k; addresses in the tables lead nowhere."""
    p = _table(spark, sf_dir, "pages")
    n = F.regexp_count("html", F.lit('<a href="[^"]*">'))
    links = p.select("page_id", n.alias("n")).where("n > 0").select(F.col("page_id").alias("node"), F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    links = links.select("node", (F.col("node") * 2 + F.col("k")).alias("target")).join(p.select(F.col("page_id").alias("target")), "target", "left_semi")
    found = frontier.reach(links, p.agg(F.min("page_id").alias("node")), 40)
    return found.select(F.col("node").alias("page_id"), "depth")


@query("""
SELECT DISTINCT user_id, event_type FROM events
""")
def q45_stream_discover(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    files = path if not path.endswith(".parquet") else f"{sf_dir}/events.parque[t]"
    feed = spark.readStream.schema(schema).parquet(files)
    return feeds.available(feeds.discovered_once(feed, ["user_id", "event_type"]), "discover")


@query("""
WITH p AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'view' GROUP BY 1),
     c AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT c.user_id, p.r AS previous, c.r AS current, CASE WHEN p.r IS NULL THEN 'baselined' WHEN p.r = c.r THEN 'unchanged' ELSE 'changed' END AS status
FROM c LEFT JOIN p USING (user_id)
""")
def q46_stream_revision(spark, sf_dir):
    """Two runs over the feed; the second starts from the first one's snapshot."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    feed = lambda kinds: spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").where(F.col("event_type").isin(*kinds))
    _, snapshot = feeds.revisions(feed(["view"]), "user_id", "event_id", "event_id")
    changes, _ = feeds.revisions(feed(["view", "click"]), "user_id", "event_id", "event_id", snapshot)
    return changes.drop("batch")


@query("""
SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1
""")
def q47_histogram_pivot(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = _table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"))
    return e.agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


@query("""
SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def q48_dimension_resolve(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(n, "s_nationkey", "left").join(r, "r_regionkey", "left").select("s_suppkey", "n_name", "r_name")


@query(r"""
WITH u AS (
  SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS site, regexp_extract(url, '^[^?#]*') AS address, html FROM pages
), f AS (SELECT address, min(page_id) AS page_id FROM u GROUP BY 1
), s AS (
  SELECT u.page_id, u.site, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM u JOIN f ON f.page_id = u.page_id AND f.address = u.address
)
SELECT page_id, site, length(body)::BIGINT AS body_chars, CASE WHEN contains(body, 'Licensed') OR contains(body, 'license') OR contains(body, '©') THEN 'policy'
  WHEN contains(body, '***') OR contains(body, '$$$') OR contains(body, '|') THEN 'information' ELSE 'application' END AS kind
FROM s WHERE page_id % 5 <> 0
""")
def q00_new_pages(spark, sf_dir):
    """Pages that are new since the last run, one for each address, with the size
    and kind of their main text."""
    p = _table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("site"), F.regexp_extract("url", r"^[^?#]*", 0).alias("address"), "html")
    first = rows.first_wins(p.select("address", "page_id"), ["address"], ["page_id"])
    known = p.where("page_id % 5 = 0").select("page_id")
    new = state.discover(p.join(first, ["address", "page_id"], "left_semi"), known, "page_id")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", BODY, 1), "<[^>]*>", " "), r"\s+", " "))
    new = new.select("page_id", "site", body.alias("body"))
    pack = notices.LATIN
    kind = logic.cascade([(text.contains_any(F.col("body"), pack["policy"]), "policy"), (text.contains_any(F.col("body"), pack["information"]), "information")], "application")
    return new.select("page_id", "site", F.length("body").cast("long").alias("body_chars"), kind.alias("kind"))
