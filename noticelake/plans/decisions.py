"""Queries over structured requirements, attachments and kept tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attachments, eligibility, snapshots, structured
from .queries import _table, query

# A profile, and terms of texts in Latin script.
WHO = {"program_type": "進修部", "degree_level": "學士", "special_statuses": ["低收入戶"], "residence": "桃園市", "year": 3}
TERMS = {"supporting": ["***", "$$$"], "headers": ["license", "Licensed", "©"], "requirements": ["the", "of", "and", "der", "die", "le", "la", "el"], "actions": ["!!", "??"], "fields": ["@", "http", "key", "+"]}


def _count(terms: list[str]) -> str:
    return " + ".join(f"contains(t, '{x}')::INT" for x in terms)


@query(r"""
WITH r AS (
  SELECT doc_id, lang = 'en' AS graduate, toxic = 1 AS native, quality = 1 AS whole FROM documents JOIN labels USING (doc_id)
)
SELECT doc_id, CASE WHEN graduate OR native THEN 'ineligible' WHEN NOT whole THEN 'review' ELSE 'eligible' END AS status,
  CASE WHEN graduate AND native THEN '公告限定的學位層級與目前不符。|須具備以下任一身分：原住民。' WHEN graduate THEN '公告限定的學位層級與目前不符。'
    WHEN native THEN '須具備以下任一身分：原住民。' WHEN NOT whole THEN 'Gemini 抽取的資格文件不完整或證據不足。'
    ELSE '學位層級符合公告。|具備必要身分選項之一：「低收入戶」。' END AS reasons
FROM r
""")
def q50_structured_decisions(spark, sf_dir):
    """Decisions of one profile over requirements that arrive as JSON."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id")
    level = F.when(F.col("lang") == "en", "碩士").otherwise("大學生")
    status = F.when(F.col("toxic") == 1, "原住民").otherwise("中低收入戶")
    said = F.struct(
        F.lit("scholarship_rules").alias("document_type"), (F.col("quality") == 1).alias("criteria_complete"), F.lit(False).alias("needs_more_pages"),
        F.array(level).alias("degree_levels"), F.array(status).alias("required_special_statuses"), F.array(F.struct(F.lit(1).alias("page"), level.alias("text"))).alias("evidence"),
    )
    rows = rows.select("doc_id", structured.parsed(F.to_json(said)).alias("req"))
    own = {k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in WHO.items()}
    who = F.from_json(F.to_json(F.struct(*[c.alias(k) for k, c in own.items()])), structured.PROFILE)
    matrix = structured.conditions(F.col("req"), F.col("who"), eligibility.manual_checks)
    rows = rows.withColumn("who", who).withColumn("matrix", matrix)
    d = structured.decide(F.col("req"), F.col("matrix"))
    return rows.select("doc_id", d.alias("d")).select("doc_id", "d.status", F.array_join("d.reasons", "|").alias("reasons"))


@query("""
WITH r AS (
  SELECT doc_id, CASE WHEN length(text) >= 500 THEN 'eligible' ELSE 'review' END AS by_rules, CASE WHEN toxic = 1 THEN 'ineligible' WHEN quality = 1 THEN 'eligible' ELSE 'review' END AS by_structure
  FROM documents JOIN labels USING (doc_id)
)
SELECT *, CASE WHEN by_structure = 'ineligible' THEN by_structure ELSE by_rules END AS final, false AS conflict FROM r
""")
def q51_structured_veto(spark, sf_dir):
    """A structured refusal overrides the rules, and settles their conflict."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    rules = F.when(F.length("text") >= 500, "eligible").otherwise("review")
    structure = F.when(F.col("toxic") == 1, "ineligible").when(F.col("quality") == 1, "eligible").otherwise("review")
    d = d.select("doc_id", rules.alias("by_rules"), structure.alias("by_structure"))
    d = d.withColumn("final", structured.veto(F.col("by_rules"), F.col("by_structure")))
    return d.withColumn("conflict", structured.hard_conflict(F.col("by_rules"), F.col("by_structure"), F.col("final")))


@query(f"""
WITH d AS (
  SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\p{{Z}}\\x85]+', ' ', 'g')) AS t, CASE WHEN lang = 'en' THEN 'rules' ELSE 'unknown' END AS hint FROM documents
), c AS (
  SELECT doc_id, t, hint, {_count(TERMS["supporting"])} AS s, {_count(TERMS["headers"])} AS h, {_count(TERMS["requirements"])} AS r, {_count(TERMS["actions"])} AS a, {_count(TERMS["fields"])} AS f FROM d
)
SELECT doc_id, CASE WHEN t = '' THEN 'uncertain' WHEN s >= 1 THEN 'supporting_document' WHEN h >= 1 AND r >= 2 THEN 'scholarship_rules' WHEN f >= 3 THEN 'application_form'
  WHEN hint = 'rules' AND r >= 1 AND (h >= 1 OR a >= 1) THEN 'scholarship_rules' WHEN length(t) >= 40 THEN 'other' ELSE 'uncertain' END AS role
FROM c
""")
def q52_content_role(spark, sf_dir):
    """What every text would be as an attachment."""
    hint = F.when(F.col("lang") == "en", "rules").otherwise("unknown")
    return _table(spark, sf_dir, "documents").select("doc_id", attachments.content_role(F.col("text"), hint, TERMS).alias("role"))


@query("""
SELECT sha256(text) AS key, min(item_id) AS first FROM benchmark GROUP BY 1
UNION ALL SELECT sha256(text), min(doc_id) FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL) GROUP BY 1
""")
def q53_insert_or_ignore(spark, sf_dir):
    """Texts of documents added to the known ones, each key once."""
    key = F.sha2("text", 256).alias("key")
    known = _table(spark, sf_dir, "benchmark").select(key, F.col("item_id").alias("first")).groupBy("key").agg(F.min("first").alias("first"))
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(key, F.col("doc_id").alias("first"))
    return snapshots.insert_or_ignore(known, rows, "key", ["first"])


@query("""
SELECT event_id, coalesce(value, 0) AS value, CASE WHEN event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) > 0) THEN 'seen' END AS seen_at FROM events
""")
def q54_set_once(spark, sf_dir):
    """Events in today's columns, with a mark that is set once by their type."""
    e = _table(spark, sf_dir, "events")
    known = e.groupBy("event_type").agg(F.avg("value").alias("mean")).where("mean > 0")
    wide = snapshots.migrate(e, "event_id long, event_type string, value double, seen_at string", {"value": F.lit(0.0)})
    return snapshots.set_once(wide, known, "event_type", {"seen_at": F.lit("seen")}).select("event_id", "value", "seen_at")
