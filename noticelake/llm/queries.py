"""The registered queries of this subpackage: one for each operator, over its
whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flatfile, htmltext, merkle, mixing, packing, simhash, substring, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]

#: Tokens of a packed sequence.
CAPACITY = 2048
#: Target weights: a domain's by its name, a language's in its domain.  Sources
#: of a language weigh the same, and so do domains.
LANGUAGE_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
MAX_EPOCHS = 4
SEED = "mix"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), n=4, max_bits=4, mins=0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.round_trip(_table(spark, sf_dir, "pages"))
    return chunks.where("last").select(F.col("id").alias("page_id"), "payload_bytes", F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, coefficients = toxicity.model(docs, _table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, lexicon, coefficients)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tree() -> dict:
    """The levels of the mixing tree.  The tables have no domain: sources whose
    number ends in the same digit stand for one."""
    return {"domain": F.concat(F.lit("domain"), F.regexp_extract("source", r"(\d)$", 1)), "lang": F.col("lang"), "source": F.col("source")}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mix = mixing.plan(docs, tree(), {"lang": LANGUAGE_WEIGHTS}, (1, 1), MAX_EPOCHS, SEED)
    rows = mixing.select(docs, tree(), mix, SEED)
    return rows.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), "epoch")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents"), 20, digest=True)


def cluster_of(text) -> object:
    """The duplicate cluster of a text: equal words, case folded."""
    return F.xxhash64(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, mixing.n_tokens(F.col("text")), F.col("source"), cluster_of(F.col("text")), CAPACITY)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edits(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return flatfile.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows.where("id % 20 = 0"), rows, 20, scale=64).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def queries() -> dict[str, Query]:
    found = [op1_simhash, op2_warc, op3_toxicity, op4_mixing, op5_html, op6_substring, op7_packing, op8_fingerprints, op9_token_files, op10_topk]
    return {f.__name__: f for f in found}


OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100
  GROUP BY ALL HAVING count(*) > 1
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN first IS NULL OR d.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

OP4 = """
WITH RECURSIVE w(lang, w) AS (VALUES ('en', 50), ('de', 20), ('fr', 20), ('es', 10)),
doc AS (
  SELECT doc_id, 'domain' || regexp_extract(source, '(\\d)$', 1) AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n)::HUGEINT AS tokens, 4 * sum(n)::HUGEINT AS cap
  FROM doc GROUP BY ALL HAVING lang IN (SELECT lang FROM w)
), d1 AS (
  SELECT domain, sum(cap) AS cap, 1::HUGEINT AS w, (SELECT sum(n) FROM doc)::HUGEINT AS budget FROM leaf GROUP BY ALL
), d2 AS (
  SELECT *, coalesce(sum(cap) OVER r, 0) AS prior, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS wide FROM d1
  WINDOW r AS (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), d3 AS (
  SELECT *, cap * wide <= (budget - prior) * w AS f FROM d2
), d4 AS (
  SELECT domain, CASE WHEN f THEN cap ELSE ((budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ()) * w)
         // greatest(sum(CASE WHEN f THEN 0 ELSE w END) OVER (), 1) END AS budget FROM d3
), l1 AS (
  SELECT domain, lang, sum(cap) AS cap, any_value(w.w)::HUGEINT AS w, any_value(budget) AS budget
  FROM leaf JOIN w USING (lang) JOIN d4 USING (domain) GROUP BY ALL
), l2 AS (
  SELECT *, coalesce(sum(cap) OVER r, 0) AS prior, sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER r, 0) AS wide FROM l1
  WINDOW r AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l3 AS (
  SELECT *, cap * wide <= (budget - prior) * w AS f FROM l2
), l4 AS (
  SELECT domain, lang, CASE WHEN f THEN cap ELSE ((budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER q) * w)
         // greatest(sum(CASE WHEN f THEN 0 ELSE w END) OVER q, 1) END AS budget FROM l3
  WINDOW q AS (PARTITION BY domain)
), s1 AS (
  SELECT domain, lang, source, tokens, cap, 1::HUGEINT AS w, budget FROM leaf JOIN l4 USING (domain, lang)
), s2 AS (
  SELECT *, coalesce(sum(cap) OVER r, 0) AS prior, sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER r, 0) AS wide FROM s1
  WINDOW r AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, cap * wide <= (budget - prior) * w AS f FROM s2
), s4 AS (
  SELECT domain, lang, source, tokens, CASE WHEN f THEN cap ELSE ((budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER q) * w)
         // greatest(sum(CASE WHEN f THEN 0 ELSE w END) OVER q, 1) END AS alloc FROM s3
  WINDOW q AS (PARTITION BY domain, lang)
), s5 AS (
  SELECT *, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epochs FROM s4
), part AS (
  SELECT doc_id, domain, lang, source, epochs, alloc - epochs * tokens AS need, n,
         md5('mix:' || (epochs + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM doc JOIN s5 USING (domain, lang, source)
), upto AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING)
          - sum(n) OVER (PARTITION BY domain, lang, source, k) AS before FROM part
), times AS (
  SELECT *, epochs + CASE WHEN before < need THEN 1 ELSE 0 END AS t FROM upto
)
SELECT doc_id, domain, lang, source, unnest(range(1, t::BIGINT + 1))::INTEGER AS epoch FROM times
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
), k AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM k
), r AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM h) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(20)) AS p FROM r
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = """
WITH f AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v
  FROM f WHERE len(embedding) = (SELECT len(embedding) FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::HUGEINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, least(greatest(score, -9223372036854775808), 9223372036854775807)::BIGINT AS score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op4_mixing": OP4, "op6_substring": OP6, "op10_topk": OP10}
