"""A corpus pipeline of five of the operators in ``noticelake.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  A stage works on all its predecessor
kept.

Defined results: each stage handles nulls, empty and very long texts, empty tables
and repeated rows as its operator states, and keeps further columns of any name.
Rows of one doc_id stay or go together in near-dedup, and so do those without one
(they stay if one of them is like no row that has one).  ``n_chars`` is counted anew after passages
went.  Mixing drops a tenth of the tokens by design (``MIX_SHARE``), and languages
without a weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import mixing, packing, simhash, substring, toxicity
from noticelake.llm.queries import CAPACITY, LANGUAGE_WEIGHTS, cluster_of, tree
from noticelake.llm.store import free_names, keep

#: Part of the tokens that mixing keeps, each document at most once.
MIX_SHARE = (9, 10)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    lexicon, coefficients = toxicity.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, lexicon, coefficients)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: sets of
    five-word shingles whose cosine, the similarity that SimHash estimates, is
    four fifths or more.  All pairs with a Jaccard share of that are among them."""
    groups = simhash.components(docs, n=5, mins=8, cosine=True)
    (name,) = free_names(docs, "stays")
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of twenty words that occur earlier."""
    return substring.dedup(docs, 20).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, from languages and sources by their weights."""
    weights = {"lang": LANGUAGE_WEIGHTS | {"*": 5}}
    mix = mixing.plan(docs, tree(), weights, MIX_SHARE, 1, "pipeline")
    return mixing.select(docs, tree(), mix, "pipeline").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of a document in sequences of equal length."""
    return packing.pack(docs, mixing.n_tokens(F.col("text")), F.col("source"), cluster_of(F.col("text")), CAPACITY)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", drop_repeated_passages), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Stages that score, hash with XXH64 and pack one by one are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each kept as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
