"""Corpus pipeline: language, near duplicates, personal data, source mix, tokens.

A stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the columns of
``documents`` (doc_id, text, lang, source, n_chars).  ``run`` writes each stage's result as Parquet into the
shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import bpe, copies, language, mixing, pii
from pointlake.llm.common import store, table
from pointlake.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosine below which a text resembles no learned language.  A random cosine deviates by 0.044, and the
#: cosine of clean text grows with its length, so only texts of at least ``SURE_LETTERS`` letters are judged.
MIN_COSINE = 0.1
SURE_LETTERS = 100


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language.  Rejected: text that is NULL or has no letter, or is long enough to
    judge and resembles no language.  ``lang`` becomes the prediction; with nothing to learn from, no
    document is rejected and ``lang`` stays.  Rows are judged one by one, so repeated rows share their
    fate; other columns are left out; an empty table stays empty."""
    prototypes = language.learn(docs)
    if not prototypes:
        return docs.select(*COLUMNS)
    found = language.predict(docs.select(*COLUMNS), prototypes)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & ((F.col("score") >= MIN_COSINE) | (letters < SURE_LETTERS)))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: groups of near SimHash fingerprints, and minhash bands for the
    pairs these miss, confirmed by whole sets (five-word shingles, Jaccard similarity 0.8 or more, linked through each other): the smallest id (then the least digest of the text, then the first of equal rows);
    groups without an id keep the least digest.  Texts are told apart by their SHA-256."""
    return copies.one_of_each(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by signs such as [EMAIL]; ``n_chars`` follows, a NULL text stays NULL.  Rows are
    treated one by one, so repeated rows stay equal; other columns are left out; an empty table stays empty."""
    found = pii.find_spans(docs.select(*COLUMNS))
    clean = found.withColumn("clean", pii.masked(F.col("text"), F.col("spans")))
    hit = F.size("spans") > 0
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(hit, F.length("clean").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in shuffled order.  A NULL source is a source, a NULL
    text has size 0; repeated rows are drawn together; other columns are left out; an empty table stays empty."""
    return mixing.draw_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with a check that they decode to the text.  A NULL text is empty and has no
    tokens; repeated rows are encoded alike; other columns are left out; an empty table stays empty."""
    coded = bpe.round_trip(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k64")), VOCABULARY, keep=False)
    return coded.select("doc_id", "source", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        (F.xxhash64("decoded") == F.col("k64")).alias("round_trip"), "ids")


STAGES = [("language_id", language_stage), ("near_dedup", dedup_stage), ("pii", pii_stage), ("source_mix", mix_stage), ("bpe", tokens_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
