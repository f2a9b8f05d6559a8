"""Training-data pipeline over ``documents``: quality, near-duplicates, repeats, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents`` (``n_chars`` follows the text).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import ngram_join, packing, quality, secrets, suffix_dedup
from ledgerspark.llm.common import ship_package, stored, table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and with them null, empty and blank texts. Repeated rows are judged alike,
    rows under one id each by its own text, rows without an id without labels; an empty table stays empty."""
    seen = quality.evidence(docs.withColumn("_text_hash", F.xxhash64("text")), table(spark, sf_dir, "labels"), carry=("doc_id", "_text_hash"))
    rejected = quality.score(seen, quality.fit(seen)).where("NOT keep").select("doc_id", "_text_hash").distinct()
    return without(docs.withColumn("_text_hash", F.xxhash64("text")), rejected, ["doc_id", "_text_hash"]).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, by the smallest id; of repeated rows one. Different texts under
    one id are documents of their own; rows without an id and null or blank texts have no class and stay (repeated ones of
    one id once); an empty table stays empty."""
    classes = ngram_join.jaccard_classes(docs, with_hash=True).where("doc_id IS NOT NULL")
    # a key goes where no row of it is kept; where several rows have it, one stays
    keys = classes.groupBy("doc_id", F.col("text_hash").alias("_text_hash")).agg(
        F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT _kept")
    return without(docs.withColumn("_text_hash", F.xxhash64("text")), keys, ["doc_id", "_text_hash"], once="_kept").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; the cut widens to whole characters. Every row stays, with what is left of
    its text; a null text stays null, an empty one empty."""
    return suffix_dedup.cut_repeats(docs).transform(lambda d: _with_text(d, F.col("text")))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask. Every row stays; a null text stays null, an empty one empty, and an empty table empty."""
    return secrets.redact(docs, secrets.train(docs)).transform(lambda d: _with_text(d, F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null or empty text is one piece with the end id; repeated rows are packed
    each on their own; an empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("repeats", repeats),
          ("secrets", secret_redaction), ("packing", pack)]

#: EM, Markov models and least squares have no SQL; tests/llm/test_quality_pipeline.py checks each stage's rows by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
