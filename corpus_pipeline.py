"""Corpus pipeline: quality classifier, near-dedup, suffix-array dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents: doc_id, text, lang, source, n_chars. Stages that send
texts to Python workers limit the bytes of the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import gone_at_exit, scratch, small_batches
from corvane.llm.decontaminate import decontaminate
from corvane.llm.near_dedup import near_dedup
from corvane.llm.packing import pack
from corvane.llm.quality import THRESHOLD, fit_quality, fold, score_quality
from corvane.llm.suffix_dedup import dedup_text

#: Bytes of words that a packing worker remembers, until its task ends: the workers live on through the other stages, which need the memory.
MEMO_BYTES = 8 << 20
#: Bytes of text that it encodes together: their words' arrays take many times that.
TEXT_BYTES = 1 << 20
#: Near-duplicates share 80 % of their 5-word shingles; with 9 chunks of 5 min-hashes such a pair shares no key with a probability of about 6e-6.
NEAR = {"words": 5, "share": 80, "chunks": 9, "width": 5}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents scored below the threshold.

    Null and empty texts are scored as one empty line; repeated rows go or stay together;
    a null doc_id is no reason to go; an empty table stays empty.
    """
    small_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    return score_quality(docs.select(*COLUMNS), model).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates, that with the smallest doc_id (a null one is the smallest).

    Repeated rows leave one; texts without words (null, empty) are near-duplicates of
    nothing but their own repeated rows; columns beyond those of documents go.
    """
    small_batches(spark)
    return near_dedup(docs, **NEAR).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that a 100-byte string starting earlier in the corpus covers; n_chars follows the text.

    Every row stays: a null text stays null (n_chars too), a text may become empty. "Earlier" is by doc_id, nulls first.
    """
    small_batches(spark)
    return dedup_text(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that benchmark items contaminate; null and empty texts stay, an empty benchmark removes nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of 2048 ids; a row for each piece, with its ids. Null and empty texts are their end id; repeated rows are packed as often."""
    small_batches(spark)
    return pack(docs, with_ids=True, memo_bytes=MEMO_BYTES, keep=False, text_bytes=TEXT_BYTES)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]

#: Classifier, passages and packing can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(gone_at_exit(spark, path))
    return STAGES[-1][1](spark, docs, sf_dir)
