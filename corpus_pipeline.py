"""Corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; other
columns are not read. An empty table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, lines, mixing, packing, quality
from lodestone.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep; a null or empty text fails the base rules."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand earlier; a document whose lines all go is dropped, n_chars follows the text.

    Null and empty texts lose nothing and stay, as do rows without a doc_id.
    """
    out = lines.dedup_lines(docs.select(*COLUMNS)).where("n_lines_removed = 0 or text rlike '[^\\\\s]'")
    size = F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of five-word shingle similarity 0.8 or more.

    Rows, not ids, go: rows of one doc_id with different texts are judged each by its own, and of rows with the same
    doc_id and text one stays. Rows without a doc_id and texts without a word stay as they are.
    """
    key = ["doc_id", "text_hash"]
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    classes = Scratch(spark, "pipeline").keep(jaccard.near_duplicates(docs, k=5, num=4, den=5).select(*key, "group"), "classes")
    best = classes.where("group is not null").groupBy("group").agg(F.min(F.struct(*key)).alias("best"))
    rows = classes.where("doc_id is not null").groupBy(*key, "group").agg(F.count("*").alias("n")).join(best, "group", "left")
    gone = rows.where(F.struct(*key) != F.col("best")).select(*key)
    again = rows.where(F.struct(*key).eqNullSafe(F.col("best")) & (F.col("n") > 1)).select(*key)
    kept = docs.join(gone.unionByName(again), key, "left_anti")
    return kept.unionByName(docs.join(again, key, "left_semi").dropDuplicates(key)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards smoothed shares of sources, languages and topics; nulls are values of their own."""
    return mixing.mix_sources(docs.select(*COLUMNS)).where("sampled").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sampled documents in sequences of 2048 tokens; a null text is one token, its end."""
    out = packing.pack(docs, power=packing.POWER)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Hashed ratios, rolling boundaries, raking and tokenizers are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
