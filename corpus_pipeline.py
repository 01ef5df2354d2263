"""The corpus pipeline: five stages from documents to token ids.

All stages read whole texts, take a null text for an empty one, keep all columns of documents whatever they are called, and
give an empty table for an empty one. A row is a document: ids may repeat or be null. Where they are, rows are numbered in
the order of their ids (nulls last) and texts, and the numbers stand for the ids in what a stage compares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.llm.bpe import bpe_encode
from hostloom.llm.decontaminate import without_contamination
from hostloom.llm.exact_dedup import exact_dedup
from hostloom.llm.language_id import UNDETERMINED, detect_language, train
from hostloom.llm.minhash_dedup import near_dedup
from hostloom.llm.scratch import Scratch
from hostloom.llm.sieve import without

#: Least posterior probability of the predicted language.
LEAST_SCORE = 0.4
KEY = "\0key"


def named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a number for each row: the id where ids are unique, else the row's place in the order of ids and texts."""
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if again.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.asc_nulls_last("doc_id"), "text")
    return scratch.cut(ordered.withColumn(KEY, F.monotonically_increasing_id()))


def drop_copies(docs: DataFrame, judge) -> DataFrame:
    """docs without the rows that judge, given rows KEY and text, doesn't keep."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs, scratch)
    dropped = scratch.cut(judge(rows.select(KEY, "text")).filter(~F.col("kept")).select(F.col("doc_id").alias(KEY)))
    return without(rows, dropped, KEY).select(*named(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts among them), and those whose language is a toss-up. Rows
    stand for themselves: repeated ones stay or go alike."""
    judged = detect_language(docs, train(docs), keep=docs.columns)
    kept = judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"`kept_{c}`").alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one stays: that of the smallest id, null being the largest; any of rows that repeat it."""
    return drop_copies(docs, lambda rows: exact_dedup(rows, KEY))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity of 0.8), the row of the smallest id stays. Texts
    without a word are no copies of each other here."""
    return drop_copies(docs, lambda rows: near_dedup(rows, KEY, size=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: four fifths of its shingles of five words. Items of fewer words are no
    sign of a leak and are passed over. Repeated rows stay or go alike."""
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the SHA-256 of what they decode to, with its columns but the text, which the ids stand for. A
    column called n_tokens, ids or decoded_sha256 is kept with an underscore before its name."""
    return bpe_encode(docs, keep=[c for c in docs.columns if c != "text"], decoded="digest")


STAGES = [("language ID", language_id), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", decontaminate), ("BPE encoding", encode)]

#: SQL can express neither the language model nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again as the next one's input."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
