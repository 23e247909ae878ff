"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet
in the shared folder and read again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optika.llm import common, language_id, mixing, near_dedup, packing, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the language and near-duplicate stages; tests hold the rows against brute force instead.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents and drops those without a language: null texts and texts without a letter.
    A null lang is filled with the prediction; every other document stays as it is.  Rows that repeat a document
    stay.  An empty table gives an empty result."""
    docs = docs.select(*COLUMNS)
    model = language_id.learn(docs)
    return language_id.with_language(docs, model).where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest doc_id; of rows that share a doc_id the
    one of the smallest hash, on every run.  Rows without a doc_id stay."""
    docs = docs.select(*COLUMNS)
    kept = near_dedup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    named = named.groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS[1:]), F.xxhash64(*COLUMNS[1:])).alias("_row")).select("doc_id", "_row.*")
    return named.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words covered by 20-word windows that occur earlier.  A text that loses words becomes its kept words
    joined by spaces, n_chars their length; other rows stay as they are.  A text can become empty."""
    docs = docs.select(*COLUMNS)
    out = substring_dedup.remove_repeats(docs, carry=["lang", "source", "n_chars", "text"])
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a document appears once for each pass that the mix makes over it,
    in curriculum order; the document at the end of a source's last pass is cut there.  Documents that the mix does
    not reach, and empty ones, go."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row of the mix into sequences of at most 1024 tokens; one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to all documents: one row for each piece of a packed sequence, as ``packing.pack`` gives it.  A
    stage's table is dropped once the next one's is written.  Nulls, empty texts and rows that repeat are treated as each stage
    says; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return docs
