"""From raw documents to token ids, stage by stage.

Every stage works on all that the stage before it kept; `run` writes each stage's rows as Parquet in the
shared folder and reads them again, so a lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import bpe, mixing, quality, repeats, simhash
from quillon.llm.common import shared_table
from quillon.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base check passes and whose posterior quality reaches one half."""
    return quality.judged(quality.with_counts(docs.select(COLUMNS))).where("kept").select(COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest id; documents without an id come last."""
    return simhash.without_near_duplicates(docs.select(COLUMNS)).select(COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document of a smaller id has in a common string of 50 bytes.

    A character of which only a part was removed goes whole. Documents that lose all their text stay as empty ones.
    """
    found = repeats.without_repeats(docs.select(COLUMNS))
    changed = F.size("spans") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    cleaned = found.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text)).otherwise(F.col("n_chars")).alias("n_chars"))
    return cleaned.select(COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(docs.select(COLUMNS)).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    words = vocabulary()
    named = docs.select(F.struct("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("key"), "text")
    back = bpe.encoded(named, words, key="key", into="decoded")
    return back.select(
        "key.doc_id", "key.lang", "key.source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("key.sha")).alias("round_trip")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_sources", mixing_sources),
    ("byte_bpe", byte_bpe),
]
#: The label model, the fingerprints' hash and the tokenizer's pattern have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
