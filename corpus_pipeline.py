"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language ID drops documents without a clear language, line dedup takes out repeated lines, SimHash keeps one document of
each near-duplicate group, decontamination drops documents that hold benchmark passages, and BPE encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgrid.llm import bpe, decontaminate, language, lines, simhash
from fieldgrid.llm.common import written
from fieldgrid.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided by dictionaries of the labelled documents; the others go."""
    return language.keep_decided(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; no document goes, and n_chars is counted again."""
    return lines.dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark windows."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text decoded from them."""
    return bpe.round_trip(docs, TOKENIZER).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("bpe_encode", bpe_encode),
]
#: Several stages are no SQL; tests hold the rows against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
