"""Cleaning of a document table in stages, each written to the shared folder and reread.

``STAGES`` names the stages in order; each is called with the documents its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, pieces, simhash, toxicity
from millrace.llm.common import stored

TOXIC = 0.5


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels, is below ``TOXIC``."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon, into="_toxicity").where(F.col("_toxicity") < TOXIC).select(docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three or more documents stay only in the last of them."""
    rows = line_dedup.dedup_lines(docs, into="text")
    return rows.select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.drop_near_duplicates(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the text they decode to."""
    import public_tokenizers

    rows = pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", unrepeated_lines),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Learned scores and the tokenizer's ids are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
