"""The corpus pipeline: stages applied one after another to the documents table.

Each stage works on all rows that its predecessor kept and returns the columns of `documents`; the last writes token-ID
files and returns what they hold. Rows that share a doc_id share a decision. Null and empty texts, null ids and extra
columns pass as each operator's docstring says; empty tables give empty results; texts are taken whole at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import op3_tokens, op4_mixing, op7_toxicity, op9_jaccard, op10_decontam
from gridloom.llm.common import discard, shared_dir, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The machine learns from the labels of the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op7_toxicity.reject(docs, op7_toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest id: texts link from a Jaccard likeness of 0.8 of their 5-word shingles on."""
    return op9_jaccard.keep_one(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    return op10_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return op4_mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the token-ID files."""
    return op3_tokens.write_and_read(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_ids),
]

#: Learnt models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path, before = f"{base}/{k}-{name.replace(' / ', '-').replace(' ', '-')}", written()
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, before)  # what the stage wrote for itself
        docs = spark.read.parquet(path)
    return docs
