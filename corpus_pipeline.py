"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before it kept, and returns a DataFrame: all but the last
the columns of documents, the last one row for each packed piece.  run() applies them in turn, each result written as Parquet
to the shared folder and read again; what a stage has read is then removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import remove_dir, shared_dir
from marlstone.llm.decontaminate import drop_leaks
from marlstone.llm.ngram_join import first_of_each
from marlstone.llm.packing import pack
from marlstone.llm.quality_rules import keep_quality
from marlstone.llm.queries import byte_bpe
from marlstone.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, byte_bpe())


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontaminate", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]
ORACLE_SQL = None  # expectation-maximisation and BPE have no SQL form; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return docs
