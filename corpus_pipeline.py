"""A training-data pipeline over ``documents``, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns what stays; stages are written
to the shared folder and read again, so a lost executor never costs more than
one stage. All stages but the last return the columns of documents, extra ones and
names of the operators' own included. Once a stage is written, the tables it was made
from are deleted; the last one stays for the caller (``store.sweep`` deletes it).

Defined results: null texts go at the first stage, as do all without a letter; rows
with a null id stay through all stages, each for itself; nulls in other columns change
nothing (a null source is a source of the mixture). Repeated rows are one document from
the second stage on. Empty tables give empty results; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm import decontaminate, language_id, mixing, prob_minhash, secret_scan, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or unlike all languages learned, go."""
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id; of equal rows one."""
    return prob_minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an empty benchmark drops none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; n_chars follows changed texts."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often."""
    return mixing.sample(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: Trained models and hashed searches have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = store.mark()
    for name, stage in STAGES:
        docs = store.shelve(stage(spark, docs, sf_dir), f"pipeline-{name}")
        store.sweep(spark, since, keep=docs)
    return docs
