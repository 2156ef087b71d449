"""The corpus pipeline: from documents to a token store.

``STAGES`` run in order; each takes all that the one before it kept and returns it in the columns of
documents, the last one what it reads back from the store. Every stage's result is written and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, ngram_join, quality, tokens
from quillspark.llm.common import new_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.write(docs, new_path(spark, "tokens")).documents()


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
    ("tokens", _tokens),
]

#: SQL can't express the model, the search or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
