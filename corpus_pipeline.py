"""The corpus pipeline: quality rules, quality classifier, line dedup, n-gram Jaccard join, best-fit packing.

Each stage works on all that the one before it kept. `STAGES` are run and written one after the other; `run` does so with
Parquet in the folder that all executors share, and deletes each table once the next stage has read it.

Rows with a null id or text, repeated rows, empty and very long texts pass through as each stage defines: texts null, empty
or without words go at the first stage; the classifier judges rows apart; line dedup and the join leave rows with a null id
as they are; packing cuts long texts. Extra columns of documents stay up to the last stage. Empty tables give an empty
result, and without labels every text with words passes the classifier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import kneser_ney, line_dedup, ngram_join, packing, quality_rules
from tideline.sources.checkpoint import delete_folder, release, shared_folder


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return quality_rules.clean_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's quantile among trusted documents."""
    return kneser_ney.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines."""
    return line_dedup.dedup_documents(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [("quality rules", rules_stage), ("quality classifier", classifier_stage), ("line dedup", lines_stage), ("n-gram Jaccard join", join_stage), ("best-fit packing", packing_stage)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and reread by the next stage."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            release(spark)
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
