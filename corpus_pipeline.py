"""The corpus pipeline: quality rules, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.language_id import fit_language_filters, keep_known_languages
from loam.llm.ngram_join import keep_one_of_each_group
from loam.llm.packing import pack_windows
from loam.llm.pii import redact_texts
from loam.llm.quality_rules import keep_good, learn_quality_rules
from loam.storage import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go."""
    return keep_good(docs, learn_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the labelled languages go."""
    return keep_known_languages(docs, fit_language_filters(docs))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_of_each_group(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts."""
    return redact_texts(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows in which the documents lie."""
    return pack_windows(docs)


STAGES = [("quality rules", quality_stage), ("language id", language_stage), ("n-gram jaccard join", duplicate_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs


#: Learned rules, a trained model and online packing are not SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None
