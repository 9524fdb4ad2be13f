"""From ``documents`` to a mix of sources: five stages, each a table that the next one reads.

Quality rules drop documents, line dedup deletes later copies of repeated line runs (documents with
no line left go), SimHash keeps one document of each near-duplicate group, decontamination drops
documents that benchmark passages cover, and mixing says how many words of each document the mix takes.

Defined results: each stage treats nulls, empty and very long texts, ties and repeated rows as its operator's docstring says. Null and
empty texts have fewer than ten words and go at the first stage; of rows that repeat an id and a text one stays after the
third; columns beyond those of documents are carried along to the last stage, which drops them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from emberlog.llm.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.without_repeated_lines(docs)
    left = F.col("_emberlog_n_lines") > F.col("_emberlog_n_removed")
    rows = rows.filter(left | (F.col("_emberlog_n_removed") == 0))
    return rows.withColumn("n_chars", F.when(F.col("_emberlog_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_copies), ("decontaminate", benchmarks), ("mix_sources", mix)]

#: SQL has neither XXH64 nor the mix's pseudorandom draws; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
