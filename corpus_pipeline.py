"""Corpus pipeline: the stages in order, each a function of (spark, docs, sf_dir) whose result the next one works on.

1. quality classifier: documents that it rejects go;
2. line dedup: lines seen before go, and documents that had lines and lost them all;
3. n-gram Jaccard join on five words at 0.8: one document of each group stays, the least doc_id;
4. mixing sources to target weights: one row for each pass that takes words of a document, cut to those words;
5. packing into sequences of 1024 tokens.

Rows with nulls in any column pass through all stages like others; a null or empty text has no lines, links with nothing
and holds no words, so that mixing leaves it out. Repeated rows are one document to the line and join stages. Further
columns are carried under their names, whatever they are, up to packing. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import lines, mixing, ngram_join, packing, quality
from metaweave.llm._work import Work


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, t="0.8")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs, keep=True).texts()


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality classifier", stage_quality),
    ("line dedup", stage_lines),
    ("n-gram Jaccard join", stage_ngram_join),
    ("mixing sources to target weights", stage_mixing),
    ("packing", stage_packing),
]

#: The classifier, permutations and the tokenizer are beyond SQL. Tests hold lines and joins against brute force here, words taken and packed pieces in the operators' own tests, and the classifier to held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
