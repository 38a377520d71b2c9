"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Language ID drops documents in no learned language; exact dedup keeps one document of equal texts; the n-gram Jaccard join
(five words, similarity 0.8 or more) keeps one document of each group; benchmark decontamination drops documents that hold
a benchmark passage; mixing deals the rest into blocks in the order that meets the sources' target weights. Nulls, empty
texts and tables, ties, repeated rows and extra columns have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from enthyme.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join
from enthyme.llm.common import saved, table, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.in_some_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, words=5, similarity=(4, 5))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, "doc_id", saved(found.select("doc_id").distinct(), "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", clean), ("mixing", mix)]

#: The language and mixing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
