"""Cleaning and packing a corpus in five stages, each one of the operators of kabunoki.llm.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``, with
n_chars brought up to date where texts change.

Cases, beside those of the operators: an empty table goes through all stages as one; null and empty texts, which have no
language, go in the first stage, and stay in the others but the last, where they have no tokens; rows without id are judged
by their text in the first, fourth and last stage and stay as they are in the others; rows that share an id are treated
alike where lines and near copies are told by it; very long texts are worked on whole; columns beyond those of
``documents`` come along, whatever their names, but for the last stage, which reads none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.llm import bpe, langid, line_dedup, ngram_join, packing, pii
from kabunoki.llm.shared import written


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, or of several, stay."""
    return langid.keep(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones, exactly or nearly, are cut."""
    return _measured(line_dedup.dedup_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near copies stays."""
    return ngram_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kinds."""
    return _measured(pii.deobfuscate(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, cut where they are too long, are assigned to training sequences."""
    return packing.pack(docs, automaton=bpe.load())


STAGES = [("language ID", languages), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("PII", private), ("packing", pack)]

#: Language models, fuzzy lines and the packing's linear program can't be expressed in SQL; tests/llm/test_pipeline.py
#: holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
