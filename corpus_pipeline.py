"""The corpus pipeline: five stages over ``documents``, each one operator of the library.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads back as the next one's ``docs``. All
but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamledger.llm.common import fresh, located, stage
from streamledger.llm.decontaminate import without_leaks
from streamledger.llm.line_dedup import without_repeated_lines
from streamledger.llm.mixing import mixed
from streamledger.llm.near_dedup import one_of_each
from streamledger.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents that were nothing but such lines."""
    row = fresh(docs, "row")
    return without_repeated_lines(located(docs, row), row=row).drop(row)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    row = fresh(docs, "row")
    return one_of_each(located(docs, row), row=row).drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training run: documents in order of their position, once for each pass."""
    row = fresh(docs, "row")
    return mixed(located(docs, row), row=row).drop(row)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: No SQL can express the classifier. The tests hold the operators of the stages against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: its columns, then ``copy``, ``words_taken`` and ``position``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
