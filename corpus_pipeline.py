"""A corpus pipeline: five stages, each one of the operators in ``tarn.llm``, from documents to packed sequences.

Every stage but the last returns the columns of its input; its result is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import langid, mixing, ngram_join, packing, secrets
from tarn.llm.common import keyed, read, stage, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters, and those that are foreign to every language that was learned."""
    added = tuple(unused(docs, "_lang", "_score", "_foreign"))
    found = langid.classify(docs, added=added)
    return found.filter(langid.has_letter(F.col("text")) & ~F.col(added[2])).drop(*added)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group that n-gram Jaccard links join: the smallest doc_id, rows without one last.

    Rows that share a doc_id, or have none, stay if their texts do not link.
    """
    (row,) = unused(docs, "_row")
    rows = keyed(docs, row)
    first = ngram_join.join_rows(rows, key=row).filter("first").select(row)
    return rows.join(first, row, "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact all secrets; the documents stay."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the mix takes, row by row; a document taken twice comes twice."""
    row, copies, copy = unused(docs, "_row", "_copies", "_copy")
    rows = keyed(docs, row)
    taken = mixing.mix(rows, row=row).filter("taken > 0").select(row, (F.col("taken") / F.col("size")).cast("int").alias(copies))
    return rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Training, links by set similarity and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
