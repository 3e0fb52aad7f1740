"""A corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import common, lines, packing, quality, secrets, shingles


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those of few words, of repeated windows, or outside the compression
    bands of their length. Null, empty and blank texts have no words and go; very long ones are judged whole; equal rows
    share their fate; an empty table stays empty. Extra columns of any name are kept."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; the documents stay, if empty. A null text stays null; of equal runs the first place - a
    null id, else the smallest - keeps its lines; rows equal in id and text are one place. An empty table stays empty.
    Extra columns of any name are kept."""
    return lines.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays - five-word shingles, Jaccard similarity 0.8 or more -, that of
    a null id, else of the smallest. Null, empty and blank texts are one component; of equal rows one stays; an empty
    table stays empty. Extra columns of any name are kept."""
    return shingles.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; all documents stay. A null or empty text stays as it is; very long
    ones are scanned whole; equal rows stay equal; an empty table stays empty. Extra columns of any name are kept."""
    return secrets.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences: a row for each piece, other columns left out. A null or empty text is
    its end token alone; equal rows are packed each; an empty table gives no pieces."""
    return packing.digest_columns(packing.packed(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("pack", pack),
]

#: SQL has neither zstandard ratios nor tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        common.given_up(last)  # no later stage reads it
    return STAGES[-1][1](spark, docs, sf_dir)
