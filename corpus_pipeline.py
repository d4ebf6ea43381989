"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Rows are judged by their own text, also where several share a doc_id or have none; a NULL text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moralens.llm import decontaminate, mixing, near_dups, quality, secret_scan
from moralens.llm.registry import read
from moralens.staging import release, stage


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; repeated rows all stay or all go, empty texts have a score too."""
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id.

    Rows of that id and class but of another text digest, and repeated rows, leave one; rows without an id come last.
    """
    return near_dups.first_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold half of a benchmark item or more; of rows that share an id only those with such a text go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; NULL texts stay NULL, n_chars follows the text."""
    return secret_scan.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per draw of the mixture, with its training position, sorted by it, ties by doc_id.

    Documents without words are not drawn; a NULL source is a source of its own.
    """
    return mixing.training_order(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: Models, signatures and segmentation costs are beyond SQL; tests hold every stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every stage reads what the one before has written, which then goes."""
    docs, written = read(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        if written is not None:
            release(written)
        written = docs
    return docs
