"""A corpus pipeline: language, repeated lines, near duplicates, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``docs``: rejected documents, repeated lines and all but one document of each
group of near duplicates are gone, and a document stands there as often as the mix has it.
The last stage returns where each piece of each document stands in the packed sequences.

A null or empty text has no language and goes in the first stage, so later ones see none; very
long texts are worked on whole; of repeated rows the first three stages keep one, and a line
that ties goes to the lesser ``doc_id``; a null ``doc_id`` is never a duplicate; further
columns, whatever their names, come through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import langid, line_dedup, minhash, mixing, packing
from webloom.llm.base import dropped, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; the others go."""
    return langid.accepted_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line only where it stands first; documents without a line of their own go."""
    return line_dedup.deduplicated_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as equal weights of the sources have them."""
    own = docs.toDF(*(f"own {c}" if c.lower() in ("copy", "copies") else c for c in docs.columns))
    return mixing.mix_sources(own).select(*(f"`{c}`" for c in own.columns)).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces stand in sequences of a fixed number of tokens."""
    return packing.pack(docs)


STAGES = [
    ("language identification", languages),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicates),
    ("mixing sources", mix),
    ("packing", packed),
]

#: SQL has neither the near duplicates' groups nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        found = written(stage(spark, docs, sf_dir), "pipeline")
        if number:
            dropped(spark, docs)
        docs = found
    return docs
