"""The corpus pipeline: raw documents to packed training sequences.

Each stage works on all rows that the one before it kept, is written as Parquet and read
again. All but the last return the columns of documents, further ones of any name included;
an empty table stays empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm.common import settle
from gaugeworks.llm.exact_dedup import keep_first
from gaugeworks.llm.language import identify, train_model
from gaugeworks.llm.mixing import mixed_documents
from gaugeworks.llm.near_dedup import keep_near_first
from gaugeworks.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those far from
    every known language. Null languages and ids teach or name nothing but stay; repeated
    rows are judged alike; an empty table, or one without a language, gives an empty result."""
    return identify(docs, train_model(docs), keep_only=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the one with the smallest doc_id stays; of repeated ids one
    row, null ids only where all are null. Null texts equal empty ones."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; ties and
    nulls as in exact_dedup. Texts without words stay."""
    return keep_near_first(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in training order. Texts without words
    are not taken; null sources are one source; ties of ids are broken by row number."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a training sequence; a null or empty text is one
    piece, repeated rows are packed each for itself."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = settle(out)
    return out
