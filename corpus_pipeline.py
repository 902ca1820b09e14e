"""A training-corpus pipeline: each stage applies one operator to all documents that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined results, in every stage: an empty table stays empty; rows without an id or a text are handled as their stage
says; texts are processed whole, however long; extra columns stay, whatever they are called, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ebbflow.llm import minhash_dedup, packing, secret_scan, suffix_dedup, toxicity
from ebbflow.llm.common import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    A null or empty text is judged as one without features; rows without an id and repeated rows are judged each by
    its text; without labels of both classes the verdict is that of the labels there are (none: all stay).
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id, which wins all ties.

    Documents without words or without an id stay; rows that repeat an id stay or go together.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 bytes or more go; the documents stay.

    A null text becomes an empty one; documents without an id lose nothing; rows that repeat an id cut nothing from each
    other, as neither id is smaller.
    """
    return suffix_dedup.cut_repeats(docs, length=50)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, those without an id or a text too."""
    return secret_scan.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, with_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packed),
]

#: SQL cannot express the classifier, the suffix order or the tokenizer; tests/llm compares every stage's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
