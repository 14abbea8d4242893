"""A training-corpus pipeline: documents in, packed sequences out.

Each stage reads the whole table that its predecessor wrote and decides for
every row of it: toxic documents go, one document of each near-duplicate group
stays, later copies of repeated passages are cut out, and what is left is
packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scribeframe.llm.packing import pack
from scribeframe.llm.simhash import drop_near_duplicates
from scribeframe.llm.suffix_dedup import FIRST, remove_repeats
from scribeframe.llm.toxicity import drop_toxic, train
from scribeframe.session import ship_package, stage

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't predicted toxic; learnt from the labels of these documents."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return drop_toxic(docs, train(docs, labels))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (fingerprints within three bits)."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the later copies of every repeated string of 200 bytes."""
    ship_package(spark)
    return remove_repeats(docs, keep=FIRST)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1024 tokens."""
    ship_package(spark)
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("suffix_array", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the work folder and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        rows = stage(step(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
