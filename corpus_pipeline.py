"""A corpus for training: documents filtered, mixed and written as token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Its result is
written in the shared folder and read again, so a lost executor costs at most the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylib.llm.common import durable, table, word_count
from quarrylib.llm.decontamination import drop_contaminated
from quarrylib.llm.mixing import mixed_copies
from quarrylib.llm.similar import drop_near_duplicates
from quarrylib.llm.token_files import read_token_files, vocabulary, write_token_files
from quarrylib.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model of the labelled ones among them."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are 0.8 alike or more, that of the least id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, which may be twice or not at all."""
    return mixed_copies(docs, word_count(F.col("text")))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Coded blocks of token ids, read back: each document's place, number of ids and their checksum."""
    return read_token_files(write_token_files(docs, vocabulary()))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: The classifier, the fingerprints and the tokenizer aren't SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
