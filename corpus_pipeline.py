"""A training corpus from raw documents: harmless, well-formed, without copies and repeats, packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; it returns them with the columns of ``docs``, but for the last,
which returns one row per packed piece.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlint.llm import packing, quality_rules, simhash, substring, toxicity  # noqa: E402
from fleetlint.llm.common import table  # noqa: E402
from fleetlint.llm.queries import byte_encoder  # noqa: E402
from fleetlint.session import materialise  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, fitted on the labels, does not reject."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of quality rules keeps."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of 4-word shingles that differ in 4 bits or fewer, the one with the smallest id."""
    return simhash.one_of_each(docs, shingle=4, radius=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that a document with a smaller id has too."""
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of 1,024 tokens."""
    return packing.pack(docs, byte_encoder(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_duplicates", one_of_each),
    ("repeated_passages", cut_repeats),
    ("packing", pack),
]

#: A learned score and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
