"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.llm import (
    bpe, conversations, embeddings, hard_negatives, html, licenses, packing, pieces, quality_rules, simhash, site_quality, substring,
    toxicity,
)
from fleetlint.llm.common import table


def byte_encoder() -> dict:
    """Where the byte-level vocabulary lies; its ranks are the same vocabulary as ``byte_bpe_50k.json``."""
    return {
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN,
        "special": {"<|endoftext|>": 50256},
    }


def op1_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_html_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents name no address: their source is the host, their language the path on it."""
    return site_quality.scored(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def op6_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.found_licences(table(spark, sf_dir, "documents"))


def op7_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_encoder(), capacity=1024, end_id=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 100 == 0, label=moved)


def op12_suffix_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(table(spark, sf_dir, "conversations"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_subspace_pigeonhole, op2_html_subsequence, op3_toxicity_machine,
    op4_simhash_gray_index, op5_site_quality, op6_license_compression, op7_seed_and_extend, op8_best_fit_packing, op9_quality_rules, op10_bpe_codec,
    op11_kronecker_negatives, op12_suffix_dawg, op13_piece_codec,
)}
