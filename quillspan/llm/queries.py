"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import ann, balls, decontaminate, divergence, jaccard, lm, mixing, oracles, substring, suffix, token_counts, token_store, toxicity, warc
from .common import read

#: Folder of public tokenizer files; a parameter of the operators.
TOKENIZERS = os.environ.get("QUILLSPAN_TOKENIZERS", "")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op2_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(read(spark, sf_dir, "documents")).drop("spans")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_file_table(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


def op6_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(read(spark, sf_dir, "documents")).drop("factors")


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.compress(read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_difference_cover": op2_difference_cover,
    "op3_token_store": op3_token_store,
    "op4_toxicity": op4_toxicity,
    "op5_multi_index": op5_multi_index,
    "op6_partenum": op6_partenum,
    "op7_relative_lz": op7_relative_lz,
    "op8_warc_salvage": op8_warc_salvage,
    "op9_entropy_mix": op9_entropy_mix,
    "op10_decontaminate": op10_decontaminate,
    "op11_whole_token_counts": op11_whole_token_counts,
    "op12_ball_codes": op12_ball_codes,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op2_difference_cover": oracles.OP2,
    "op6_partenum": oracles.OP6,
    "op7_relative_lz": oracles.OP7,
    "op8_warc_salvage": oracles.OP8,
    "op10_decontaminate": oracles.OP10,
    "op12_ball_codes": oracles.OP12,
    "op13_source_divergence": oracles.OP13,
}
