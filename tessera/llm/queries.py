"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, decontamination, embedding_dedup, jaccard_join, katz, language_id, token_counts, toxicity, warc
from tessera.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.contract(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embedding_dedup.op1,
        "op2_chat_format": chat.op2,
        "op3_bpe_tree": op3,
        "op4_toxicity_fm": op4,
        "op5_language_kn": op5,
        "op10_jaccard_join": jaccard_join.op10,
        "op6_katz_scores": katz.op6,
        "op7_warc_derivatives": warc.op7,
        "op9_decontamination": decontamination.op9,
        "op8_token_counts": op8,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": embedding_dedup.OP1_SQL, "op2_chat_format": chat.OP2_SQL, "op10_jaccard_join": jaccard_join.OP10_SQL}
