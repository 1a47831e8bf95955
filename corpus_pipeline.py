"""A corpus from documents: language, toxicity, near-duplicates, benchmark leaks, then tokens.

Each stage takes what the one before kept, as a Parquet table, and its decisions take effect: rows go, columns stay. Only the
last returns other columns. Null or empty texts, which have no language, go in the first stage; every stage takes empty tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, jaccard_join, language_id, toxicity
from tessera.llm.common import table, written
from tessera.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages that models fitted on docs know; those they reject go."""
    marked = language_id.identified(docs, language_id.fit(docs))
    return marked.filter(~F.col(marked.columns[-1])).select(*docs.columns)


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the machine, fitted on the labels of docs, scores below one half."""
    marked = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return marked.filter(F.col(marked.columns[-1]) < 0.5).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that n-gram Jaccard similarity links."""
    return jaccard_join.representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item within the budget of edits."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text again."""
    out = bpe.encoded(docs, tokenizer("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("toxicity", filter_toxicity),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("BPE encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Fitted models and edit distance can't be put in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None
