"""From raw documents to token files: language, near duplicates, benchmark passages, mixture, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafscan.llm.common import keep
from leafscan.llm.decontaminate import uncontaminated
from leafscan.llm.jaccard_join import one_per_group
from leafscan.llm.language_id import known_language
from leafscan.llm.mixing import remixed
from leafscan.llm.token_store import token_output
from leafscan.session import configure

MAX_REPEATS = 2.0
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without letters or a clear language go, repeated rows alike."""
    configure(spark)
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that link at a similarity of 0.75, of the smallest id; texts without words all stay, of repeated rows one."""
    configure(spark)
    return one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none and stay."""
    configure(spark)
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened as far as no document is read more than twice; each is read at least once, null sources are one source."""
    configure(spark)
    return remixed(docs, MAX_REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, read back: ``doc_id, start, n_tokens, ids_crc32``; null texts are empty, null ids come first."""
    configure(spark)
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark),
    ("mixing", mixture),
    ("token_output", tokens),
]
ORACLE_SQL = None  # language scores, hashed permutations and token ids are beyond SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again.

    Every stage takes an empty table, nulls in any column and columns of any
    other name; all but the last return the columns they were given.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
