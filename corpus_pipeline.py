"""A training-corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and is written as Parquet
before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabkit.llm.decontam import decontaminated
from tabkit.llm.frames import discard, documents, written
from tabkit.llm.langid import with_language
from tabkit.llm.ngram_join import one_of_each
from tabkit.llm.packing import best_fit_packing
from tabkit.llm.substring_dedup import cut_earlier_passages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language is undetermined, go."""
    return with_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the least doc_id stays."""
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out."""
    return cut_earlier_passages(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language),
    ("ngram_join", near_copies),
    ("substring_dedup", passages),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Suffix automata, profiles and packing are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; a stage's table goes once the next one is written, and the last when the driver ends."""
    out, before = documents(spark, sf_dir), None
    for _, stage in STAGES:
        out = written(stage(spark, out, sf_dir))
        if before is not None:
            discard(before)
        before = out
    return out
