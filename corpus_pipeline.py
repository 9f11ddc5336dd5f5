"""Corpus pipeline over the documents table: quality, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage returns as Parquet into the
shared checkpoint folder and hands the reread table to the next stage. All stages but the last return the columns of
``docs``; the last adds epoch, n_tokens and take_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilia.llm import decontam, linededup, mixing, quality, simhash
from vigilia.llm.catalog import WEIGHTS, tree_levels
from vigilia.llm.common import shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose predicted quality is 0."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that stand on 10 sources or more from all documents but the first that holds them."""
    return linededup.remove_boilerplate(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component (3-word shingles, 2 bits)."""
    return simhash.simhash_dedup(docs, shingle=3, max_bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-weighted mix over domain, language and source: 60 % of the tokens, 3 epochs at most."""
    return mixing.mix(docs, tree_levels(), WEIGHTS)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None  # learned scores and XXH64 fingerprints have no SQL form; tests/llm holds the stages against brute force
