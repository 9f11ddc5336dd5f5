"""Helpers shared by the training-data operators.

Rows of a documents table are told apart by (id, hash of the text): rows that agree in both are interchangeable,
so no operator needs a generated row number and a recomputed task gives the same keys.
"""

from __future__ import annotations

import itertools

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilia.session import checkpoint, ensure_checkpoint_dir  # noqa: F401

_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{spark.sparkContext.applicationId}-{spark.sparkContext.startTime}-{next(_serial)}"


def write_cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    return checkpoint(df)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def text_key(col: str = "text") -> Column:
    return F.xxhash64(text_of(col))


def row_key(doc_id: Column, key: Column) -> Column:
    """One string for (id, text hash), null ids included: an equi-join key."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), key.cast("string"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def count_threshold(words: DataFrame, limit: int) -> int:
    """Smallest power of two that at most ``limit`` of the counts ``n`` reach (the histogram has 63 rows at most)."""
    held = {r["e"]: r["k"] for r in words.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("e")).agg(F.count("*").alias("k")).collect()}
    total, least = 0, max(held, default=0) + 1
    for e in sorted(held, reverse=True):
        total += held[e]
        if total > limit:
            break
        least = e
    return 1 << least


def lower_words(text: str) -> list[bytes]:
    """A-Z in lower case, split on ASCII white space (bytes.lower and bytes.split do just that)."""
    return text.encode("utf-8", "replace").lower().split()


class WordHash(dict):
    """word -> 64-bit hash, kept for the words seen last (bounded)."""

    LIMIT = 1 << 19

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h
