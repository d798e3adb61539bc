"""From raw documents to packed sequences, one stage after the other.

Every stage takes null texts, languages, sources and ids, rows that share an id,
empty tables, and columns of any further names; all but the last return the
columns they were given.  Documents without an id are near-duplicates of
nothing; of rows that share one, all or none stay.  Documents without words pass
the first three stages and are not mixed in.  The result has one row for each
sequence, with the texts of its pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.common import Scratch, table
from tabulon.llm.language_model import keep_good
from tabulon.llm.mixing import mix_documents
from tabulon.llm.ngram_join import one_of_each
from tabulon.llm.packing import pack_documents
from tabulon.llm.substring_dedup import without_repeats


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(spark, docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("n-gram Jaccard join", unique),
    ("suffix-array dedup", unrepeated),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: No SQL expresses the language model or the hash-driven rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
