"""The corpus pipeline: documents through the stages below, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of ``documents``; where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import toxicity as toxic
from stratum.llm.labels import remainder
from stratum.llm.line_dedup import remove_later_lines
from stratum.llm.near_duplicates import without_near_duplicates
from stratum.llm.packing import pack
from stratum.llm.repeats import remove_repeats
from stratum.llm.shared import new_folder
from stratum.llm.tables import free_name

#: Documents that score as much or more go.
TOXIC = 0.7
#: A document that would be left with less of its characters by the removal of lines is a copy, which the next stage judges whole.
WHOLE = 1 / 3


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic; it learns from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 3) != 1)
    name = free_name(docs, "toxicity")
    scored = toxic.score(docs, toxic.fit(docs, labels), name=name)
    return scored.filter(F.col(name) < TOXIC).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that a similar line precedes, in this document or another; every document stays, whole where hardly anything would be left."""
    return _recounted(remove_later_lines(docs, whole=WHOLE))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), and one row of those that stand repeatedly."""
    return without_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the bytes of strings of 400 that start elsewhere too, and without passages of 50 words that do; every document stays."""
    return _recounted(remove_repeats(docs, 400, words=50))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_folder(spark, name))
        docs = spark.read.parquet(path)
    return docs
