"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, documents, labels
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.near_dedup import drop_near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import keep_good
from tidemark.llm.suffix_dedup import drop_repeated_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal documents stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 and more."""
    return drop_near_duplicates(docs, words=5, percent=80, rows=4)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur twice are cut out; every document stays, with its new length.

    200 bytes are some 35 words of running text, so a passage of over 50 words is found whole, unless its words have less
    than three letters on average.
    """
    cut = drop_repeated_passages(docs, length=200)
    return cut.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in cut.columns else cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("passage dedup", passages), ("packing", packing)]

#: Learned scores and the packing have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
