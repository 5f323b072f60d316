"""The corpus pipeline: five of the llm operators over ``documents``, each stage written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import read, scratch_path
from factloom.llm.jaccard_join import keep_one_of_each
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.mixing import mix
from factloom.llm.packing import pack
from factloom.llm.quality import keep_good
from factloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first that holds them; ``n_chars`` follows the text."""
    found = dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target mixture, in a global random order."""
    return mix(docs, temperature=0.5, epochs=1.0, seed="mix").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack(docs, vocabulary(), 2048)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: SQL can't express the fitted quality score or the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
