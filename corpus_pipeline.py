"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

quality -> repeated lines -> near-duplicates -> benchmark leaks -> packing.  All stages but the
last return the columns of documents; decisions are taken on what the stage before kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import passing, shared_dir, table
from tesserae.llm.decontaminate import without_items
from tesserae.llm.linededup import drop_repeated_lines
from tesserae.llm.packing import pack
from tesserae.llm.resample import resampled_rows
from tesserae.llm.simhash import near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling draws.

    Every row is weighed by its own text, null as empty, whatever its doc_id; equal rows share
    their fate.  An empty table stays empty.
    """
    return resampled_rows(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that live in another document; n_chars follows the text.

    Null text becomes empty; rows with equal doc_id are one document; rows without one lose
    nothing.  An empty table stays empty.
    """
    done = drop_repeated_lines(docs).withColumn("clean", F.array_join("kept", "\n"))
    own = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    return done.select([own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest doc_id, and of its rows the smallest.

    Rows with equal doc_id are one document.  A row without a doc_id comes after all others and
    is the document of its text; null and empty texts are near copies of each other.  An empty
    table stays empty.
    """
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("k"), F.struct("text", *[F.col(c).alias(f"c{n}") for n, c in enumerate(docs.columns) if c != "text"]).alias("r"))
    first = near_duplicates(rows.select(F.col("k").alias("doc_id"), "r.text")).where("doc_id = component_id").select(F.col("doc_id").alias("k")).distinct()
    return rows.join(first, "k", "left_semi").groupBy("k").agg(F.min("r").alias("r")).select(*[F.col("r").getField("text" if c == "text" else f"c{n}").alias(c) for n, c in enumerate(docs.columns)])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, whatever their doc_id; null and empty texts hold none.

    Items that are null or without words match nothing.  An empty table stays empty.
    """
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in windows of 2048 tokens; null text is empty, rows of equal doc_id are packed one by one."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


STAGES = [
    ("quality", quality),
    ("repeated lines", repeated_lines),
    ("near duplicates", near_duplicate_groups),
    ("benchmark leaks", benchmark_leaks),
    ("packing", packing),
]

#: SQL can't express the learned, hashed and packing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage.  What stages set down for themselves is deleted once they are written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
