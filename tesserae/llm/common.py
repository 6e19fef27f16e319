"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, spread

#: Rows of one Arrow slice that the Python helpers look at together; bounds the memory of a worker.
SLICE_ROWS = 256
SLICE_BYTES = 2 << 20


#: Folders that ``staged`` wrote within an open ``passing`` block.
_written: list[list[str]] = []


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write  # the native buffers of a zstd writer for each of many small files add up
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    written(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, path: str) -> None:
    """Put a folder down for the ``passing`` block around, if there is one."""
    if _written:
        _written[-1].append(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged within: results made from it must be written by then."""
    _written.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _written.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def deleted(df: DataFrame) -> None:
    """Delete the folders of a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds few rows and, but for one long row, few bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # an idle worker keeps no room of its last task


def by_slices(texts: pa.Array, rows: int = SLICE_ROWS) -> Iterator[list[str]]:
    """A text column as Python strings, null as the empty string, a slice at a time."""
    for batch in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], rows):
        yield texts_of(batch)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


#: Rows of an Arrow batch between the JVM and a worker at most: ten thousand long texts are too many.
BATCH_ROWS = 1_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have ``BATCH_ROWS`` rows at most."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, BATCH_ROWS)
    return df


def docs_of(df: DataFrame, *extra: str) -> DataFrame:
    """``doc_id, text`` (and ``extra``) alone, so that other columns never clash or travel."""
    df = short_batches(df)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
