"""Snapshots of derived tables: written under one id, current only when whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame], snapshot_id: str, keep: int = 5) -> None:
    """Write all tables, then the pointer.  Readers never see half a snapshot; a failed write leaves the old one.

    The snapshot before is the backup: ``restore`` makes it current again.  The newest ``keep`` pointers stay listed.
    """
    for name, df in tables.items():
        df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").parquet(f"{root}/{snapshot_id}/{name}")
    pointers = [r.snapshot_id for r in history(spark, root)][: keep - 1]
    rows = [(snapshot_id, 0, ",".join(sorted(tables)))] + [(p, k + 1, "") for k, p in enumerate(pointers) if p != snapshot_id]
    _point(spark, root, rows)


def _point(spark: SparkSession, root: str, rows: list[tuple[str, int, str]]) -> None:
    spark.createDataFrame(rows, "snapshot_id string, age int, tables string").coalesce(1).write.mode("append").parquet(f"{root}/_pointers/at={_next(spark, root):012d}")


def _versions(spark: SparkSession, root: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    done = [s.getPath() for s in fs.listStatus(hadoop)]
    return sorted(int(p.getName()[3:]) for p in done if p.getName().startswith("at=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _next(spark: SparkSession, root: str) -> int:
    return (_versions(spark, root) or [0])[-1] + 1


def history(spark: SparkSession, root: str) -> list:
    """Pointer rows, the current one first."""
    at = _versions(spark, root)
    return spark.read.parquet(f"{root}/_pointers/at={at[-1]:012d}").orderBy("age").collect() if at else []


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current snapshot; an error if the snapshot isn't one."""
    rows = history(spark, root)
    if not rows:
        raise FileNotFoundError(f"no snapshot under {root}")
    df = spark.read.parquet(f"{root}/{rows[0].snapshot_id}/{name}")
    return df.where(F.col("snapshot_id") == rows[0].snapshot_id).drop("snapshot_id")


def restore(spark: SparkSession, root: str) -> str:
    """Make the snapshot before the current one again."""
    rows = history(spark, root)
    if len(rows) < 2:
        raise FileNotFoundError("no snapshot to go back to")
    _point(spark, root, [(r.snapshot_id, k, r.tables) for k, r in enumerate(rows[1:])])
    return rows[1].snapshot_id
