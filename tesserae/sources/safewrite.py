"""Rewrite plans applied safely: back up, write, verify, then let it count; or nothing happens.

The raw notes are a table of a ``NoteLog``.  A plan is a version of it; its backup holds the rows
that it touches as they were.  Until its mark is written a version counts for nothing, so that a
failure at any step leaves the old rows as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .notelog import NoteLog

RAW = "path string, raw string"


class PlanError(RuntimeError):
    """A plan that wasn't applied, and at which step: plan, backup or write."""

    def __init__(self, step: str, reason: str) -> None:
        super().__init__(f"{step}: {reason}")
        self.step = step


def raw_notes(log: NoteLog) -> DataFrame:
    return log.rows("raw", RAW, "path")


def start(log: NoteLog, notes: DataFrame) -> None:
    """The notes as they are, as version 0."""
    log.put(0, "raw", notes.select("path", "raw"), "path")
    log.mark(0, base=True)


def _sum(rows: DataFrame) -> tuple[int, int]:
    """How many rows there are, and what tells them apart, whatever their order."""
    h = F.xxhash64("path", "raw")
    return tuple(rows.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def apply_plan(log: NoteLog, plan: DataFrame, keep: int = 10) -> int | None:
    """Apply ``plan(path, new_raw)``; the version written, or None for a plan that changes nothing.

    A plan names notes that exist, each once.  The newest ``keep`` backups stay; older ones go
    only after all went well.
    """
    spark, version = log.spark, log.live()[1][-1] + 1
    new = plan.select("path", F.col("new_raw").alias("raw"))
    old = raw_notes(log).join(new.select("path"), "path", "left_semi")
    n, names = plan.agg(F.count("*"), F.count_distinct("path")).first()
    if not n:
        return None
    backup = f"{log.root}/_backups/{version:012d}"
    try:
        old.write.mode("overwrite").parquet(backup)
        saved = spark.read.schema(RAW).parquet(backup).count()
    except Exception as e:
        raise PlanError("backup", str(e).split("\n")[0]) from e
    if not n == names == saved:
        _drop(log, [version])
        raise PlanError("plan", f"{n} rows, {names} notes, {saved} of them known")
    try:
        log.put(version, "raw", new, "path", new.select("path"))
        written = spark.read.schema(RAW).parquet(f"{log.root}/raw/v={version}")
        if _sum(written) != _sum(new):
            raise OSError("the rows written aren't those of the plan")
    except Exception as e:  # nothing counts yet; a later version writes over what is there
        raise PlanError("write", str(e).split("\n")[0]) from e
    log.mark(version)
    kept = backups(log)
    _drop(log, kept[: max(0, len(kept) - keep)])
    return version


def roll_back(log: NoteLog, version: int) -> int:
    """Give the notes that a plan touched the text they had before, as a new version; what later plans made of them is lost."""
    if version not in backups(log):
        raise PlanError("backup", f"none of version {version}")
    old = log.spark.read.schema(RAW).parquet(f"{log.root}/_backups/{version:012d}")
    back = log.live()[1][-1] + 1
    log.put(back, "raw", old, "path", old.select("path"))
    log.mark(back)
    return back


def backups(log: NoteLog) -> list[int]:
    """Versions whose backups are there, oldest first."""
    path, fs = log._path("_backups")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []


def _drop(log: NoteLog, versions: list[int]) -> None:
    for version in versions:
        path, fs = log._path(f"_backups/{version:012d}")
        fs.delete(path, True)
