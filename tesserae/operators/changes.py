"""Snapshots of files: differences, gates, refresh, fingerprints, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import all_links, line_table
from .search import postings


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` of added, modified (time or size differs) and removed files."""
    a, b = before.select("path", F.struct("mtime_ms", "size").alias("was")), after.select("path", F.struct("mtime_ms", "size").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def delta_gate(touched: int, most: int, parts: int = 1, parts_now: int = 1) -> tuple[str, str]:
    """(delta or full, reason): a delta is applied to few changes of an index that is cut the same way.

    No change at all where the fingerprints differ is not believed: the index is built anew.
    """
    if touched == 0:
        return "full", "empty"
    if touched > most:
        return "full", "too-many"
    return ("full", "part-count-change") if parts != parts_now else ("delta", "")


def refresh(old: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of a per-note table after a change: touched and removed notes out, fresh rows in."""
    return old.join(changes.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def derived(notes: DataFrame) -> dict[str, DataFrame]:
    """The tables that hang on one note alone: its links and its postings.  ``notes`` has path, name, title, text and raw."""
    return {"links": all_links(line_table(notes.select("path", "raw"), code=False)), "postings": postings(notes)}


def refresh_index(tables: dict[str, DataFrame], changes: DataFrame, fresh: DataFrame) -> dict[str, DataFrame]:
    """``notes``, ``links`` and ``postings`` after a change; ``fresh`` are the touched notes as they are now.

    Only touched notes are extracted again.  What names resolve to is made from these tables when it is asked for.
    """
    new = {"notes": fresh} | derived(fresh)
    return {name: refresh(tables[name], changes, rows.select(tables[name].columns)) for name, rows in new.items()}


def fingerprint(files: DataFrame) -> DataFrame:
    """One row that tells snapshots apart, whatever the order of files."""
    h = F.xxhash64("path", "mtime_ms", "size")
    return files.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.crc32(F.concat_ws("|", "path", "mtime_ms", "size"))).alias("s"))


def staleness(indexed: DataFrame, now: DataFrame, result: DataFrame | None = None) -> DataFrame:
    """One row: files changed since the index, newer ones, all, the largest lag in seconds, and the first five that changed.

    With a ``result(path)`` also ``affects_results``: if a newer file is among its rows.
    """
    diff = snapshot_diff(indexed, now)
    newer = now.join(indexed.select("path", F.col("mtime_ms").alias("had")), "path").where("mtime_ms > had")
    one = diff.agg(F.count("*").alias("changed"))
    two = newer.agg(F.count("*").alias("newer"), F.coalesce(F.max(F.floor((F.col("mtime_ms") - F.col("had")) / 1000)), F.lit(0)).alias("lag_s"))
    some = diff.select("path").orderBy("path").limit(5).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("samples"))
    row = one.join(two).join(now.agg(F.count("*").alias("total"))).join(some)  # single rows
    if result is None:
        return row
    return row.join(newer.join(result.select("path"), "path", "left_semi").agg((F.count("*") > 0).alias("affects_results")))


def unread(opened: DataFrame, files: DataFrame) -> DataFrame:
    """``path``: notes opened once and changed since."""
    return files.join(opened.select("path", "last_t"), "path").where("mtime_ms > last_t").select("path")
