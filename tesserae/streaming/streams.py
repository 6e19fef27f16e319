"""Structured Streaming: file changes, debounced index upkeep, usage windows, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.changes import refresh_index
from ..operators.upkeep import GraphUpkeep
from ..sources import store
from ..sources.vault import wanted

CHANGES = "root string, kind string, path string, from_path string, mtime_ms long, ts timestamp, seq long"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant events of a folder of JSON file events, as they came: notes outside hidden and skipped folders."""
    return spark.readStream.schema(CHANGES).json(folder).where(wanted(F.col("path")))


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant changes of a folder of JSON change events; ``debounce.quiet_renames`` makes them of ``event_stream`` with renames paired."""
    raw = event_stream(spark, folder)
    kind = F.when(F.col("kind").isin("created", "modified"), "modified").when(F.col("kind") == "removed", "removed").when(F.col("kind") == "renamed", "renamed")
    return raw.withColumn("kind", kind).where(F.col("kind").isNotNull())


def coalesced(changes: DataFrame) -> DataFrame:
    """The last change of every path of a batch; a removal and a creation that name each other are a rename."""
    renamed = changes.where("kind = 'renamed' and from_path is not null")
    expanded = changes.where("kind <> 'renamed'").select("path", "kind", "mtime_ms", "seq").unionByName(renamed.select("path", F.lit("modified").alias("kind"), "mtime_ms", "seq")).unionByName(renamed.select(F.col("from_path").alias("path"), F.lit("removed").alias("kind"), "mtime_ms", "seq"))
    return expanded.groupBy("path").agg(F.max_by(F.struct("kind", "mtime_ms"), "seq").alias("c")).select("path", "c.kind", "c.mtime_ms")


def quiet_changes(changes: DataFrame, gap: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last change of every burst of a path, once the path has been quiet for ``gap``."""
    bursts = changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap))
    return bursts.agg(F.max_by(F.struct("kind", "mtime_ms", "seq"), "seq").alias("c")).select("path", "c.kind", "c.mtime_ms", F.col("session_window.end").alias("quiet_since"))


def keep_index(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply(coalesced changes, batch id)`` on every micro-batch; apply must be idempotent by batch id."""

    def one(batch: DataFrame, batch_id: int) -> None:
        apply(coalesced(batch), batch_id)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_upkeep(spark: SparkSession, root: str, fresh: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What ``keep_index`` applies: a new snapshot of notes, links and postings below ``root`` for every batch.

    ``fresh`` reads the notes that a batch has touched.  A batch that comes again finds its snapshot and changes nothing.
    """

    def apply(changes: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id}"
        if any(r.snapshot_id == name for r in store.history(spark, root)):
            return
        tables = {t: store.current(spark, root, t) for t in ("notes", "links", "postings")}
        store.write_snapshot(spark, root, refresh_index(tables, changes, fresh(changes.where("kind <> 'removed'"))), name)

    return apply


def graph_upkeep(upkeep: GraphUpkeep, fresh: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """What ``keep_index`` applies: each batch a version of the graph's tables, in proportion to what it touches.

    ``fresh`` gives what the touched notes now hold.  A batch that comes again, however late, changes nothing.
    """

    def apply(changes: DataFrame, batch_id: int) -> None:
        upkeep.apply(batch_id + 1, changes.select("path"), fresh(changes.where("kind <> 'removed'")))

    return apply


def usage_windows(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts by day and kind of ``events(ts, k)``; rows later than the watermark are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "k").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), "k", "n")


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user by gaps, with their events."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def marker_sessions(events: DataFrame):
    """Start-marker sessions as a stream: a session is given out when the next start of its user arrives.

    State is the start, the last time and the count; events of one batch are taken in (ts, seq) order.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        start, last, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "seq"])
        out = []
        for r in rows.itertuples():
            if r.starts:
                if start is not None:
                    out.append((key[0], start, last - start, n))
                start, last, n = int(r.us), int(r.us), 1
            elif start is not None:
                last, n = max(last, int(r.us)), n + 1
        if start is not None:
            state.update((start, last, n))
        yield pd.DataFrame(out, columns=["user_id", "begin_us", "span_us", "n"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, begin_us long, span_us long, n long", "start long, last long, n long", "append", GroupStateTimeout.NoTimeout)


def unread_notes(opened: DataFrame, changed: DataFrame) -> DataFrame:
    """``path`` of notes whose last change is after their last opening (streams or tables of ``path, ts``)."""
    both = opened.select("path", "ts", F.lit(True).alias("is_open")).unionByName(changed.select("path", "ts", F.lit(False).alias("is_open")))
    last = both.groupBy("path").agg(F.max(F.when(F.col("is_open"), F.col("ts"))).alias("opened"), F.max(F.when(~F.col("is_open"), F.col("ts"))).alias("changed"))
    return last.where("opened is not null and changed > opened").select("path")


def latest_by_sequence(rows: DataFrame, *keys: str) -> DataFrame:
    """Keep the row of the highest ``seq`` of each key."""
    w = W.partitionBy(*keys).orderBy(F.desc("seq"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
