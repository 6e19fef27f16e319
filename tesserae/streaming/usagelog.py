"""The usage log as a stream: lines gathered into appends, months with a cap.

An append comes when 64 lines wait or the first of them has waited for five seconds.  It goes
whole to the month of its own time, unless that month's log has reached its cap before: then its
lines are dropped, and counted.  Lines with a line break are left out: a line is an event.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .debounce import STORE

#: Lines of an append, milliseconds that a line waits, bytes of a month's log.
FLUSH_AT, FLUSH_MS, MONTH_BYTES = 64, 5_000, 16 << 20
APPENDS = "root string, month string, flush_ms long, lines array<string>, written int, dropped int, bytes long"


class Appends:
    """The rules on plain values: lines in order, appends out."""

    def __init__(self, most: int, waiting: list[tuple[int, str]], months: dict[str, int]) -> None:
        self.most, self.waiting, self.months = most, waiting, months

    def take(self, ms: int, line: str) -> Iterator[tuple]:
        yield from self.until(ms)
        self.waiting.append((ms, line))
        if len(self.waiting) >= FLUSH_AT:
            yield self._append(ms)

    def until(self, ms: int) -> Iterator[tuple]:
        if self.waiting and ms - self.waiting[0][0] >= FLUSH_MS:
            yield self._append(self.waiting[0][0] + FLUSH_MS)

    def _append(self, ms: int) -> tuple:
        month = datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m")
        lines, before = [x for _, x in self.waiting], self.months.get(month, 0)
        self.waiting = []
        if before >= self.most:
            return month, ms, [], 0, len(lines), before
        kept = [x for x in lines if "\n" not in x and "\r" not in x]
        self.months[month] = before + sum(len(x.encode()) + 1 for x in kept)
        return month, ms, kept, len(lines), 0, self.months[month]


class _UsageLog(StatefulProcessor):
    def __init__(self, most: int) -> None:
        self._most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._lines = handle.getListState("lines", "ms long, seq long, line string")
        self._waiting = handle.getListState("waiting", "ms long, line string")
        self._months = handle.getMapState("months", "month string", "bytes long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        new = [(int(r.ms), int(r.seq), r.line) for df in rows for r in df.itertuples()]
        self._lines.appendList(new)
        for ms in {e[0] for e in new}:
            self._handle.registerTimer(ms)
        yield pd.DataFrame([], columns=["root", "month", "flush_ms", "lines", "written", "dropped", "bytes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        now = int(timerValues.getCurrentWatermarkInMs())
        appends = Appends(self._most, [tuple(x) for x in self._waiting.get()] if self._waiting.exists() else [], {k[0]: int(v[0]) for k, v in self._months.iterator()})
        queue = sorted(tuple(x) for x in self._lines.get()) if self._lines.exists() else []
        out = [row for ms, _, line in queue if ms <= now for row in appends.take(ms, line)]
        out += appends.until(now)
        for state, rows in ((self._lines, [x for x in queue if x[0] > now]), (self._waiting, appends.waiting)):
            state.clear()
            if rows:
                state.put(rows)
        for month, size in appends.months.items():
            self._months.updateValue((month,), (size,))
        if appends.waiting and appends.waiting[0][0] + FLUSH_MS > now:
            self._handle.registerTimer(appends.waiting[0][0] + FLUSH_MS)
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["root", "month", "flush_ms", "lines", "written", "dropped", "bytes"])

    def close(self) -> None:
        pass


def usage_appends(lines: DataFrame, late: str = "10 seconds", most: int = MONTH_BYTES) -> DataFrame:
    """``root, month, flush_ms, lines, written, dropped, bytes`` of ``lines(root, ts, seq, line)``, a stream; a row an append.

    root is the installation whose log it is, with a cap of its own.  Lines are taken in (time,
    sequence) order once the watermark has passed them, so that batches don't matter; null roots
    are one installation, rows without time or line are left out.
    """
    if not lines.sparkSession.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {STORE} to the RocksDB provider: state with timers needs it")
    rows = lines.where(F.col("line").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    keyed = rows.select(F.coalesce("root", F.lit("")).alias("root"), "ts", F.unix_millis("ts").alias("ms"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "line")
    return keyed.groupBy("root").transformWithStateInPandas(_UsageLog(most), APPENDS, "append", "EventTime")
