"""File events of a vault made quiet: one change a path and burst, renames paired.

State is kept by vault: events that the watermark hasn't passed, the changes of the burst so far,
and a name that a file was renamed from until the event that brings its new name, in whichever
micro-batch that comes.  Events are taken in (time, sequence) order once the watermark has passed
them, so that the result doesn't hang on how they were cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET = "root string, path string, kind string, from_path string, mtime_ms long, seq long, quiet_ms long"
EVENT = "ms long, seq long, kind string, path string, from_path string, mtime_ms long"
STORE = "spark.sql.streaming.stateStore.providerClass"
KINDS = ("created", "modified", "removed", "renamed", "renamed-from", "renamed-to")


class Burst:
    """The rules on plain values: events in order, changes out.

    A created or renamed-to path takes the name held from the last renamed-from, if there is one;
    the last event of a path within a burst counts; a burst ends when nothing happens for ``gap``.
    A name that nobody takes for ``give_up`` milliseconds is a removal; without it, it is held on.
    """

    def __init__(self, gap: int, give_up: int | None, pending: dict[str, tuple], held: tuple[str, int] | None, last: int) -> None:
        self.gap, self.give_up, self.pending, self.held, self.last = gap, give_up, pending, held, last

    def take(self, event: tuple) -> Iterator[tuple]:
        ms, seq, kind, path, from_path, mtime = event
        yield from self.until(ms)
        self.last = max(self.last, ms)
        if kind == "renamed-from":
            self.held = (path, ms)
        elif kind == "removed":
            self.pending[path] = ("removed", None, mtime, seq)
        elif kind == "renamed":
            self.pending[path] = ("renamed", from_path, mtime, seq)
        elif kind in ("created", "renamed-to") and self.held:
            self.pending[path] = ("renamed", self.held[0], mtime, seq)
            self.held = None
        else:
            self.pending[path] = ("modified", None, mtime, seq)

    def until(self, ms: int) -> Iterator[tuple]:
        """What is known at a time: the changes of a burst that is over, a name given up."""
        if self.pending and ms - self.last >= self.gap:
            for path, (kind, from_path, mtime, seq) in sorted(self.pending.items()):
                yield path, kind, from_path, mtime, seq, self.last + self.gap
            self.pending = {}
        if self.give_up is not None and self.held and ms - self.held[1] >= self.give_up:
            yield self.held[0], "removed", None, None, 0, self.held[1] + self.give_up
            self.held = None


class _Debounce(StatefulProcessor):
    def __init__(self, gap: int, give_up: int | None) -> None:
        self._gap, self._give_up = gap, give_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._events = handle.getListState("events", EVENT)
        self._pending = handle.getMapState("pending", "path string", "kind string, from_path string, mtime_ms long, seq long")
        self._held = handle.getValueState("held", "path string, ms long")
        self._last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        new = [(r.ms, r.seq, r.kind, r.path, r.from_path, r.mtime_ms) for df in rows for r in df.astype(object).where(df.notna(), None).itertuples()]
        self._events.appendList(new)
        for ms in {e[0] for e in new}:
            self._handle.registerTimer(int(ms))
        yield pd.DataFrame([], columns=["root", "path", "kind", "from_path", "mtime_ms", "seq", "quiet_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        now = int(timerValues.getCurrentWatermarkInMs())
        held, last = self._held.get() if self._held.exists() else None, self._last.get()[0] if self._last.exists() else 0
        burst = Burst(self._gap, self._give_up, {k[0]: tuple(v) for k, v in self._pending.iterator()}, (held[0], int(held[1])) if held else None, int(last))
        queue = sorted((tuple(e) for e in self._events.get()), key=lambda e: (*e[:4], e[4] or "")) if self._events.exists() else []
        out = [row for e in queue if e[0] <= now for row in burst.take(e)]
        out += burst.until(now)
        rest = [e for e in queue if e[0] > now]
        self._events.clear()
        if rest:
            self._events.put(rest)
        self._pending.clear()
        for path, value in burst.pending.items():
            self._pending.updateValue((path,), value)
        self._held.clear()
        if burst.held:
            self._held.update(burst.held)
        self._last.update((burst.last,))
        waits = ([burst.last + self._gap] if burst.pending else []) + ([burst.held[1] + self._give_up] if burst.held and self._give_up is not None else [])
        for ms in waits:
            if ms > now:
                self._handle.registerTimer(ms)
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["root", "path", "kind", "from_path", "mtime_ms", "seq", "quiet_ms"])

    def close(self) -> None:
        pass


def quiet_renames(events: DataFrame, gap_ms: int = 200, late: str = "10 seconds", give_up_ms: int | None = None) -> DataFrame:
    """``root, path, kind, from_path, mtime_ms, seq, quiet_ms`` of ``events(root, path, kind, from_path, mtime_ms, ts, seq)``, a stream.

    kind is modified, removed or renamed.  Vaults are independent of each other; the order of one
    vault's events is what pairs its names, so that a vault is one key.  Its state is what lies
    within the watermark and one burst.  Events later than the watermark are dropped.  Null roots
    are one vault; events without path or time, or of another kind, are left out.
    """
    if not events.sparkSession.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {STORE} to the RocksDB provider: state with timers needs it")
    rows = events.where(F.col("kind").isin(*KINDS) & F.col("path").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    keyed = rows.select(F.coalesce("root", F.lit("")).alias("root"), "ts", F.unix_millis("ts").alias("ms"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "kind", "path", "from_path", F.col("mtime_ms").cast("long").alias("mtime_ms"))
    return keyed.groupBy("root").transformWithStateInPandas(_Debounce(gap_ms, give_up_ms), QUIET, "append", "EventTime")
