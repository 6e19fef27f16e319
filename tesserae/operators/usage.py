"""Usage-log analytics: one pass of group-bys over typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("cmd", "err", "session", "query", "open", "perf")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``month, line`` of a JSON-lines log to typed events with ``status`` ok, malformed or unknown-kind."""
    schema = "k string, t long, id string, via string, lvl string, at string, msg string, op string, ms double, kind string, q string, n long, hit boolean, path string, ev string"
    parsed = lines.withColumn("e", F.from_json("line", schema))
    raw = parsed.select("*", "e.*").drop("e")
    fine = (
        F.when(F.col("k") == "cmd", F.col("id").isNotNull() & F.col("via").isNotNull())
        .when(F.col("k") == "err", F.col("at").isNotNull() & F.col("msg").isNotNull())
        .when(F.col("k") == "session", F.col("ev").isin("start", "end"))
        .when(F.col("k") == "query", F.col("kind").isNotNull() & F.col("n").isNotNull())
        .when(F.col("k") == "open", F.col("path").isNotNull() & F.col("via").isNotNull())
        .when(F.col("k") == "perf", F.col("op").isNotNull() & F.col("ms").isNotNull())
    )
    status = F.when(F.col("k").isNull() | F.col("t").isNull(), "malformed").when(~F.col("k").isin(*KINDS), "unknown-kind").when(F.coalesce(fine, F.lit(False)), "ok").otherwise("malformed")
    warn = F.col("msg").startswith("warn: ")
    return raw.withColumns({"status": status, "lvl": F.when(F.col("k") == "err", F.when(warn, "warn").otherwise(F.coalesce("lvl", F.lit("error")))), "msg": F.when(warn, F.expr("substring(msg, 7)")).otherwise(F.col("msg"))})


def month_of(t_ms):
    return F.date_format(F.timestamp_millis(t_ms), "yyyy-MM")


def accounting(parsed: DataFrame) -> DataFrame:
    """One row: events, malformed, unknown kinds, unreadable, first and last time."""
    ok = F.col("status") == "ok"
    return parsed.agg(
        F.count_if(ok).alias("events"), F.count_if(F.col("status") == "malformed").alias("malformed"), F.count_if(F.col("status") == "unknown-kind").alias("unknown_kind"),
        F.count_if(~ok).alias("unreadable"), F.min(F.when(ok, F.col("t"))).alias("from_t"), F.max(F.when(ok, F.col("t"))).alias("to_t"),
    )


def commands(events: DataFrame) -> DataFrame:
    """``id, via, n``; via is null on the total of a command."""
    return events.where("k = 'cmd'").groupingSets([["id", "via"], ["id"]], "id", "via").agg(F.count("*").alias("n"))


def errors(events: DataFrame) -> DataFrame:
    """``lvl, at, msg, n, last_t`` by level, place and message; rolled up to the level (at and msg null)."""
    return events.where("k = 'err'").groupingSets([["lvl", "at", "msg"], ["lvl"]], "lvl", "at", "msg").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


def queries(events: DataFrame) -> DataFrame:
    """``kind, n, empty, miss_rate``: the miss rate is over queries with hits whose outcome is known."""
    known = F.col("hit").isNotNull() & (F.col("n") > 0)
    return events.where("k = 'query'").groupBy("kind").agg(F.count("*").alias("n_queries"), F.count_if(F.col("n") == 0).alias("n_empty"), F.try_divide(F.count_if(known & ~F.col("hit")), F.count_if(known)).alias("miss_rate"))


def empty_queries(events: DataFrame) -> DataFrame:
    """``kind, q, n`` of queries without a result."""
    return events.where("k = 'query' and n = 0").groupBy("kind", "q").agg(F.count("*").alias("n_empty"))


def report(events: DataFrame, top: int = 5) -> DataFrame:
    """``section, rank, name, n``: the first rows of each table of the usage report, most first, then by name."""
    parts = {
        "commands": commands(events).where("via is null").select(F.col("id").alias("name"), "n"),
        "errors": errors(events).where("msg is not null").select(F.concat_ws(": ", "lvl", "at", "msg").alias("name"), "n"),
        "empty queries": empty_queries(events).select(F.concat_ws(": ", "kind", "q").alias("name"), F.col("n_empty").alias("n")),
        "opened notes": opens(events).where("via is null").select(F.col("path").alias("name"), "n"),
        "slow work": performance(events).select(F.col("op").alias("name"), "n"),
    }
    out = None
    for section, rows in parts.items():
        first = rows.orderBy(F.desc("n"), "name").limit(top)
        ranked = first.select(F.lit(section).alias("section"), F.row_number().over(W.orderBy(F.desc("n"), "name")).alias("rank"), "name", "n")  # top rows
        out = ranked if out is None else out.unionByName(ranked)
    return out


def opens(events: DataFrame) -> DataFrame:
    """``path, via, n`` over (path, via), path and via."""
    return events.where("k = 'open'").groupingSets([["path", "via"], ["path"], ["via"]], "path", "via").agg(F.count("*").alias("n"))


def sessions(events: DataFrame) -> DataFrame:
    """``user_id, session, begin_t, span``: a start marker opens a session, which ends before the next one."""
    run = W.partitionBy("user_id").orderBy("t", "seq").rowsBetween(W.unboundedPreceding, 0)
    numbered = events.withColumn("session", F.sum(F.when((F.col("k") == "session") & (F.col("ev") == "start"), 1).otherwise(0)).over(run))
    return numbered.where("session > 0").groupBy("user_id", "session").agg(F.min("t").alias("begin_t"), (F.max("t") - F.min("t")).alias("span"))


def session_summary(events: DataFrame) -> DataFrame:
    """One row: sessions, spans, and their mean: those of start markers longer than nothing, and the ``ms`` that old end markers carry (as many thousandths as ``t`` has)."""
    own = sessions(events).select(F.lit(1).alias("s"), F.when(F.col("span") > 0, F.col("span").cast("double")).alias("span"))
    ends = events.where("k = 'session' and not ev <=> 'start' and ms is not null").select(F.lit(0).alias("s"), F.col("ms").cast("double").alias("span"))
    return own.unionByName(ends).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("sessions"), F.count("span").alias("with_span"), F.avg("span").alias("mean_span"))


def performance(events: DataFrame) -> DataFrame:
    return events.where("k = 'perf'").groupBy("op").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))


def never_used(known: DataFrame, events: DataFrame) -> DataFrame:
    """Known command ids that no event has."""
    return known.join(events.where("k = 'cmd'").select("id").distinct(), "id", "left_anti")


def recent_opens(events: DataFrame, limit: int = 30) -> DataFrame:
    """``path, last_t`` of the paths opened last."""
    return events.where("k = 'open'").groupBy("path").agg(F.max("t").alias("last_t")).orderBy(F.desc("last_t"), "path").limit(limit)
