"""Retrieval quality: cases drawn from the corpus, measures over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = ("zebra", "quartz", "violin", "nebula", "saffron")


def sample(notes: DataFrame, n: int, seed: int) -> DataFrame:
    """The same notes for a seed on any cluster: the smallest md5 of seed and path."""
    return notes.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "path")), "path").limit(n)


def cases(notes: DataFrame) -> DataFrame:
    """``kind, query, target``: the title, its two middle words, and the first words of the longest line."""
    words = F.filter(F.split(F.trim("title"), r"\s+"), lambda w: w != "")
    usable = notes.where(F.size(words) >= 2).withColumn("w", words)
    lines = F.filter(F.split("text", "\n"), lambda x: F.char_length(F.trim(x)) >= 20)
    longest = F.get(F.array_sort(F.transform(lines, lambda x, i: F.struct((-F.char_length(x)).alias("l"), i.alias("i"), x.alias("line")))), F.lit(0))["line"]
    start = F.floor((F.size("w") - 2) / 2).cast("int") + 1
    three = F.array(
        F.struct(F.lit("title").alias("kind"), F.array_join("w", " ").alias("query")),
        F.struct(F.lit("middle").alias("kind"), F.array_join(F.slice("w", start, F.lit(2)), " ").alias("query")),
        F.struct(F.lit("prose").alias("kind"), F.array_join(F.slice(F.split(F.trim(longest), r"\s+"), F.lit(1), F.lit(8)), " ").alias("query")),
    )
    return usable.select(F.col("path").alias("target"), F.explode(three).alias("c")).select("c.kind", "c.query", "target").where("query is not null and query <> ''")


def noisy(cases_: DataFrame) -> DataFrame:
    """Cases with an unrelated word at the end, by the case's hash."""
    word = F.element_at(F.array(*[F.lit(w) for w in NOISE]), (F.pmod(F.crc32("target"), F.lit(len(NOISE))) + 1).cast("int"))
    return cases_.withColumn("query", F.concat_ws(" ", "query", word))


def long_queries(notes: DataFrame, words: int) -> DataFrame:
    """``query, target``: the first ``words`` words of a text; shorter texts are left out."""
    w = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    return notes.where(F.size(w) >= words).select(F.array_join(F.slice(w, F.lit(1), F.lit(words)), " ").alias("query"), F.col("path").alias("target"))


def measures(results: DataFrame) -> DataFrame:
    """``kind, cases, r1, r5, r10, mrr, mean_matched`` of ``results(kind, qid, rank, matched)``; a null rank is a miss."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return results.groupBy("kind").agg(F.count("*").alias("cases"), hit(1).alias("r1"), hit(5).alias("r5"), hit(10).alias("r10"), F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.avg("matched").alias("mean_matched"))


def stages(results: DataFrame) -> DataFrame:
    """``variant, stage, share`` of ``results(variant, qid, stage)``: where the ladder ended, over the queries with a hit."""
    per = results.select("variant", "qid", "stage").distinct().groupBy("variant", "stage").agg(F.count("*").alias("n"))
    return per.join(per.groupBy("variant").agg(F.sum("n").alias("all")), "variant").select("variant", "stage", (F.col("n") / F.col("all")).alias("share"))


def latency(rows: DataFrame, column: str = "ms") -> DataFrame:
    """One row: mean, nearest-rank median and 95th percentile, and maximum."""
    return rows.agg(F.avg(column).alias("mean"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"), F.max(column).alias("max"))
