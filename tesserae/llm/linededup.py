"""Line dedup on levelled sorted runs of line hashes.

The index of lines is a log-structured set of runs.  A run is a table of distinct 128-bit line
hashes, bucketed and sorted by them, with the documents counted and the largest doc_id.  Every
new batch of documents becomes a sorted table of its own lines, merge-anti-joins the runs bucket
by bucket (nothing is shuffled again), and adds the lines that no run knows as a new run; what it
counted of known lines is kept beside.  When a level holds ``FANOUT`` runs they are compacted
into one of the next level, so that a hash is rewritten once a level.

Lines in enough documents are the repeated ones.  Hashes, counts and places travel; texts are
shuffled once, to meet the places of the lines they lose.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, shared_dir, staged, table, written

#: Runs of a level that are compacted into one of the next.
FANOUT = 2
#: Batches that one call deals its documents into.
BATCHES = 2
KEY = ["h1", "h2"]
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_hashes(docs: DataFrame, least_chars: int, batches: int) -> DataFrame:
    """``batch, doc_id, of, pos, h1, h2`` of every line long enough; a document is in one batch.

    of: a hash of the text, which tells rows of equal doc_id apart; pos: the line's place.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs_of(docs).where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("of"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "of", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keys.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "of", "pos", key_hash(F.col("key")).alias("h")).select("batch", "doc_id", "of", "pos", "h.h1", "h.h2")


class LineRuns:
    """Levelled sorted runs ``h1, h2, n_docs, last_doc`` of distinct lines, bucketed by hash.

    ``add`` takes the next batch at any time; ``state`` is what a later session needs to go on.
    Runs that are ``passing`` go with what else the session has staged.
    """

    def __init__(self, spark: SparkSession, state: dict | None = None, fanout: int = FANOUT, passing: bool = False) -> None:
        self._spark, self._fanout, self._passing = spark, fanout, passing
        state = state or {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [], "again": []}
        self._buckets = state["buckets"]
        self._levels: list[list[str]] = [list(level) for level in state["levels"]]
        self._again: list[str] = list(state["again"])

    @property
    def state(self) -> dict:
        return {"buckets": self._buckets, "levels": self._levels, "again": self._again}

    def add(self, hashes: DataFrame) -> None:
        """Take in a batch of ``doc_id, h1, h2``; its documents are in no other batch."""
        own = self._read(self._write(hashes.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")), "line-batch"))
        fresh, runs = own, [self._read(path) for level in self._levels for path in level]
        for run in runs:
            fresh = fresh.join(run, KEY, "left_anti")
        path = self._write(fresh, "line-run-0")
        if runs:
            self._again.append(self._write(own.join(self._read(path), KEY, "left_anti"), "line-again"))
        self._put(path, 0)

    def _put(self, path: str, level: int) -> None:
        if level == len(self._levels):
            self._levels.append([])
        self._levels[level].append(path)
        if len(self._levels[level]) == self._fanout:
            merged, *others = [self._read(p) for p in self._levels[level]]
            for run in others:  # runs share no line
                own, other = merged.select(*KEY, F.struct("n_docs", "last_doc").alias("a")), run.select(*KEY, F.struct("n_docs", "last_doc").alias("b"))
                merged = own.join(other, KEY, "full_outer").select(*KEY, F.coalesce("a", "b").alias("x")).select(*KEY, "x.n_docs", "x.last_doc")
            self._levels[level] = []
            self._put(self._write(merged, f"line-run-{level + 1}"), level + 1)

    def _write(self, run: DataFrame, name: str) -> str:
        """Write a table in buckets of hashes, each sorted; its path."""
        path = f"{shared_dir(self._spark)}/{name}-{uuid.uuid4().hex}"
        run.select(*KEY, "n_docs", "last_doc").write.bucketBy(self._buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(_name(path))
        if self._passing:
            written(self._spark, path)
        return path

    def _read(self, path: str) -> DataFrame:
        if not self._spark.catalog.tableExists(_name(path)):  # of another session
            self._spark.sql(f"CREATE TABLE {_name(path)} (h1 BIGINT, h2 BIGINT, n_docs BIGINT, last_doc BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self._buckets} BUCKETS LOCATION '{path}'")
        return self._spark.table(_name(path))

    def repeated(self, least_docs: int) -> DataFrame:
        """``h1, h2, last_doc`` of the lines in at least so many documents, over all runs."""
        found = []
        for run in (self._read(p) for level in self._levels for p in level):
            total = run
            for k, path in enumerate(self._again):
                more = self._read(path).select(*KEY, F.col("n_docs").alias(f"n{k}"), F.col("last_doc").alias(f"d{k}"))
                total = total.join(more, KEY, "left")
            n = sum((F.coalesce(f"n{k}", F.lit(0)) for k in range(len(self._again))), F.col("n_docs"))
            last = F.greatest("last_doc", F.lit(None).cast("long"), *[f"d{k}" for k in range(len(self._again))])
            found.append(total.where(n >= least_docs).select(*KEY, last.alias("last_doc")))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def lost_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """``doc_id, of, lost`` (the places of lost lines, ascending) of the texts that lose lines.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of at
    least ``least_chars`` code points in at least ``least_docs`` documents (distinct doc_ids) lose
    all their lines but those of the largest doc_id.
    """
    hashes = staged(line_hashes(docs, least_chars, batches), "line-hashes", "batch")
    runs = LineRuns(docs.sparkSession, passing=True)
    for k in range(batches):
        runs.add(hashes.where(F.col("batch") == k))
    repeated = staged(runs.repeated(least_docs), "repeated-lines")
    lost = hashes.join(repeated, KEY).where("doc_id <> last_doc")
    return lost.groupBy("doc_id", "of").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """``doc_id, row, lines, kept``: every row as a struct, and its lines before and after.

    Null text is one empty line; rows with equal doc_id are one document; rows without doc_id
    lose nothing and count nowhere; columns of any name travel within ``row``.
    """
    lost = lost_lines(docs, least_chars, least_docs, batches)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    lines = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row", F.xxhash64(text).alias("of"), F.split(text, "\n", -1).alias("lines"))
    # between two lost lines a stretch stays: the work is linear in the lines
    begin = lambda i: F.coalesce(F.get("lost", i - 1) + 1, F.lit(0))
    end = lambda i: F.coalesce(F.get("lost", i), F.size("lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("lost")), lambda i: F.slice("lines", begin(i) + 1, end(i) - begin(i))))
    return lines.join(lost, ["doc_id", "of"], "left").select("doc_id", "row", "lines", F.when(F.col("lost").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS lost
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
