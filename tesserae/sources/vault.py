"""Sources: folders of notes, usage logs, commit logs, note assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import composed

#: Folders that are never read, besides those whose name begins with a dot.
SKIPPED = ("node_modules", "target", ".svelte-kit", "build", "dist", ".git")
NOTE = r"(?i)\.(md|mmd)$"
IMAGE = r"(?i)\.(svg|png|jpe?g|gif|webp)$"
SEPARATOR = "\u001f"


def relative(path: Column, root: str) -> Column:
    """Path below the root, however the file system spells the root."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^(?:[a-z]+:)?/*" + root.strip("/").replace(".", r"\.") + "/", "")


def wanted(rel: Column) -> Column:
    hidden = rel.rlike(r"(^|/)\.") | rel.rlike(r"(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + r")/")
    return rel.rlike(NOTE) & ~hidden


def files(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel, mtime_ms, size`` of the notes below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = relative(F.col("path"), root)
    return found.select("path", rel.alias("rel"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size")).where(wanted(F.col("rel")))


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """``path, name, raw, mtime_ms, size`` of the notes below a folder.

    Ingest once and write as Parquet: small files are read badly twice.  Files that aren't UTF-8
    are left out; names and texts come out composed (NFC), so that every later match is by equality.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = relative(F.col("path"), root)
    rows = found.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content").where(wanted(F.col("path")))
    good = rows.where(F.is_valid_utf8(F.col("content").cast("string")))
    nfc = composed()
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), NOTE, "")
    return good.select("path", nfc(name).alias("name"), nfc(F.col("content").cast("string")).alias("raw"), "mtime_ms", "size")


def read_usage_log(spark: SparkSession, folder: str) -> DataFrame:
    """``month, line`` of the ``YYYY-MM.log`` files of a folder."""
    lines = spark.read.text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2})\.log$", 1).alias("month"), F.col("value").alias("line"))
    return lines.where("month <> '' and trim(line) <> ''")


def read_commits(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """``hash, short, author, ts, subject`` of an exported log, newest first; broken rows dropped, a bad time is 0."""
    parts = F.split("value", SEPARATOR)
    rows = spark.read.text(path).where(F.size(parts) >= 5).select(parts.alias("p"))
    epoch = F.coalesce(F.expr("try_cast(p[3] as bigint)"), F.lit(0))
    out = rows.select(F.col("p")[0].alias("hash"), F.col("p")[1].alias("short"), F.col("p")[2].alias("author"), epoch.alias("ts"), F.array_join(F.slice("p", F.lit(5), F.size("p")), SEPARATOR).alias("subject"))
    return out.orderBy(F.desc("ts"), "hash").limit(max(1, min(500, limit)))


def note_assets(notes: DataFrame, images: DataFrame) -> DataFrame:
    """``path, asset``: images beside a note whose stem is the note's, or begins with it before ``_``, ``-`` or ``.``."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = notes.select("path", folder.alias("folder"), stem.alias("stem"))
    # an image offers every stem it could belong to, so that the join is by equality
    cuts = F.concat(F.array(F.char_length("image_stem")), F.transform(F.filter(F.sequence(F.lit(1), F.char_length("image_stem")), lambda i: F.substr(F.col("image_stem"), i, F.lit(1)).isin("_", "-", ".")), lambda i: i - 1))
    offered = images.where(F.col("path").rlike(IMAGE)).select(F.col("path").alias("asset"), folder.alias("folder"), stem.alias("image_stem")).select("asset", "folder", F.explode(F.array_distinct(F.transform(cuts, lambda n: F.substr(F.col("image_stem"), F.lit(1), n)))).alias("stem"))
    return own.join(offered, ["folder", "stem"]).select("path", "asset")


def csv_lines(table_rows: DataFrame) -> DataFrame:
    """``path, table_ln, row_no, line``: a table's rows as CSV; cells with a comma, quote or line break are quoted."""
    quoted = lambda c: F.when(c.rlike("[\",\\n\\r]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return table_rows.select("path", "table_ln", "row_no", F.array_join(F.transform("cells", quoted), ",").alias("line"))


def to_csv(table_rows: DataFrame, folder: str) -> None:
    """Write every extracted table as CSV text below ``folder``, in a folder by note and table, its rows in order."""
    lines = csv_lines(table_rows).withColumn("note", F.url_encode("path"))
    lines.repartition("note", "table_ln").sortWithinPartitions("note", "table_ln", "row_no").select("note", "table_ln", "line").write.partitionBy("note", "table_ln").text(folder)


def to_markdown(table_rows: DataFrame) -> DataFrame:
    """``path, table_ln, row_no, line``: rows as pipe lines, pipes within cells escaped."""
    escaped = F.transform("cells", lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    return table_rows.select("path", "table_ln", "row_no", F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |")).alias("line"))
