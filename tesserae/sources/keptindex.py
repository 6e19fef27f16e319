"""The full-text index as a kept table: built once for a state of the notes, read by the terms of a query.

Postings lie in buckets of their term, as each task made them of its notes (nothing is shuffled),
beside the vocabulary with document frequencies and the lengths of fields.  The folder's name holds the notes' fingerprint, so that an
index of other notes is never read; a mark, written last, says that it is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from .shared import set_down, shared_dir

POSTED, VOCAB, LENGTHS = f"{search.SEGMENT}, b int", "term string, field string, df long, b int", "field string, avg_len double, n_docs long"
BUCKETS = 16


class KeptIndex:
    """An index below a folder; ``search.search`` takes it in place of postings."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def whole(self) -> bool:
        path, fs = self._fs("_whole")
        return fs.exists(path)

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def build(self, notes: DataFrame) -> KeptIndex:
        """Write the index of ``notes``; what an unfinished build left is written over."""
        made = search.segments(notes).withColumn("b", self._bucket("term"))
        made.write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/postings")
        terms = self._read("postings", POSTED).groupBy("term", "field").agg(F.sum(F.size("paths")).cast("long").alias("df")).withColumn("b", self._bucket("term"))
        terms.repartition("b").sortWithinPartitions("b", "term").write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/vocabulary")
        n = notes.count()
        sums = self._read("vocabulary", VOCAB).groupBy("field").agg((F.sum("df") / F.lit(n)).alias("avg_len"))
        sums.withColumn("n_docs", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.root}/lengths")
        path, fs = self._fs("_whole")
        fs.create(path, True).close()
        return self

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """All postings, or those of ``terms(term)``: only their buckets are read, whose numbers alone reach the driver."""
        found = self._read("postings", POSTED)
        if terms is not None:
            own = [r[0] for r in terms.select(self._bucket("term")).distinct().collect()]
            found = found.where(F.col("b").isin(own)).join(terms.select("term").distinct(), "term", "left_semi")
        return search.postings_of(found)

    def vocabulary(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, field, df`` of all terms, or of some."""
        found = self._read("vocabulary", VOCAB)
        if terms is None:
            return found.drop("b")
        own = [r[0] for r in terms.select(self._bucket("term")).distinct().collect()]
        return found.where(F.col("b").isin(own)).drop("b").join(terms.select("term").distinct(), "term", "left_semi")

    def lengths(self) -> DataFrame:
        return self._read("lengths", LENGTHS)

    def n_docs(self) -> int:
        return max([0, *(r.n_docs for r in self.lengths().select("n_docs").distinct().collect())])  # a row a field

    def asked(self, words: DataFrame, prefix: bool, fuzzy: bool) -> DataFrame:
        """``search.expand`` of the words; exact words alone don't need the whole vocabulary."""
        words = set_down(words, "query-words")
        vocab = self.vocabulary() if prefix or fuzzy else self.vocabulary(words.select(F.col("word").alias("term")))
        return set_down(search.expand(words, vocab, prefix, fuzzy), "query-terms")


def kept_index(notes: DataFrame, name: str, state: DataFrame) -> KeptIndex:
    """The index of notes in the shared folder, built if there is none of this state (one row of any values) under this name."""
    spark = notes.sparkSession
    tag = state.select(F.sha2(F.concat_ws("|", F.lit(name), *[F.col(c).cast("string") for c in state.columns]), 256)).first()[0][:32]
    index = KeptIndex(spark, f"{shared_dir(spark)}/index-{tag}")
    return index if index.whole() else index.build(notes)
