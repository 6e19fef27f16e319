"""Tables of notes as a base and deltas: a change is written, never the whole table again.

A version writes, for each table, the new rows of the keys it touches and those keys.  A row
counts if its version is the last that touched its key; the rows of the base count unless their
key was touched since.  A version counts once its mark is there, so that a batch which comes
again, however late, changes nothing, and what a failed one left is written over.  Rows lie in
buckets of a column, and a reader that knows which values it wants reads those buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class NoteLog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    # versions ---------------------------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> list[tuple[int, bool]]:
        path, fs = self._path("_marks")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName().split("-") for s in fs.listStatus(path)]
        return sorted((int(n[0]), n[1] == "base") for n in names)

    def done(self, version: int) -> bool:
        """If a version was written, however long ago."""
        return any(v == version for v, _ in self._marks())

    def live(self) -> tuple[int, list[int]]:
        """The last base, and all versions that count from it on."""
        marks = self._marks()
        if not marks:
            raise FileNotFoundError(f"no base under {self.root}")
        base = max(v for v, is_base in marks if is_base)
        return base, [v for v, _ in marks if v >= base]

    def mark(self, version: int, base: bool = False) -> None:
        """From now on a version counts.  Marks stay for ever: they are names, not rows."""
        path, fs = self._path(f"_marks/{version:012d}-{'base' if base else 'delta'}")
        fs.create(path, True).close()

    # rows -------------------------------------------------------------------------------------
    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def buckets_of(self, df: DataFrame, column: str) -> list[int]:
        """Where the values of a column lie: a number a bucket at most reaches the driver."""
        return [r[0] for r in df.select(self.bucket(column)).distinct().collect()]

    def put(self, version: int, table: str, rows: DataFrame, by: str, touched: DataFrame | None = None) -> DataFrame:
        """Write a table's rows of a version, in buckets of ``by``, and the keys (one column) that it touches; the rows as written.

        A large bucket is written by several tasks.
        """
        rows.withColumn("b", self.bucket(by)).hint("rebalance", F.col("b")).write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/{table}/v={version}")
        if touched is not None:
            touched.write.mode("overwrite").parquet(f"{self.root}/{table}__touched/v={version}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{table}/v={version}")

    def _read(self, name: str, schema: str, versions: list[int]) -> DataFrame:
        path, fs = self._path(name)
        full = f"{schema}, v int"
        if not versions or not fs.exists(path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}").where(F.col("v").isin(versions))

    def rows(self, table: str, schema: str, key: str, kind: str = "string", buckets: list[int] | None = None) -> DataFrame:
        """The current rows of a table, of some buckets or all."""
        base, versions = self.live()
        found = self._read(table, f"{schema}, b int", versions)
        found = found if buckets is None else found.where(F.col("b").isin(buckets))
        last = self._read(f"{table}__touched", f"{key} {kind}", [v for v in versions if v > base]).groupBy(key).agg(F.max("v").alias("last"))
        old = found.where(F.col("v") == base).join(last, key, "left_anti")
        new = found.where(F.col("v") > base).join(last, key).where("v = last").drop("last")
        return old.unionByName(new.select(old.columns)).drop("b", "v")

    def sums(self, table: str, keys: list[str], schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table whose versions add up: the sum of ``n`` by keys, where there is any."""
        _, versions = self.live()
        found = self._read(table, f"{schema}, b int", versions)
        found = found if buckets is None else found.where(F.col("b").isin(buckets))
        return found.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def sweep(self) -> None:
        """Delete what lies before the last base."""
        base, _ = self.live()
        top, fs = self._path("")
        for table in fs.listStatus(top):
            if not table.getPath().getName().startswith("_"):
                for version in fs.listStatus(table.getPath()):
                    name = version.getPath().getName()
                    if name.startswith("v=") and int(name[2:]) < base:
                        fs.delete(version.getPath(), True)
