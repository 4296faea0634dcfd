"""Versioned tables on Parquet: a write makes a new version and then moves the pointer, so readers see whole versions
and a lost writer leaves the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docketry.operators import records


class VersionedTable:
    """Whole versions ``v=N`` and additions ``a=N`` of one table in a folder. What is read is the last finished version
    and the finished additions after it. A number is claimed by making a file, which one writer alone can do, and is never
    used again; of two writers at once both results stay, and the later number holds."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str, finished: bool = True) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        named = [s.getPath().getName() for s in fs.listStatus(self._path()) if s.getPath().getName().startswith(f"{kind}=")]
        return sorted(int(n[2:]) for n in named if not finished or fs.exists(self._path(n, "_SUCCESS")))

    def versions(self) -> list[int]:
        return self._numbers("v")

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if version is not None:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={version}")
        parts = [f"{self.folder}/v={known[-1]}"] if known else []
        parts += [f"{self.folder}/a={n}" for n in self._numbers("a") if not known or n > known[-1]]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def _put(self, df: DataFrame, kind: str) -> int:
        number = max([-1, *self._numbers("v", False), *self._numbers("a", False), *self._numbers("c", False)]) + 1
        while not self._fs().createNewFile(self._path(f"c={number}")):
            number += 1
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.folder}/{kind}={number}")
        return number

    def write(self, df: DataFrame) -> int:
        """Next whole version; its number."""
        return self._put(df, "v")

    def append(self, df: DataFrame) -> int:
        """Rows beside those that are there, which aren't read or written; the number of the addition."""
        return self._put(df, "a")


class BucketedTable:
    """One table in partitions by hash of its key. A merge reads and overwrites the partitions that incoming keys fall in, by
    Spark's dynamic partition overwrite, and leaves the files of all others alone. Writers come one at a time; a merge that is lost on
    the way has replaced some partitions and not others, and gives the same table when it runs again."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        schema = f"{self.schema}, bucket int"
        return self.spark.read.schema(schema).parquet(self.folder) if there else self.spark.createDataFrame([], schema)

    def _overwrite(self, placed: DataFrame) -> None:
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def merge(self, source: DataFrame, direct: Sequence[str] = ()) -> int:
        """``records.merge`` of rows with unique keys into the table; how many partitions they touched."""
        touched = [r.bucket for r in self._placed(source).select("bucket").distinct().collect()]  # at most ``buckets``
        if touched:
            held = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
            self._overwrite(self._placed(records.merge(held, source, self.keys, direct)))
        return len(touched)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").csv(path, header=True)


def write_counted(df: DataFrame, path: str, partition: str | None = None, **counts: Column) -> dict[str, int]:
    """Writes ``df`` and gives counts over its rows that the writing job takes on the way; no row is read for them again."""
    seen = Observation()
    writer = df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return seen.get
