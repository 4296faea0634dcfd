"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row is broadcast (counted first); beyond it Spark shuffles both sides.
SMALL_ROWS = 1_000_000
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder. It also sets how large Spark makes the batches that Python gets in this session, which is
    read when a job runs: ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at most, so a task holds little however long the
    texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []
_scopes: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables. Where none is set, a temporary folder serves a session on one
    machine alone; on a cluster it would be another folder on each machine, so that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="docketry-"))
    return _local[0]


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written; else they lie on the executors' disks until the
    driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as a table, so that no later job computes it again or sees another
    order, and a lost executor loses none of it. Within ``temporary_tables`` the table goes at its end."""
    path = f"{shared_folder(df.sparkSession)}/tables/{_scopes[-1] if _scopes else 'kept'}/{uuid.uuid4()}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes a table that ``cut`` wrote, before its scope ends. Nothing may read it any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``cut`` writes inside; what reads them must be stored before the end."""
    _scopes.append(str(uuid.uuid4()))
    try:
        yield
    finally:
        remove(spark, f"{shared_folder(spark)}/tables/{_scopes.pop()}")


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` sorted by keys, with the rows of equal keys in one task. Rows are dealt by a hash of the keys: Spark leaves out
    a ``repartition`` by columns that a join has dealt them by already, and then may change that join as it runs (rows read
    where they lie, a large partition cut in several), which parts a key's rows."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys)


def returned(run: Callable) -> Callable:
    """``run``, a mapInArrow function, after which its Python worker gives freed memory back to the system: workers serve task after
    task, and what one task needed would stay theirs through stages that need little."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library's own call, where there is one
            ctypes.CDLL(None).malloc_trim(0)

    return own


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast where it has few rows. It is counted first, so it should be cut."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def mark(text: Column) -> Column:
    """Digest of a text; with the id it names a document, so rows that repeat both are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links`` (long a, long b): comp is one id of the connected component.

    Each round maps every vertex to the neighbour (or itself) of least seeded hash and contracts the edges, which
    leaves a fraction of the vertices; the rounds' maps are then composed. Hubs cost no more than their edges, as
    each round only takes minima. No links give no rows.
    """
    hashed = lambda c, seed: F.xxhash64(F.col(c), F.lit(seed))
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = len(maps)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min_by("b", hashed("b", seed)).alias("near"), F.min(hashed("b", seed)).alias("least"))
        step = cut(best.select("a", F.when(F.col("least") < hashed("a", seed), F.col("near")).otherwise(F.col("a")).alias("p")))
        maps.append(step)
        moved = edges.join(step.select("a", F.col("p").alias("pa")), "a").join(step.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(moved.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    found = maps[-1].select(F.col("a").alias("id"), F.col("p").alias("comp"))
    for step in maps[-2::-1]:
        later = found.select(F.col("id").alias("p"), "comp")
        found = step.join(later, "p", "left").select(F.col("a").alias("id"), F.coalesce("comp", "p").alias("comp"))
    return cut(found)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[pa.Array]]:
    """Columns of each run of rows that are equal in the first ``n_keys`` columns (integers, sorted)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.concat_batches([rest, batch]) if rest is not None else batch
        keys = [c.to_numpy() for c in whole.columns[:n_keys]]
        new = np.zeros(len(keys[0]) - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield whole.slice(a, b - a).columns
        rest = whole.slice(edges[-1])
    if rest is not None:
        yield rest.columns


def block_tasks(placed: DataFrame, block_rows: int, *columns: str, wide: DataFrame | None = None, over: int = 0) -> DataFrame:
    """Of cells (key, id, comp, ...) with several components and more than ``over`` rows: rows (key, i, j, block, id, comp, *columns). A cell is
    cut into blocks of about ``block_rows`` rows, and each pair of blocks i <= j is a task of its own. The other columns
    of ``wide`` (id, ...), if given, come last; they join the rows of such cells alone."""
    counts = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows"))
    mixed = cut(counts.where((F.col("low") != F.col("high")) & (F.col("rows") > over)).select("key", "rows"))  # a table of its own, so that Spark can split a large key
    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    at = placed.join(mixed, "key").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    if wide is not None:
        at, columns = at.join(wide, "id"), (*columns, *(c for c in wide.columns if c != "id"))
    other = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "comp", *columns)
