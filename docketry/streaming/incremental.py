"""Incremental loads with Structured Streaming: files once, events once, snapshots against the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators import lookups, records
from docketry.sources.tables import VersionedTable

LEDGER = "file STRING, status STRING, attempt INT, rows BIGINT, message STRING, at TIMESTAMP"
PLACE = "__place"
#: Additions to a ledger after which it is written anew with each file's last entry.
COMPACT = 50


def file_states(ledger: VersionedTable) -> DataFrame:
    """Each file's last entry. A file that has succeeded stays so."""
    return records.latest(ledger.read().withColumn("__done", F.col("status") == "succeeded"), ["file"], ["__done", "attempt", "at"]).drop("__done")


def due(ledger: VersionedTable, attempts: int) -> DataFrame:
    """(file, attempt) of files that failed and have tries left."""
    return file_states(ledger).where((F.col("status") == "failed") & (F.col("attempt") < attempts)).select("file", "attempt")


class Sweep:
    """Loads files and keeps their ledger: files go together, and if that fails each goes alone, so one bad file fails itself alone."""

    def __init__(self, spark: SparkSession, ledger: VersionedTable, load: Callable[[DataFrame, int], int]):
        self.spark, self.ledger, self.load, self.added = spark, ledger, load, 0

    def entries(self, rows: list[tuple]) -> None:
        named = self.spark.createDataFrame(rows, LEDGER.replace(", at TIMESTAMP", ""))
        self.ledger.append(named.withColumn("at", F.current_timestamp()))
        self.added += 1
        if self.added % COMPACT == 0:
            self.ledger.write(file_states(self.ledger))

    def take(self, batch: DataFrame, batch_id: int) -> list[str]:
        """Loads the files of a batch (rows with ``PLACE``) that haven't succeeded before; those that failed."""
        file = F.col(f"{PLACE}.file_path")
        sizes = {r.file: r.n for r in batch.groupBy(file.alias("file")).agg(F.count("*").alias("n")).collect()}  # as many as files_at_once
        known = {r.file: r for r in file_states(self.ledger).where(F.col("file").isin(list(sizes))).collect()}
        tries = {f: (known[f].attempt if f in known else 0) + 1 for f in sizes if f not in known or known[f].status != "succeeded"}
        if not tries:
            return []
        try:
            self.load(batch.where(file.isin(list(tries))), batch_id)
            self.entries([(f, "succeeded", n, sizes[f], None) for f, n in tries.items()])
            return []
        except Exception as e:
            if len(tries) == 1:
                ((f, n),) = tries.items()
                self.entries([(f, "failed", n, 0, str(e)[:500])])
                return [f]
        failed = []
        for f, n in tries.items():
            try:
                self.entries([(f, "succeeded", n, self.load(batch.where(file == f), batch_id), None)])
            except Exception as e:
                self.entries([(f, "failed", n, 0, str(e)[:500])])
                failed.append(f)
        return failed


def placed(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias(PLACE))


def retry_failed(spark: SparkSession, schema: str, ledger: VersionedTable, load: Callable[[DataFrame, int], int], files_at_once: int = 100, attempts: int = 5) -> int:
    """Files that failed in earlier runs, read again from where they are and loaded; how many still fail. A file that has failed
    ``attempts`` times is left alone."""
    sweep, still = Sweep(spark, ledger, load), 0
    ledger.write(file_states(ledger))
    paths = [r.file for r in due(ledger, attempts).orderBy("file").collect()]
    for k in range(0, len(paths), files_at_once):
        still += len(sweep.take(placed(spark.read.schema(schema).json(paths[k : k + files_at_once])), -1))
    return still


def load_files(spark: SparkSession, folder: str, schema: str, checkpoint: str, ledger: VersionedTable, load: Callable[[DataFrame, int], int], files_at_once: int = 100, stop: bool = True, attempts: int = 5) -> StreamingQuery:
    """Loads every JSON file of a folder once: those that failed in earlier runs first, then new ones as a stream.
    ``load(batch, batch_id)`` returns the rows it took; the batch has the rows' files and places in them as ``PLACE``. The ledger has an
    entry for each try of each file; files that succeeded are never given to ``load`` again, even if the checkpoint
    brings their batch back. A failed file holds nothing up: files beside it load at once, and it comes again in the next run until it
    has failed ``attempts`` times. With ``stop`` a batch with failed files raises once the rest of it is loaded. A writer that dies
    between a load and its entry loads the file once more, so loads should merge by key. Ends when no file is left."""
    if not ledger.read().isEmpty():
        retry_failed(spark, schema, ledger, load, files_at_once, attempts)
    sweep = Sweep(spark, ledger, load)

    def each(batch: DataFrame, batch_id: int) -> None:
        failed = sweep.take(batch, batch_id)
        if failed and stop:
            raise RuntimeError(f"{len(failed)} files failed, the first: {failed[0]}")

    stream = placed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder))
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(table: VersionedTable, keys: list[str]) -> Callable[[DataFrame, int], int]:
    """A loader that folds a batch by key and merges it into a table's next version. Of several rows of a key the later one
    by file name and line holds."""

    def load(batch: DataFrame, batch_id: int) -> int:
        place = F.struct(PLACE, F.monotonically_increasing_id()) if PLACE in batch.columns else F.monotonically_increasing_id()
        numbered = batch.withColumn("__n", place).drop(PLACE)
        table.write(records.merge(table.read(), records.fold(numbered, keys, "__n"), keys))
        return batch.count()

    return load


def distinct_events(events: DataFrame, time: str, digest: str, delay: str = "7 days") -> DataFrame:
    """A stream's events without those whose digest came within ``delay`` before."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([digest])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by key and time window; late ones count up to ``delay``."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(key, start, last, n): runs of a key's events with less than ``gap`` between neighbours; late ones join up to ``delay``."""
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.max(time).alias("last"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "last", "n")


def sliding_counts(events: DataFrame, time: str, key: str, width: str = "1 day", slide: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """(start, key, n) for overlapping windows; a window without events has no row."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str = "1 day") -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same key that came at most ``within`` before them. Both watermarks and the
    interval bound what a stream keeps of either side."""
    l, r = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay).withColumnRenamed(key, "__key")  # noqa: E741
    near = F.expr(f"{right_time} <= {left_time} AND {right_time} >= {left_time} - INTERVAL {within}")
    return l.join(r, (F.col(key) == F.col("__key")) & near).drop("__key")


def alerts(events: DataFrame, watchlist: DataFrame, time: str, delay: str = "7 days") -> DataFrame:
    """A stream's events (event_id, ...) with the watches they meet, each (watch, event) once. What has been told is kept by key
    until the watermark is ``delay`` past it, so the state holds ``delay`` of alerts, however long the stream runs."""
    met = lookups.meetings(events.withWatermark(time, delay), watchlist)
    return met.dropDuplicatesWithinWatermark(["watch_id", "event_id"])


def next_snapshot(snapshots: VersionedTable, log: VersionedTable, rows: DataFrame, key: str, position: str, name: str | None = None, names: VersionedTable | None = None) -> int:
    """Takes a snapshot in: the first is the baseline, a later one is compared with the last and its changes are
    added to the log. Returns the snapshot's version. With ``names`` (name, version) the snapshot's name is registered, and one
    with the name of the last is not taken in again."""
    known = snapshots.versions()
    if names is not None and known:
        last = names.read().where(F.col("version") == known[-1]).select("name").first()
        if last and last["name"] == name:
            return known[-1]
    current = records.snapshot(rows, key, position)
    if known:
        columns = [c for c in snapshots.read().columns if c != key]
        changes = records.change_details(records.diff(snapshots.read(), current.select(key, *columns), key), columns)
        log.append(changes.withColumn("version", F.lit(len(known)).cast("bigint")))
    version = snapshots.write(current)
    if names is not None:
        names.append(names.spark.createDataFrame([(name, version)], "name string, version bigint"))
    return version


def changed_since(df: DataFrame, column: str, mark: object) -> tuple[DataFrame, object]:
    """Rows after a high-water mark in order, and the next mark (the old one if there are none)."""
    fresh = df if mark is None else df.where(F.col(column) > mark)
    top = fresh.agg(F.max(column)).first()[0]
    return fresh.orderBy(column), mark if top is None else top
