"""Sharding along a Hilbert curve.

Source, language and size are quantised to ``bits`` bits each; the curve index orders all rows, so that a shard (a
run of the order) covers a small box of metadata and file statistics prune on every dimension. Sources and languages
have no order of their own and are quantised by hash: what shares one shares a cell, neighbours mean nothing there. The
law is ``rows``: shard sizes differ by one row at most. Within a cell rows follow a hash of the id, so a source or a group of copies
that holds a third of all rows spreads over many tasks and shards.

Edge cases: null texts have no bytes and CRC 0; null metadata is a value of its own; rows with equal ids and texts
are interchangeable; fewer rows than shards leave the last shards empty; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut

SHARDS = 24


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of ``cells`` (n x dimensions, each below 2**bits): undo the curve's rotations
    and reflections from the coarsest bit down, Gray-code, then interleave bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def curve(bits: int, *dims: Column) -> Column:
    @F.pandas_udf("long")
    def index(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index(*dims)


def placed(docs: DataFrame, keep: Column, shards: int, bits: int) -> DataFrame:
    """Per row: doc_id, size, text_crc32, hilbert, keep, shard, slot."""
    spark, top = docs.sparkSession, (1 << bits) - 1
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    cell = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit("\0"))), F.lit(top + 1)).cast("int")
    log = F.least(F.lit(top), F.floor(F.log2(size.cast("double")) * (bits / 2))).cast("int")
    keyed = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), curve(bits, cell("source"), cell("lang"), log).alias("hilbert"), keep.alias("keep"))
    order = [F.col("hilbert"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # a number for each partition
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "part int, before long")
    ranked = rows.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("at"))
    small, more = divmod(total, shards)
    edge, rank = more * (small + 1), F.col("rank")
    late = rank - edge
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(more + F.floor(late / max(small, 1)))
    slot = F.when(rank < edge, rank % (small + 1)).otherwise(late % max(small, 1))
    return ranked.select("doc_id", "size", "text_crc32", "hilbert", "keep", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = 6) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    rows = placed(docs, F.lit(None).cast("int"), shards, bits)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = 6) -> None:
    """Files of whole rows, one folder ``shard=N`` for each, in curve order; every row of ``docs`` is written once, repeated ones
    too. A column ``shard`` of ``docs`` gives way to the folder's."""
    columns = [c for c in docs.columns if c != "shard"]
    rows = placed(docs, F.struct(*columns), shards, bits).select("shard", "slot", "keep")
    ordered = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
    ordered.select("keep.*", "shard").write.partitionBy("shard").parquet(path)
