"""A stored inverted index: postings with positions, partitioned by ranges of tokens and added to in segments.

Tokens that begin with the same letter share a range, which is a partition of the stored table, and are sorted in its files, so a term or a
prefix reads its range alone, and of that only files and row groups whose tokens it lies between. A stored row is a block: a token's
postings in some hundred documents. Documents that are added make a segment of their own; ``merge``
writes all segments as one. Document frequencies, lengths and totals are stored with each segment, so ranks need
no pass over the texts. The manifest is a versioned table, so readers see a segment whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.search import query_terms
from docketry.sources.tables import VersionedTable

MANIFEST = "segment string, documents bigint, tokens bigint"
K1, B = 1.2, 0.75  # of BM25
SHARE = 100_000  # documents whose postings of one range may meet in one task
SENT = 2_000_000  # ids of known documents that are broadcast; of more, texts are shuffled by id
AT_ONCE = 500_000  # words that are sorted at once, beside those of one document


def words(text: Column) -> Column:
    """Words of letters and digits in order, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_range(token: Column) -> Column:
    """The partition of a token: its first letter or digit if that is ASCII, else ``u`` and the code point's block."""
    first = F.substring(token, 1, 1)
    return F.when(first.between("a", "z") | first.between("0", "9"), first).otherwise(F.concat(F.lit("u"), F.floor(F.ascii(token) / 256).cast("string")))


def _alike(term: str, whole: bool) -> Column:
    """Postings of a term, or of tokens that begin with it, by partition and by token."""
    near = F.col("range") == (term[0] if term[0].isascii() and term[0].isalnum() else f"u{ord(term[0]) // 256}")
    token = F.col("token")
    return near & (token == term) if whole else near & (token >= term) & F.startswith(token, F.lit(term))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) to (token, keys, tfs, positions): one row for each token in some hundred documents, in order of token and key,
    so that postings are shuffled, sorted and written by blocks and not one by one."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch[0]))
        sizes = np.diff(batch[1].offsets.to_numpy())
        groups = np.cumsum(sizes) // AT_ONCE
        starts = [*np.flatnonzero(np.diff(groups, prepend=-1)), len(groups)]
        for part, own in ((batch.slice(a, b - a), sizes[a:b]) for a, b in zip(starts, starts[1:], strict=False)):
            if not (total := int(own.sum())):
                continue
            at = np.arange(total) - np.repeat(np.cumsum(own) - own, own)
            coded = part[1].flatten().dictionary_encode()
            known = coded.dictionary.take(by_token := pc.sort_indices(coded.dictionary))
            rank = np.empty(len(known), np.int64)
            rank[by_token.to_numpy()] = np.arange(len(known))
            pairs = rank[coded.indices.to_numpy()] * len(own) + np.repeat(np.arange(len(own)), own)
            order = np.argsort(pairs, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(pairs[order], prepend=-1)), total)
            token, document = np.divmod(pairs[order[ends[:-1]]], len(own))
            blocks = np.append(np.flatnonzero(np.diff(token, prepend=-1)), len(token))
            listed = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
            keys, tfs = part[0].take(pa.array(document)), pa.array(np.diff(ends), pa.int32())
            positions = listed(ends, pa.array(at[order], pa.int32()))
            columns = [known.take(pa.array(token[blocks[:-1]])), *(listed(blocks, c) for c in (keys, tfs, positions))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "keys", "tfs", "positions"])


class TextIndex:
    """The index of one text column in a folder. Ids of documents are unique; nulls are no ids and no texts."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.manifest = VersionedTable(spark, f"{self.folder}/manifest", MANIFEST)

    def segments(self) -> list[str]:
        return [r.segment for r in self.manifest.read().select("segment").collect()]

    def _read(self, kind: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.folder}/{s}/{kind}") for s in self.segments()]
        if not parts:
            raise ValueError("the index has no segment yet")
        return reduce(DataFrame.unionByName, parts)

    def documents(self) -> DataFrame:
        """(key, length) of every document."""
        return self._read("documents")

    def postings(self) -> DataFrame:
        """(range, token, key, tf, positions)."""
        return self._each(self._read("postings"), "range", "token", tf="tfs", positions="positions")

    def _each(self, blocks: DataFrame, *columns: str, **parts: str) -> DataFrame:
        """One row for each posting of the blocks; of those parts that are named alone."""
        each = blocks.select(*columns, F.explode(F.arrays_zip("keys", *parts.values())).alias("__p"))
        return each.select(*columns, F.col("__p.keys").alias(self.key), *[F.col(f"__p.{c}").alias(n) for n, c in parts.items()])

    def _store(self, documents: DataFrame, blocks: DataFrame, terms: DataFrame | None = None) -> tuple[str, int, int]:
        name = f"s-{uuid.uuid4()}"
        documents.write.parquet(f"{self.folder}/{name}/documents")
        row = self.spark.read.parquet(f"{self.folder}/{name}/documents").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()

        def write(df: DataFrame, kind: str, by: Column) -> None:
            spread = df.repartition("range", F.pmod(F.hash(by), F.lit(1 + row[0] // SHARE))).sortWithinPartitions("range", "token")
            spread.write.partitionBy("range").parquet(f"{self.folder}/{name}/{kind}")

        write(blocks, "postings", F.get("keys", F.lit(0)))
        if terms is None:
            stored = self.spark.read.schema(blocks.schema).parquet(f"{self.folder}/{name}/postings")
            terms = stored.select("range", "token", F.size("tfs").cast("bigint").alias("df"), F.aggregate("tfs", F.lit(0).cast("bigint"), lambda n, tf: n + tf).alias("cf"))
        write(terms.groupBy("range", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "terms", F.col("token"))
        return name, row[0], row[1]

    def add(self, docs: DataFrame, text: str) -> int:
        """Documents (key, text) whose id isn't there yet become a segment, and are found from then on; how many."""
        fresh = docs.where(F.col(self.key).isNotNull()).select(self.key, text)
        if self.segments():
            known = self.documents().select(self.key)
            fresh = fresh.join(F.broadcast(known) if self._totals()[0] <= SENT else known, self.key, "left_anti")
        parted = fresh.select(self.key, words(F.col(text)).alias("__w"))
        blocks = parted.mapInArrow(blocks_of, f"token string, keys array<{docs.schema[self.key].dataType.simpleString()}>, tfs array<int>, positions array<array<int>>")
        name, documents, tokens = self._store(parted.select(self.key, F.size("__w").alias("length")), blocks.select(token_range(F.col("token")).alias("range"), "*"))
        if documents:
            self.manifest.append(self.spark.createDataFrame([(name, documents, tokens)], MANIFEST))
        return documents

    def merge(self) -> None:
        """All segments as one; those before stay until their folder is cleared, for readers that began with them."""
        if len(self.segments()) > 1:
            made = self._store(self.documents(), self._read("postings"), self._read("terms"))
            self.manifest.write(self.spark.createDataFrame([made], MANIFEST))

    def _totals(self) -> tuple[int, int]:
        row = self.manifest.read().agg(F.sum("documents"), F.sum("tokens")).first()
        return row[0] or 0, row[1] or 0

    def hits(self, terms: Sequence[str], whole: bool, **parts: str) -> DataFrame:
        """(term, token, key, df) and the named parts (tf and positions by default) of what the terms match; reads their ranges alone."""
        parts = parts or {"tf": "tfs", "positions": "positions"}
        near = lambda df: reduce(DataFrame.unionByName, [df.where(_alike(t, whole)).withColumn("term", F.lit(t)) for t in terms])
        seen = near(self._read("terms")).groupBy("term", "token").agg(F.sum("df").alias("df"))
        blocks = near(self._read("postings")).join(seen, ["term", "token"])
        return self._each(blocks, "term", "token", "df", **parts).select("term", "token", self.key, *parts, "df")

    def prefix_search(self, query: str, k: int = 50) -> DataFrame:
        """(key, score): documents in which every term is the beginning of a word, by the sum of tf * ln(1 + N / df), rounded."""
        terms = list(dict.fromkeys(query_terms(query)))
        if not terms:
            return self.documents().select(self.key, F.lit(0.0).alias("score")).limit(0)
        documents, _ = self._totals()
        weighed = self.hits(terms, False, tf="tfs").withColumn("w", F.col("tf") * F.log(1 + F.lit(documents) / F.col("df")))
        scored = weighed.groupBy(self.key).agg(F.countDistinct("term").alias("n"), F.round(F.sum("w"), 6).alias("score")).where(F.col("n") == len(terms))
        return scored.select(self.key, "score").orderBy(F.desc("score"), self.key).limit(k)

    def bm25(self, query: str, k: int = 50) -> DataFrame:
        """(key, score): documents that hold any of the query's words, by BM25, rounded."""
        terms = list(dict.fromkeys(query_terms(query)))
        if not terms:
            return self.documents().select(self.key, F.lit(0.0).alias("score")).limit(0)
        documents, tokens = self._totals()
        idf = F.log(1 + (F.lit(float(documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = 1 - B + B * F.col("length") / F.lit(tokens / max(documents, 1))
        each = self.hits(terms, True, tf="tfs").join(self.documents(), self.key).withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length))
        return each.groupBy(self.key).agg(F.round(F.sum("w"), 6).alias("score")).orderBy(F.desc("score"), self.key).limit(k)

    def phrase(self, query: str) -> DataFrame:
        """(key, times): documents that hold the query's words one after another, by their stored positions."""
        terms = query_terms(query)
        if not terms:
            return self.documents().select(self.key, F.lit(0).alias("times")).limit(0)
        own = self.postings()
        starts = [own.where(_alike(t, True)).select(self.key, F.transform("positions", lambda p: p - F.lit(n)).alias(f"p{n}")) for n, t in enumerate(terms)]  # noqa: B023
        both = reduce(lambda a, b: a.join(b, self.key), starts)
        common = reduce(F.array_intersect, [F.col(f"p{n}") for n in range(len(terms))])
        return both.select(self.key, F.size(common).alias("times")).where("times > 0")
