"""An approximate nearest-neighbour index: an inverted file of cells with product-quantised residuals, stored as tables.

Cells and codebooks are k-means centres learnt on at most ``SAMPLE`` vectors (those of least hash of the id); every vector is put
into its cell and its residual coded in a byte for each of its parts. Codes are stored in blocks of ``BLOCK`` vectors by cell.
A query probes the nearest cells, whose blocks meet it in an equi-join by cell, so a crowded cell is many rows that
Spark spreads; each block gives its best candidates by decoded vectors, and those are ranked exactly with their
own vectors. How many cells are probed is measured on the sample, so that the exact neighbours are found with ``RECALL``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centres are learnt on, queries that probing is measured on, and the share of neighbours that must be in probed cells.
SAMPLE, MEASURED, RECALL = 20_000, 200, 0.97
CELLS, PARTS, CODES, ROUNDS = 1024, 16, 256, 12
BLOCK, QUERIES = 4096, 1024
#: Candidates for each neighbour asked that are ranked exactly.
REFINED = 8


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct vectors; centres that lose all their vectors stay where they were."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        at = closest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Codebook:
    """Cells' centres (k x d), and for each part of the dimensions its centres."""

    def __init__(self, cells: np.ndarray, parts: list[np.ndarray], probes: int):
        self.cells, self.parts, self.probes = cells, parts, probes
        self.edges = np.cumsum([0, *(p.shape[1] for p in parts)])

    @classmethod
    def learnt(cls, sample: np.ndarray, cells: int = CELLS, parts: int = PARTS) -> Codebook:
        x = unit(sample)
        centres = k_means(x, min(cells, max(1, int(np.sqrt(len(x))))), 1)
        rest = x - centres[closest(x, centres)]
        books = [k_means(p, CODES, 2 + n) for n, p in enumerate(np.array_split(rest, min(parts, x.shape[1]), axis=1))]
        return cls(centres, books, cls._probes(x, centres))

    @staticmethod
    def _probes(x: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
        """Fewest cells that hold ``RECALL`` of the exact neighbours of some sampled vectors."""
        asked = x[:MEASURED]
        near = np.argsort(-(asked @ x.T), axis=1)[:, :k]
        order = np.argsort(-(asked @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
        needed = np.take_along_axis(place, closest(x, centres)[near], 1)
        found = [(needed < p).mean() for p in range(1, len(centres) + 1)]
        return int(np.argmax(np.array(found) >= RECALL)) + 1

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = closest(x, self.cells)
        rest = x - self.cells[cell]
        codes = [closest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.parts, strict=False)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.cells[cell] + np.concatenate([book[codes[:, n]] for n, book in enumerate(self.parts)], axis=1)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(x @ self.cells.T), axis=1, kind="stable")[:, :probes]


class VectorIndex:
    """Index of (key: long, vector: array of numbers of one length) in a folder. Null vectors aren't indexed; of those without length no query is near."""

    def __init__(self, spark: SparkSession, folder: str, key: str, vector: str):
        self.spark, self.folder, self.key, self.vector = spark, folder.rstrip("/"), key, vector

    def build(self, vectors: DataFrame, cells: int = CELLS) -> None:
        """Learns the codebook and indexes every vector; ``add`` puts further ones in."""
        own = vectors.where(F.col(self.vector).isNotNull()).select(F.col(self.key).cast("long"), F.col(self.vector).cast("array<double>"))
        sample = own.orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE).toArrow()
        if not sample.num_rows:
            raise ValueError("there is no vector to learn cells from")
        book = Codebook.learnt(rows_of(sample.column(1).combine_chunks()), cells)
        rows = [("probes", 0, 0, [float(book.probes)]), *(("cell", 0, n, c.tolist()) for n, c in enumerate(book.cells)), *(("part", p, n, c.tolist()) for p, part in enumerate(book.parts) for n, c in enumerate(part))]
        self.spark.createDataFrame(rows, "kind string, part int, number int, centre array<double>").coalesce(1).write.parquet(f"{self.folder}/codebook")
        self.add(vectors)

    def codebook(self) -> Codebook:
        kept: dict[tuple[str, int], list] = {}
        for r in self.spark.read.parquet(f"{self.folder}/codebook").orderBy("kind", "part", "number").toLocalIterator():
            kept.setdefault((r.kind, r.part), []).append(r.centre)
        parts = [np.array(v) for (kind, _), v in sorted(kept.items()) if kind == "part"]
        return Codebook(np.array(kept["cell", 0]), parts, int(kept["probes", 0][0][0]))

    def add(self, vectors: DataFrame) -> None:
        """Vectors put into their cells, as further blocks; ids that are there must not come again."""
        book = self.codebook()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, codes = book.encoded(unit(rows_of(batch[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch[0], pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

        own = vectors.where(F.col(self.vector).isNotNull()).select(F.col(self.key).cast("long"), F.col(self.vector).cast("array<double>"))
        coded = own.mapInArrow(encode, "cell int, id bigint, code binary")
        folder = f"{self.folder}/codes-staged"
        coded.write.mode("overwrite").parquet(folder)
        coded = self.spark.read.schema(coded.schema).parquet(folder)
        many = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n"))  # at most as many rows as cells
        placed = coded.join(F.broadcast(many), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "n"))
        blocks = placed.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "code")).alias("r"))  # about BLOCK rows
        blocks.select("cell", F.col("r.id").alias("ids"), F.col("r.code").alias("codes")).write.mode("append").parquet(f"{self.folder}/codes")

    def nearest(self, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query, key, score, position) as ``search.nearest``: the best ``k`` by cosine among the candidates of the probed cells."""
        book = self.codebook()
        probes, wanted = min(probes or book.probes, len(book.cells)), k * REFINED
        asked = queries.where(F.col(self.vector).isNotNull()).select(F.col(self.key).cast("long").alias("query"), F.col(self.vector).cast("array<double>").alias("q"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = book.probed(unit(rows_of(batch[1])), probes)
                    at = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch[0].take(at), batch[1].take(at), pa.array(cells.ravel(), pa.int32())], names=["query", "q", "cell"])

        met = asked.mapInArrow(probe, "query bigint, q array<double>, cell int")
        by_cell = met.groupBy("cell", F.pmod(F.xxhash64("query"), F.lit(self._query_blocks(queries))).alias("b")).agg(F.collect_list(F.struct("query", "q")).alias("r"))
        pairs = self.spark.read.parquet(f"{self.folder}/codes").join(by_cell.select("cell", F.col("r.query").alias("queries"), F.col("r.q").alias("qs")), "cell")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    cell, ids, codes, named, qs = (c[n] for c in batch.columns)
                    ids, named = ids.values.to_numpy(), named.values.to_numpy()
                    own = book.decoded(cell.as_py(), np.frombuffer(b"".join(codes.values.to_pylist()), np.uint8).reshape(len(ids), -1))
                    score = unit(rows_of(qs.values)) @ own.T
                    keep = min(wanted, len(ids))
                    order = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                    columns = [np.repeat(named, keep), ids[order.ravel()], np.take_along_axis(score, order, 1).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "near"])

        candidates = pairs.select("cell", "ids", "codes", "queries", "qs").mapInArrow(best, "query bigint, id bigint, near double")
        first = candidates.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "id"))).where(F.col("n") <= wanted)
        own = vectors.select(F.col(self.key).alias("id"), F.col(self.vector).cast("array<double>").alias("v"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        length = F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v"))
        scored = first.select("query", "id").join(own, "id").join(asked, "query").select("query", F.col("id").alias(self.key), F.round(F.when(length > 0, dot("q", "v") / length), 6).alias("score"))
        window = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), self.key)
        return scored.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)

    def _query_blocks(self, queries: DataFrame) -> int:
        return max(1, -(-queries.count() // QUERIES))


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """Share of the exact neighbours (query, key) that were found."""
    row = exact.select("query", key).join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left").agg(F.count("*"), F.count("hit")).first()
    return row[1] / row[0] if row[0] else 1.0
