"""Embedding whitening by hierarchical SVD merging.

Each partition of the fit list keeps the number, sums, singular values and right vectors of its centred vectors, at full rank,
and takes in one Arrow batch after another. Two such summaries merge losslessly: the singular values times the
vectors of both are stacked with one more row, the difference of their means times sqrt(n1 n2 / (n1 + n2)), and decomposed again.
Partitions' summaries merge ``FAN`` at a time, level by level, until one is left, a matrix of dimension by dimension whatever
the number of rows. Sums are exact integers.

Vectors are first put on a grid, x = floor(scale * c), and the fit list holds each distinct x once, so copies don't
weigh. Vectors of different lengths live in different spaces and are fitted apart; their summaries are what the driver gets, so
lengths must be few.

Edge cases: null vectors and vectors that hold null or non-finite entries are dropped, a vector without entries has no
component and so no row; a component without variance (below rounding error, as for one single vector) has ``whitened``
null, and ``identity_error`` counts only the others (null if there are none); entries beyond the range of a long are put at its
end; a ``deviation`` beyond it is null; rows that repeat are all whitened; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, kind_of

SCALE, COMPONENTS, FAN = 256, 4, 8
EXACT = pa.decimal128(38, 0)
LONG = 1 << 63


def gridded(rows: DataFrame, key: str, column: str, scale: int = SCALE) -> DataFrame:
    """(key, x) of the rows whose vector is whole: x is an array of longs."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = rows.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return whole.select(F.col(key).alias("key"), F.transform(column, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dimension, int64 matrix, rows) of the vectors with entries in column ``at``, those of one dimension together."""
    for batch in batches:
        sizes = batch[at].value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]):
            own = batch.filter(pa.array(sizes == size))
            yield int(size), own[at].flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size)), own


class Summary(NamedTuple):
    """n vectors' exact sums (one integer a dimension) and the centred vectors' singular values times right vectors."""

    n: int
    sums: list[int]
    rows: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def decomposed(matrix: np.ndarray) -> np.ndarray:
    _, values, vectors = np.linalg.svd(matrix, full_matrices=False)
    return values[:, None] * vectors


def summary(x: np.ndarray) -> Summary:
    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
    sums = [int(a) + (int(b) << 32) for a, b in zip(low, high, strict=True)]
    own = Summary(len(x), sums, np.zeros((0, 0)))
    return own._replace(rows=decomposed(x - own.mean))


def merged(one: Summary, two: Summary) -> Summary:
    n = one.n + two.n
    mean_row = np.sqrt(one.n * two.n / n) * (one.mean - two.mean)
    return Summary(n, [a + b for a, b in zip(one.sums, two.sums, strict=True)], decomposed(np.vstack([one.rows, two.rows, mean_row])))


SUMMARIES = "slot bigint, dims int, n bigint, sums array<decimal(38,0)>, rows array<double>"


def packed(slot: int, found: dict[int, Summary]) -> pa.RecordBatch:
    names = ["slot", "dims", "n", "sums", "rows"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(EXACT), pa.list_(pa.float64())]
    columns = [[slot] * len(found), [*found], [s.n for s in found.values()], [s.sums for s in found.values()], [s.rows.ravel() for s in found.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def unpacked(dims: int, n: int, sums: list, rows) -> Summary:
    return Summary(n, [int(s) for s in sums], np.asarray(rows, float).reshape(-1, dims))


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    found: dict[int, Summary] = {}
    for dims, x, _ in matrices(batches):
        own = summary(x)
        found[dims] = merged(found[dims], own) if dims in found else own
    yield packed(TaskContext.get().partitionId(), found)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by dims and slot; only the running summary is held."""
    last, running = None, None
    for batch in batches:
        for row in batch.to_pylist():
            own = unpacked(row["dims"], row["n"], row["sums"], row["rows"])
            at = (row["slot"], row["dims"])
            if at != last and running is not None:
                yield packed(last[0], {last[1]: running})
            running = merged(running, own) if at == last else own
            last = at
    if running is not None:
        yield packed(last[0], {last[1]: running})


class Model(NamedTuple):
    """Of vectors of one length: how many, exact sums, eigenvalues (falling) and unit eigenvectors (rows) of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x minus the mean, exact sums of squares of n times that; None beyond a long)."""
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if largest * largest * max(len(self.sums), 1) < LONG:
            scaled = x * self.n - np.array(self.sums, np.int64)
            return scaled / self.n, (scaled * scaled).sum(axis=1).tolist()
        scaled = x.astype(object) * self.n - np.array(self.sums, object)
        squares = [int(s) for s in (scaled * scaled).sum(axis=1)]
        return (scaled / self.n).astype(float), [s if s < LONG else None for s in squares]

    def varies(self) -> np.ndarray:
        """Components whose variance isn't rounding error."""
        spread = np.sqrt(self.values)
        return spread > spread.max(initial=0) * max(len(self.values), 1) * 8 * np.finfo(float).eps

    def whitened(self, centred: np.ndarray, components: int) -> np.ndarray:
        """One column a component; NaN where it doesn't vary."""
        k = min(components, len(self.values))
        scale = np.where(self.varies(), np.sqrt(self.values), np.nan)[:k]
        return centred @ self.vectors[:k].T / scale


def fitted(fit_list: DataFrame) -> dict[int, Model]:
    """Models by length of vector, of a DataFrame with one column of arrays of longs."""
    level = cut(fit_list.mapInArrow(_summarised, SUMMARIES))
    slots = level.agg(F.max("slot")).first()[0] or 0
    while slots:
        slots //= FAN
        near = level.withColumn("slot", F.floor(F.col("slot") / FAN))
        level = cut(near.repartition(slots + 1, "dims", "slot").sortWithinPartitions("dims", "slot").mapInArrow(_merged, SUMMARIES))
    models = {}
    for row in level.toLocalIterator():
        own = unpacked(row.dims, row.n, row.sums, row.rows)
        _, values, vectors = np.linalg.svd(own.rows, full_matrices=True)  # the vectors that span nothing too
        values = np.concatenate([values, np.zeros(row.dims - len(values))])
        vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
        models[row.dims] = Model(own.n, own.sums, values**2 / own.n, vectors)
    return models


def whitened(grid: DataFrame, models: dict[int, Model], components: int | None = None) -> DataFrame:
    """(key, dims, n, deviation, whitened, explained) of every row of (key, x): the last two are arrays, by falling eigenvalue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, x, own in matrices(batches, 1):
            if dims not in models:
                continue
            model, k = models[dims], min(components or dims, dims)
            centred, deviation = model.centred(x)
            values = model.whitened(centred, k)
            lists = lambda m, mask: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(m.ravel(), pa.float64(), mask=mask))  # noqa: B023, E731
            share = model.values[:k] / model.values.sum() if model.values.sum() else np.zeros(k)
            columns = [own[0], pa.array([dims] * len(x), pa.int32()), pa.array([model.n] * len(x), pa.int64()), pa.array(deviation, pa.int64()), lists(values, np.isnan(values).ravel()), lists(np.tile(share, (len(x), 1)), None)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "dims", "n", "deviation", "whitened", "explained"])

    return grid.mapInArrow(run, f"key {kind_of(grid, 'key')}, dims int, n bigint, deviation bigint, whitened array<double>, explained array<double>")


def identity_errors(fit_list: DataFrame, models: dict[int, Model], components: int) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by length of vector, measured over all rows."""
    white = whitened(fit_list.select(F.lit(0).alias("key"), "x"), models, components).select("dims", "whitened")
    at = [F.get("whitened", F.lit(k)) for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    means = white.groupBy("dims").agg(*(F.avg(at[i]).alias(f"m{i}") for i in range(components)), *(F.avg(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in pairs))
    errors = {}
    for row in means.toLocalIterator():
        found = [abs(row[f"p{i}_{j}"] - row[f"m{i}"] * row[f"m{j}"] - (i == j)) for i, j in pairs if row[f"p{i}_{j}"] is not None]
        errors[row.dims] = max(found) if found else None
    return errors


def whitened_components(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each whole vector and component up to ``components``: key, component, n, deviation, whitened, explained, identity_error."""
    grid = gridded(rows, key, column)
    fit_list = cut(grid.select("x").distinct())
    models = fitted(fit_list)
    errors = identity_errors(fit_list, models, components)
    error = F.lit(None).cast("double")
    for dims, e in errors.items():
        error = F.when(F.col("dims") == dims, F.lit(e).cast("double")).otherwise(error)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value")
    out = whitened(grid, models, components).select("*", each)
    return out.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("value.whitened").alias("whitened"), F.col("value.explained").alias("explained"), error.alias("identity_error"))
