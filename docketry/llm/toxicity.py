"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word counts in itself and through its first letters (toxic stems take many endings), so n-grams and skip-grams are
over both forms. Features are hashed to ``2**bits`` coordinates, each with its own learning rate; the L1 term leaves
few weights, which are broadcast. Training takes at most ``max_rows`` labelled rows (a bounded sample by hash of the
id, each with one text of that id), whose sparse rows are computed by many tasks and learnt in one.

Edge cases: null and empty texts score the bias; labels that are null, and label rows without a document, teach
nothing; of several labels of one id toxic counts, of several texts the one of least digest; without labels every score is
next to 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import kind_of, mark, returned
from docketry.llm.word_hash import BASE, RUN, Words, chunks, mix, runs

BITS, MAX_ROWS, EPOCHS = 20, 10_000, 5
STEMS = (4, 5, 6)
THRESHOLD = 0.3
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTERLESS = np.zeros(256, bool)
LETTERLESS[:128] = True
LETTERLESS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every feature of a chunk, with repeats."""
    doc, n = words.doc_of(), len(words.hash)
    data = FOLD[words.data].astype(np.uint64) + np.uint64(1)
    salted = [(doc, words.hash)]
    kinds = [words.hash]
    for k in STEMS:
        long = words.ends - words.starts > k
        stem = runs(data, words.starts[long], words.starts[long] + k, BASE)
        salted.append((doc[long], mix(stem + np.uint64(k))))
        if k == 5:
            form = words.hash.copy()
            form[long] = stem
            kinds.append(form)
    for salt, form in enumerate(kinds):
        for gap in (1, 2):  # next word, and skip-gram over one word
            same = doc[:-gap] == doc[gap:] if n > gap else np.zeros(0, bool)
            pair = mix(form[:-gap] * RUN + form[gap:] + np.uint64(100 + 10 * salt + gap)) if n > gap else np.zeros(0, np.uint64)
            salted.append((doc[: len(same)][same], pair[same]))
    docs = np.concatenate([d for d, _ in salted])
    coordinates = (np.concatenate([h for _, h in salted]) >> np.uint64(64 - bits)).astype(np.int64)
    return docs, coordinates


def distinct(docs: np.ndarray, coordinates: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((docs << bits) | coordinates)
    return both >> bits, both & ((1 << bits) - 1)


class FTRL:
    """Per-coordinate FTRL-proximal with L1 and L2 over sparse 0/1 rows; the last coordinate is the bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        w = -(z - np.sign(z) * self.l1) / step
        w[np.abs(z) <= self.l1] = 0
        return w

    def learn(self, row: np.ndarray, label: int) -> None:
        at = np.append(row, len(self.z) - 1)
        w = self.weights(at)
        slope = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        grown = self.n[at] + slope * slope
        self.z[at] += slope - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias): the non-zero ones, at most one for each coordinate."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    judged = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # a heap of max_rows on each task
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = met.groupBy("doc_id").agg(F.min_by("text", mark(F.col("text"))).alias("text"), F.max("toxic").alias("toxic"))  # one text for each id

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for _, data, offsets in chunks(batch[1]):
                doc, at = distinct(*features(Words(data, offsets, FOLD, LETTERLESS), bits), bits)
                lists += np.split(at.astype(np.int32), np.searchsorted(doc, np.arange(1, len(offsets) - 1)))
            yield pa.RecordBatch.from_arrays([batch[0], batch[2], pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "toxic", "row"])

    def fit(share: pd.DataFrame) -> pd.DataFrame:
        share = share.sort_values(["doc_id", "toxic"], kind="stable")
        model, given = FTRL(bits), [np.asarray(r) for r in share["row"]]
        wanted = share["toxic"].to_numpy()
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(given)):
                model.learn(given[k], wanted[k])
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        return pd.DataFrame({"at": kept, "w": w[kept]})

    sparse = rows.mapInArrow(vectors, f"doc_id {kind_of(docs, 'doc_id')}, toxic int, row array<int>")
    found = sparse.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "at bigint, w double").toPandas()
    at, w = found["at"].to_numpy(np.int64), found["w"].to_numpy(np.float64)
    bias = w[at == 1 << bits]
    return at[at < 1 << bits], w[at < 1 << bits], float(bias[0]) if len(bias) else -50.0


def scorer(model: tuple[np.ndarray, np.ndarray, float], bits: int) -> Callable[[pa.Array], np.ndarray]:
    """Function from texts to scores."""
    at, w, bias = model
    dense = np.zeros(1 << bits)
    dense[at] = w

    def scores(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for row, data, offsets in chunks(texts):
            doc, spot = features(Words(data, offsets, FOLD, LETTERLESS), bits)
            live = dense[spot] != 0
            doc, spot = distinct(doc[live], spot[live], bits)
            out[row : row + len(offsets) - 1] = np.bincount(doc, dense[spot], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(out + bias, -50, 50)))

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(sent.value, bits)
        for batch in batches:
            p = scores(batch[1])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``docs``, all columns, that aren't predicted toxic."""
    sent, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bits)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(sent.value, bits)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch[at]) < THRESHOLD))

    return docs.mapInArrow(returned(run), docs.schema)
