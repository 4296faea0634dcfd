"""Substring dedup with prefix-partitioned suffix trees over words.

A ``WINDOW``-word run (a window) holds one suffix start that is sampled: its run of ``PREFIX`` words of least hash,
wherever it stands. Equal windows hold equal ones, so the suffixes that start there are partitioned by that prefix and
a partition decides its windows alone. The windows of one prefix in one document are one record with one stretch of
text; equal stretches (copies) are aggregated to the smallest id before anything is compared.

Prefixes are of variable length. A prefix whose stretches fit (``GROUP`` of them) is a memory-sized group: its suffix
tree is built as sorted suffixes with common lengths, and its internal nodes of depth ``WINDOW`` or more say in which
document their words come first. A prefix with more is lengthened, step by step: its windows are parted by the place of
the sampled start in them, 16, 4 and then 1 places together, and the words that all windows of such a part share are
its longer prefix (35, 47, 50 words). Lengthened groups are aggregated and measured again, so one passage in very many
documents costs a few records a document and no group is large. Neighbouring repeated windows make the maximal
repeats, the spans that are removed.

Words are compared by their hashes, whose bases each run draws at random, so no texts can be built that meet.

Edge cases: null and empty texts have no words; texts of fewer than ``WINDOW`` words are never cut; null ids count as
larger than all others; equal ids never remove each other's words; rows that repeat id and text get the same result;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, groups, kind_of, mark, together
from docketry.llm.word_hash import Words, chunks, drawn, runs

WINDOW, PREFIX, GROUP = 50, 12, 500
BATCH_WORDS = 1 << 19
LAST = (1 << 63) - 1


def numbered(column: str) -> Column:
    """Ids as numbers, nulls last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values the index of its least one, the leftmost if several."""
    index, covered = np.arange(len(values)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = index[: len(index) - step], index[step:]
        index = np.where(values[left] <= values[right], left, right)
        covered += step
    return index


def part_sizes(window: int, prefix: int) -> list[int]:
    """Places of the sampled start that are taken together: all of them, then powers of 4 down to 1."""
    sizes = [1]
    while sizes[0] < window - prefix + 1:
        sizes.insert(0, 4 * sizes[0])
    return sizes


class Records:
    """Of a chunk's windows: ``doc``, ``start`` (word in the chunk) and ``count`` of each run with one prefix, and the
    hashes of the prefix (``core``) and of the ``stretch`` of words that the run covers. ``places`` of the sampled
    start in a window are taken together; the fewer, the longer the prefix."""

    def __init__(self, words: Words, window: int, prefix: int, places: int):
        self.words = words
        starts, (base, run) = words.gram_starts(window), words.bases
        none = np.zeros(0, np.int64)
        self.doc, self.start, self.count = none, none, none
        self.core = self.stretch = np.zeros(0, np.uint64)
        if not len(starts):
            return
        grams = runs(words.hash, np.arange(len(words.hash) - prefix + 1), np.arange(prefix, len(words.hash) + 1), run)
        at = least_in_windows(grams, window - prefix + 1)[starts]
        low = (at - starts) // places * places
        high = np.minimum(low + places - 1, window - prefix)
        core = runs(words.hash, at - low, at - high + window, run) if places <= window - prefix else grams[at]
        doc = words.doc_of()[starts]
        new = np.ones(len(starts), bool)  # runs of one repeated word have one prefix, however long they are
        new[1:] = (core[1:] != core[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.doc, self.start = doc[first], starts[first]
        self.count = np.diff(np.append(first, len(starts)))
        self.core = core[first]
        self.stretch = runs(words.hash, self.start, self.start + self.count + window - 1, base)

    def texts(self, data: np.ndarray, window: int) -> list[bytes]:
        begin, end = self.words.starts[self.start], self.words.ends[self.start + self.count + window - 2]
        return [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def scanned(docs: DataFrame, window: int, prefix: int, bases: tuple) -> DataFrame:
    """Per row: doc_id, mark and the arrays core, stretch, start, count of its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[2]):
                many = len(offsets) - 1
                words = Words(data, offsets, bases=bases)
                r = Records(words, window, prefix, part_sizes(window, prefix)[0])
                ends = np.concatenate([[0], np.cumsum(np.bincount(r.doc, minlength=many))]).astype(np.int32)
                lists = [r.core.view(np.int64), r.stretch.view(np.int64), (r.start - words.first[r.doc]).astype(np.int32), r.count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [batch[0].slice(row, many), batch[1].slice(row, many), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in lists)],
                    names=["doc_id", "mark", "core", "stretch", "start", "count"],
                )

    return docs.select("doc_id", mark(F.col("text")).alias("mark"), "text").mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, mark bigint, core array<bigint>, stretch array<bigint>, start array<int>, count array<int>")


PIECE = "core bigint, first bigint, stretch bigint, low bigint, at int, count int, part bigint, words binary"


def stretch_texts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The pieces (``PIECE``) that ``wanted`` (doc_id, mark, low, core, stretch, start, count) names, with their words;
    a piece is a run of windows, known by the first prefix, the stretch and the place of its first window there."""
    at = wanted.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.min("low").alias("low"), F.collect_list(F.struct("core", "stretch", "start", "count")).alias("parts"))
    named = docs.select("doc_id", mark(F.col("text")).alias("mark"), "text")
    both = named.join(at.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[0]):
                many = len(offsets) - 1
                words = Words(data, offsets)
                lists = batch[2].slice(row, many)
                parts = lists.flatten()
                doc = np.repeat(np.arange(many), lists.value_lengths().to_numpy())
                core, stretch, start, count = (parts.field(k) for k in range(4))
                begin = start.to_numpy() + words.first[doc]
                stop = begin + count.to_numpy() + window - 2
                texts = [data[a:b].tobytes() for a, b in zip(words.starts[begin].tolist(), words.ends[stop].tolist(), strict=True)]
                zero = pa.array(np.zeros(len(doc), np.int32))
                columns = [core, core, stretch, batch[1].slice(row, many).take(pa.array(doc)), zero, count, stretch, pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["core", "first", "stretch", "low", "at", "count", "part", "words"])

    return both.select("text", "low", "parts").mapInArrow(run, PIECE)


def lengthened(window: int, prefix: int, places: int, bases: tuple):
    """mapInArrow function over pieces: the pieces of them that have one longer prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[7]):
                r = Records(Words(data, offsets, bases=bases), window, prefix, places)
                own = pa.array(row + r.doc)
                at = batch[4].take(own).to_numpy() + (r.start - r.words.first[r.doc]).astype(np.int32)
                columns = [pa.array(r.core.view(np.int64)), *(batch[k].take(own) for k in (1, 2, 3)), pa.array(at), pa.array(r.count.astype(np.int32)), pa.array(r.stretch.view(np.int64)), pa.array(r.texts(data, window), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["core", "first", "stretch", "low", "at", "count", "part", "words"])

    return run


def suffix_tree(values: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, values that each has in common with the one before), up to a power of two not under
    ``depth``; position i ends before ``ends[i]``. Runs with ``depth`` or more in common are the internal nodes there."""
    n = len(values)
    position, ranks, covered = np.arange(n), [np.unique(values, return_inverse=True)[1].astype(np.int64) + 1], 1
    while covered < depth:
        last = ranks[-1]
        inside = position + covered < ends
        second = np.where(inside, last[np.minimum(position + covered, n - 1)], 0)
        ranks.append(np.unique(last * (int(last.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64) + 1)
        covered *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    room = np.minimum(ends[a] - a, ends[b] - b)
    for k in range(len(ranks) - 1, -1, -1):
        at = common[1:]
        fits = at < room
        x, y = np.minimum(a + at, n - 1), np.minimum(b + at, n - 1)
        at += np.where(fits & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
    common[1:] = np.minimum(common[1:], room)
    return order, common


def subtrees(window: int, bases: tuple):
    """mapInArrow function over pieces sorted by core: (first, stretch, offsets of windows that start in a smaller document)."""

    def solve(held: list[list[pa.Array]]) -> pa.RecordBatch:
        first, stretch, low, at = (np.concatenate([g[k].to_numpy() for g in held]) for k in range(1, 5))
        parts = [Words(data, offsets, bases=bases) for _, data, offsets in chunks(pa.concat_arrays([g[7] for g in held]))]
        sizes = np.concatenate([np.diff(w.first) for w in parts])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        piece = np.repeat(np.arange(len(sizes)), sizes)
        order, common = suffix_tree(np.concatenate([w.hash for w in parts]), begins[1:][piece], window)
        owner = piece[order]
        inner = common < window
        inner[0] = True
        node = np.cumsum(inner) - 1
        least = np.minimum.reduceat(low[owner], np.flatnonzero(inner))
        hit = least[node] < low[owner]
        place = np.sort(order[hit])
        owner = piece[place]
        kept, edges = np.unique(owner, return_index=True)
        offsets = (place - begins[:-1][owner] + at[owner]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(owner)).astype(np.int32)), pa.array(offsets))
        return pa.RecordBatch.from_arrays([pa.array(first[kept]), pa.array(stretch[kept]), lists], names=["first", "stretch", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for columns in groups(batches, 1):
            if len(columns[0]) > 1:
                held.append(columns)
                size += len(columns[0]) * 2 * window
            if size > BATCH_WORDS:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return run


def grouped(pieces: DataFrame, group: int, window: int, prefix: int, sizes: list[int], bases: tuple) -> DataFrame:
    """(first, stretch, offsets) of the windows of ``pieces`` that start in a smaller document: prefixes with up to
    ``group`` pieces become subtrees, others are lengthened to the next of ``sizes``."""
    out = None
    for places in sizes:
        pieces = cut(pieces.mapInArrow(lengthened(window, prefix, places, bases), PIECE))
        spots = F.sequence("at", F.expr("at + count - 1")).alias("offsets")
        if places == 1:  # the prefix is the whole window, also in runs of one word, whose parts differ in length
            least = pieces.groupBy("core", "first").agg(F.min("low").alias("least"))
            later = pieces.join(cut(least), ["core", "first"]).where("low > least").select("first", "stretch", spots)
            return later if out is None else out.unionByName(later)
        by_low = pieces.groupBy("core", "part", "low").agg(F.count("*").alias("n"))
        by_part = by_low.groupBy("core", "part").agg(F.min("low").alias("least"), F.max("low").alias("most"), F.min_by("n", "low").alias("n"))
        shared = by_part.groupBy("core").agg(F.sum("n").alias("many"), F.min("least").alias("low"), F.max("most").alias("high")).where("low < high").select("core", "many")
        placed = cut(pieces.join(by_part.select("core", "part", "least").join(shared, "core"), ["core", "part"]))
        later = placed.where("low > least").select("first", "stretch", spots)
        own = placed.where("low = least AND many > 1")
        found = later.unionByName(in_subtrees(own.where(F.col("many") <= group), window, bases))
        out = found if out is None else out.unionByName(found)
        pieces = own.where(F.col("many") > group).select(*[c.split(" ")[0] for c in PIECE.split(", ")])
        if pieces.isEmpty():
            break
    return out


def in_subtrees(pieces: DataFrame, window: int, bases: tuple) -> DataFrame:
    columns = [c.split(" ")[0] for c in PIECE.split(", ")]
    return together(pieces.select(*columns), "core").mapInArrow(subtrees(window, bases), "first bigint, stretch bigint, offsets array<int>")


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(doc_id, mark, spans): runs of words [start, stop) covered by windows that also start in a smaller document."""
    bases = drawn()
    rows = cut(scanned(docs, window, prefix, bases))
    records = rows.select("doc_id", "mark", F.explode(F.arrays_zip("core", "stretch", "start", "count")).alias("r")).select("doc_id", "mark", "r.*").withColumn("number", numbered("doc_id"))
    known = records.groupBy("core", "stretch").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    several = known.groupBy("core").agg(F.count("*").alias("many"), F.min("low").alias("least"), F.max("high").alias("most"))
    shared = known.join(several.where("least < most"), "core").select("core", "stretch", "low", "many")
    met = cut(records.join(shared, ["core", "stretch"]))
    wanted = met.where("many > 1 AND number = low").dropDuplicates(["core", "stretch"])
    texts = cut(stretch_texts(docs, wanted.select("doc_id", "mark", "low", "core", "stretch", "start", "count"), window))
    crowded = met.where(F.col("many") > group).select("core").distinct()
    calm, hot = texts.join(crowded, "core", "left_anti"), texts.join(crowded, "core", "left_semi")
    found = in_subtrees(calm, window, bases).unionByName(grouped(hot, group, window, prefix, part_sizes(window, prefix)[1:], bases))
    verdicts = cut(found.groupBy(F.col("first").alias("core"), "stretch").agg(F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets")))  # a table, so that Spark can split a stretch of many copies
    judged = met.join(verdicts, ["core", "stretch"], "left").where("number > low OR offsets IS NOT NULL")
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("count") + (window - 1)).alias("stop")))
    single = F.transform("offsets", lambda o: F.struct((F.col("start") + o).alias("start"), (F.col("start") + o + window).alias("stop")))
    spans = judged.select("doc_id", "mark", F.explode(F.when(F.col("number") > F.col("low"), whole).otherwise(single)).alias("span"))
    return spans.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _kept(docs: DataFrame, window: int, prefix: int, group: int, text: bool) -> DataFrame:
    """``docs`` rows (id, mark, text, other columns) to words kept, as digests or as texts."""
    spans = cut(repeated_spans(docs, window, prefix, group).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("spans.start").alias("__from"), F.col("spans.stop").alias("__to")))
    named = docs.withColumn("__mark", mark(F.col("text")))
    both = named.join(spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__m")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums, texts = [], [], [], []
            starts, stops = batch[2], batch[3]
            for row, data, offsets in chunks(batch[1]):
                words = Words(data, offsets)
                for d, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist(), strict=False)):
                    first, last = words.starts[a:b], words.ends[a:b]
                    total.append(b - a)
                    if starts[row + d].is_valid:
                        edges = np.zeros(b - a + 1, np.int64)
                        np.add.at(edges, starts[row + d].values.to_numpy(), 1)
                        np.add.at(edges, stops[row + d].values.to_numpy(), -1)
                        stay = np.cumsum(edges[:-1]) == 0
                        removed.append(b - a - int(stay.sum()))
                        first, last = first[stay], last[stay]
                    else:
                        removed.append(0)
                    own = b" ".join([data[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)])
                    texts.append(own) if text else sums.append(hashlib.sha256(own).hexdigest())
            last = pa.array(texts, pa.binary()).cast(pa.string()) if text else pa.array(sums, pa.string())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), last], names=["doc_id", "n_words", "n_removed", "kept" if text else "kept_sha256"])

    return both.select("doc_id", "text", "__from", "__to").mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, n_words bigint, n_removed bigint, {'kept' if text else 'kept_sha256'} string")


def kept_digests(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a blank)."""
    return _kept(docs, window, prefix, group, False)


def kept_texts(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the kept words joined by a blank)."""
    return _kept(docs, window, prefix, group, True)


#: DuckDB SQL for ``op5_substring_dedup``; windows are compared by their words.
ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
windows AS (SELECT r, doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM words, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS k)),
first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT r, list(k) AS spots FROM windows JOIN first USING (h) WHERE coalesce(least < doc_id, least IS NOT NULL) GROUP BY r),
covered AS (SELECT DISTINCT r, k + o AS place FROM (SELECT r, unnest(spots) AS k FROM gone), (SELECT unnest(generate_series(0, 49)) AS o)),
removed AS (SELECT r, list(place) AS places FROM covered GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(coalesce(places, []), k)), ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (r)
"""
