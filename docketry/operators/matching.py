"""Matching within blocks, folds in order, and validation of incoming rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.texts import ratio, remembered
from docketry.operators.staging import settle

# How sure a match must be.
THRESHOLD, MARGIN, PAGE_BONUS, CANDIDATES = 0.55, 0.08, 0.15, 5
# Rows of one side that a task compares with the other's at once, large blocks that are broadcast, texts whose characters a task remembers.
PIECE, LARGE_SENT, KNOWN_TEXTS = 512, 100_000, 1 << 12


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _counts(c: Column) -> Column:
    """How often a text holds each of ``LETTERS``, and any other character."""
    own = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in LETTERS]
    known = F.translate(c, LETTERS, "")
    return F.array(*own, F.length(known))


def bounded_pairs(files: DataFrame, index: DataFrame, block: str = "docket_id") -> DataFrame:
    """(file_id, block, entry_id, a, b, bonus, bound) of files and index rows of one block: the texts to compare, and what
    their score is at most. Twice the characters that two texts share, over the sum of their lengths, is no less than their ratio.
    Characters are counted once for each record. ``resolve_files`` makes no such table; this is for looking at pairs."""
    strip = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lower(F.col(block).cast("string")), F.lit(" ")), r"\s+", " "))

    def sides(df: DataFrame, text: str, name: str) -> DataFrame:
        whole, short = F.lower(F.coalesce(F.col(text), F.lit(""))), F.coalesce(strip(F.col(text)), F.lit(""))
        one = lambda c: F.struct(c.alias("t"), F.length(c).alias("n"), _counts(c).alias("c"))
        return df.withColumns({f"{name}_short": one(short), f"{name}_whole": one(whole)}).drop(text)

    left = sides(files.select("file_id", block, "stem", "pages"), "stem", "f")
    right = sides(index.select(block, "entry_id", "name", F.col("pages").alias("row_pages")), "name", "r")
    both = left.join(right, block)
    bare = (F.col("f_short.n") == 0) | (F.col("r_short.n") == 0)
    x, y = (F.when(bare, F.col(f"{side}_whole")).otherwise(F.col(f"{side}_short")) for side in "fr")
    pairs = both.withColumns({"x": x, "y": y, "bonus": F.when(F.col("pages") == F.col("row_pages"), PAGE_BONUS).otherwise(0.0)})
    shared = F.aggregate(F.zip_with("x.c", "y.c", lambda m, n: F.least(m, n)), F.lit(0), lambda t, n: t + n)
    total = F.col("x.n") + F.col("y.n")
    bound = F.when(total == 0, 1.0).otherwise(2.0 * shared / total) + F.col("bonus")
    return pairs.select("file_id", block, "entry_id", F.col("x.t").alias("a"), F.col("y.t").alias("b"), "bonus", bound.alias("bound"))


def worth_verifying(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of the best bounds with their score, other pairs whose bound reaches the last of a file's best scores)."""
    rank = Window.partitionBy("file_id").orderBy(F.desc("bound"), "entry_id")
    ranked = settle(pairs.withColumn("n", F.row_number().over(rank)))
    first = settle(ranked.where(F.col("n") <= CANDIDATES).withColumn("score", ratio("a", "b") + F.col("bonus")))
    least = first.groupBy("file_id").agg(F.min("score").alias("least"), F.count("*").alias("many")).where(F.col("many") == CANDIDATES).select("file_id", "least")
    rest = ranked.where(F.col("n") > CANDIDATES).join(least, "file_id").where(F.col("bound") >= F.col("least") - 1e-9).drop("least")
    return first, rest


def _texts(df: DataFrame, text: str, block: str) -> tuple[Column, Column]:
    """A name in lower case, without the block it lies in and as it is; null is empty."""
    whole = F.lower(F.coalesce(F.col(text), F.lit("")))
    bare = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lower(F.col(block).cast("string")), F.lit(" ")), r"\s+", " "))
    return F.coalesce(bare, F.lit("")), whole


def _pieces(files: DataFrame, index: DataFrame, block: str) -> DataFrame:
    """Rows of both sides (block, i, j, entry_id or file_id, short, whole where it is another, pages) sorted by piece, index rows first and by entry. A
    block is one piece; of those with more than ``PIECE`` rows on a side files are cut in parts i, index rows in parts j, and every i
    meets every j, so no task has a whole large block."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = {c: df.schema[c].dataType for df, c in ((files, "file_id"), (index, "entry_id"))}

    def side(df: DataFrame, text: str, key: str, ordinal: int) -> DataFrame:
        ids = [(F.col(c) if c == key else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()]
        short, whole = _texts(df, text, block)
        return df.select(F.col(block).alias("block"), F.lit(ordinal).alias("file"), *ids, short.alias("short"), F.nullif(whole, short).alias("whole"), "pages")

    rows = side(index.where(F.col(block).isNotNull()), "name", "entry_id", 0).unionByName(side(files, "stem", "file_id", 1))
    sizes = rows.groupBy("block").agg(F.count_if(F.col("file") == 1).alias("n_files"), F.count_if(F.col("file") == 0).alias("n_index"))
    large = settle(sizes.where(F.col("block").isNotNull() & (F.greatest("n_files", "n_index") > PIECE)).select("block", *[F.ceil(F.col(c) / PIECE).alias(c) for c in ("n_files", "n_index")]))
    cut = rows.join(F.broadcast(large) if large.count() <= LARGE_SENT else large, "block", "left")
    part = lambda key, many: F.pmod(F.xxhash64(key), F.coalesce(many, F.lit(1)))
    every = lambda many: F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(many), F.lit(1)) - 1)
    own = cut.withColumn("i", F.explode(F.when(F.col("file") == 1, F.array(part("file_id", F.col("n_files")))).otherwise(every("n_files"))))
    own = own.withColumn("j", F.explode(F.when(F.col("file") == 0, F.array(part("entry_id", F.col("n_index")))).otherwise(every("n_index"))))
    dealt = own.repartition(tasks, F.xxhash64("block", "i", "j"))  # by one hash, so no join before is taken for it
    return dealt.sortWithinPartitions("block", "i", "j", "file", "entry_id").select("block", "i", "j", "file", "file_id", "entry_id", "short", "whole", "pages")


def _letters(text: str) -> np.ndarray:
    """How often a text holds each of the first 127 characters, and any other."""
    return np.bincount(np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127), minlength=128)


class _Piece:
    """The index rows of a piece, in order, and the best of them for a file."""

    def __init__(self, score: Callable[[str, str], float], letters: Callable[[str], np.ndarray]):
        self.score, self.letters, self.rows, self.counts = score, letters, [], None

    def best(self, short: str, whole: str, pages: object) -> list[tuple[float, int]]:
        """(score with its sign turned, place of the row) of the ``CANDIDATES`` best rows. Rows are compared by falling bound, as long as theirs reaches the
        last of the best: twice the characters that two texts share, over the sum of their lengths, is no less than their ratio."""
        pairs = [(short, s) if short and s else (whole, w) for s, w, _ in self.rows]
        bonus = [PAGE_BONUS if pages is not None and pages == p else 0.0 for _, _, p in self.rows]
        if len(pairs) <= CANDIDATES:
            return sorted((-(self.score(x, y) + more), k) for k, ((x, y), more) in enumerate(zip(pairs, bonus, strict=True)))
        if self.counts is None:
            self.counts = [np.stack([self.letters(r[k]) for r in self.rows]) for k in (0, 1)]
            self.lengths = [c.sum(axis=1) for c in self.counts]
        bounds = np.empty(len(pairs))
        bare = np.array([not (short and s) for s, _, _ in self.rows])
        for own, at, k in ((short, ~bare, 0), (whole, bare, 1)):
            total = self.lengths[k][at] + len(own)
            bounds[at] = np.where(total == 0, 1.0, 2.0 * np.minimum(self.counts[k][at], self.letters(own)).sum(axis=1) / np.maximum(total, 1))
        bounds += bonus
        found: list[tuple[float, int]] = []
        for k in np.argsort(-bounds, kind="stable").tolist():
            if len(found) == CANDIDATES and bounds[k] < -found[-1][0] - 1e-9:
                break
            found = sorted([*found, (-(self.score(*pairs[k]) + bonus[k]), k)])[:CANDIDATES]
        return found


def _candidates(files: DataFrame, index: DataFrame, block: str) -> DataFrame:
    """(file_id, block, times, turned, entries): for each file row and each part of its block's index rows the best few, best first, with the sign of
    scores turned. ``times`` is 1 in one of the rows that a file row gives, else 0. Pairs are neither stored nor shuffled."""
    pieces = _pieces(files, index, block)
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, letters, at, piece = remembered(), lru_cache(KNOWN_TEXTS)(_letters), None, None
        for batch in batches:
            block_kind, file_kind, entry_kind = (batch[k].type for k in (0, 4, 5))
            out: list[tuple] = []
            for own, i, j, file, file_id, entry_id, short, whole, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = short if whole is None else whole
                if (own, i, j) != at:
                    at, piece, entries = (own, i, j), _Piece(score, letters), []
                if not file:
                    piece.rows.append((short, whole, pages))
                    entries.append(entry_id)
                else:
                    best = piece.best(short, whole, pages)
                    out.append((file_id, own, int(j == 0), [n for n, _ in best], [entries[k] for _, k in best]))
            kinds = [file_kind, block_kind, pa.int64(), pa.list_(pa.float64()), pa.list_(entry_kind)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["file_id", "block", "times", "turned", "entries"])

    return pieces.mapInArrow(run, f"file_id {kinds['file_id']}, block {kinds['block']}, times bigint, turned array<double>, entries array<{kinds['entry_id']}>")


def resolve_files(files: DataFrame, index: DataFrame, block: str = "docket_id") -> DataFrame:
    """Per file (file_id, block, stem, pages): the index row (entry_id, block, name, pages) it matches best within its
    block, its score, and the best few candidates. No match below the threshold or when the next one is too near.
    Files and rows of a block meet in one task, those of a large block part by part (``_pieces``); what leaves it are the best few
    of each file there, so disk grows with files and rows, not with pairs."""
    own = _candidates(files, index, block).groupBy("file_id").agg(F.sum("times").alias("times"), F.collect_list(F.struct("turned", "entries", "block")).alias("parts"))
    single = F.flatten(F.transform("parts", lambda p: F.transform(F.arrays_zip(p["turned"].alias("turned"), p["entries"].alias("entries")), lambda x: F.struct(x["turned"].alias("turned"), x["entries"].alias("entry_id"), p["block"].alias("block")))))
    own = own.select("file_id", "times", F.slice(F.sort_array(single), 1, CANDIDATES).alias("top"))
    numbered = F.transform("top", lambda x, k: F.struct((k + 1).alias("n"), x["entry_id"].alias("entry_id"), (-x["turned"]).alias("score"), x["block"].alias("block")))
    # a null id is no id; one that lies in several blocks has a row for each block among its best
    rows = own.withColumn("top", F.when(F.col("file_id").isNotNull() & (F.size("top") > 0), numbered)).withColumn("of", F.explode_outer(F.array_distinct(F.transform("top", lambda x: x["block"]))))
    here = rows.withColumn("here", F.filter("top", lambda x: x["block"] == F.col("of")))
    place = lambda n, c: F.get(F.filter("here", lambda x: x["n"] == n), F.lit(0))[c]
    found = here.withColumns({"best": place(1, "entry_id"), "score": place(1, "score"), "next": place(2, "score")})
    sure = (F.col("score") >= THRESHOLD) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= MARGIN))
    candidates = F.transform("here", lambda x: F.struct(x["n"].alias("n"), x["entry_id"].alias("entry_id"), F.round(x["score"], 6).alias("score")))
    told = found.select("file_id", F.when(sure, F.col("best")).alias("entry_id"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("confidence"), candidates.alias("candidates"), "times")
    return told.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


#: What a row does: shuts (4), opens (2), adds codes (1). An entry's state: closed (2), has codes (1).
REASONS = [None, "has codes", "closed"]


def _step(kind: int, state: int) -> tuple[int, int]:
    """(state after a row, number of the reason it is rejected for)."""
    shuts, opens, adds, shut, coded = kind & 4, kind & 2, kind & 1, state & 2, state & 1
    if shuts and coded:
        return state, 1
    if adds and shut and not opens:
        return state, 2
    return (2 if shuts or (shut and not opens) else 0) | (1 if coded or adds else 0), 0


STEPS = [[_step(kind, state) for state in range(4)] for kind in range(8)]


def _judged_rows(rows: DataFrame, state: DataFrame, closed: str) -> DataFrame:
    """(entry_id, row_number, kind, state) by ranges of entry and row number, in order; the last is the entry's state before."""
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    known = state.select("entry_id", (flag(F.col("closed"), 2) + flag(F.col("coded"), 1)).alias("state"))
    kind = flag(F.col("axis2") == closed, 4) + flag(F.col("axis2") != closed, 2) + flag(F.size("codes") > 0, 1)
    seeded = rows.join(known, "entry_id", "left").select("entry_id", "row_number", kind.alias("kind"), F.coalesce("state", F.lit(0)).alias("state"))
    return settle(seeded.repartitionByRange("entry_id", "row_number").sortWithinPartitions("entry_id", "row_number"))


def _composed(ordered: DataFrame) -> DataFrame:
    """(part, entry_id, state, maps, edge): of each entry in each partition the state after its rows there, for every state
    before, two bits each; ``edge`` entries may go on in another partition."""
    start = sum(k << 2 * k for k in range(4))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, entry, was, maps = TaskContext.get().partitionId(), True, None, 0, None

        def row(edge: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([entry], kind_of_entry), pa.array([was], pa.int32()), pa.array([maps], pa.int32()), pa.array([edge])], names=["part", "entry_id", "state", "maps", "edge"])

        for batch in batches:
            kind_of_entry, done = batch[0].type, []
            for e, kind, state in zip(*(batch[k].to_pylist() for k in (0, 2, 3)), strict=True):
                if maps is None or e != entry:
                    if maps is not None:
                        done.append(row(first))
                        first = False
                    entry, was, maps = e, state, start
                maps = sum(STEPS[kind][maps >> 2 * k & 3][0] << 2 * k for k in range(4))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if maps is not None:
            yield row(True)

    kind = {f.name: f.dataType.simpleString() for f in ordered.schema}["entry_id"]
    return ordered.mapInArrow(compose, f"part int, entry_id {kind}, state int, maps int, edge boolean")


def fold_axes(rows: DataFrame, state: DataFrame, closed: str = "Masterfile") -> DataFrame:
    """(entry_id, row_number, accepted, reason): tag rows (entry_id, row_number, axis2, codes) judged in order.

    A row that sets axis 2 to ``closed`` is rejected while the entry has codes; a row that adds codes is rejected while
    the entry is closed, unless it opens it itself. ``state`` (entry_id, closed, coded) is what is known before.

    Two flags make four states and a row maps each to one, so rows compose: an entry's rows lie in ranges of row
    numbers, each range gives its composed map, and each is judged from the state that the maps before it lead to. An entry of any
    number of rows is many tasks. The driver gets two maps a partition.
    """
    ordered = _judged_rows(rows, state, closed)
    edges: dict[int, list] = {}
    for r in _composed(ordered).where("edge").toLocalIterator():
        edges.setdefault(r.part, []).append((r.entry_id, r.maps))
    same, last = sum(k << 2 * k for k in range(4)), None
    carried: dict[int, int] = {}
    for part in sorted(edges):
        own = edges[part]
        before = last[1] if last and last[0] == own[0][0] else same
        carried[part] = before
        through = sum((own[0][1] >> 2 * (before >> 2 * k & 3) & 3) << 2 * k for k in range(4))
        last = (own[0][0], through) if len(own) == 1 else own[-1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, entry, now = True, None, 0
        maps = carried.get(TaskContext.get().partitionId(), same)
        for batch in batches:
            reasons = []
            for e, kind, was in zip(*(batch[k].to_pylist() for k in (0, 2, 3)), strict=True):
                if first or e != entry:
                    entry, now = e, maps >> 2 * was & 3 if first else was
                    first = False
                now, reason = STEPS[kind][now]
                reasons.append(REASONS[reason])
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())], names=["entry_id", "row_number", "accepted", "reason"])

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInArrow(judge, f"entry_id {kinds['entry_id']}, row_number {kinds['row_number']}, accepted boolean, reason string")


def folded_state(rows: DataFrame, state: DataFrame, closed: str = "Masterfile") -> DataFrame:
    """(entry_id, closed, coded) after the rows, for the next batch; entries without rows stay as they were."""
    maps = _composed(_judged_rows(rows, state, closed)).groupBy("entry_id", "state").agg(F.array_sort(F.collect_list(F.struct("part", "maps"))).alias("m"))
    after = maps.select("entry_id", F.expr("aggregate(m, state, (s, x) -> shiftright(x.maps, 2 * s) & 3)").alias("s"))
    new = after.select("entry_id", (F.col("s") >= 2).alias("closed"), (F.col("s") % 2 == 1).alias("coded"))
    return new.unionByName(state.select("entry_id", F.coalesce("closed", F.lit(False)).alias("closed"), F.coalesce("coded", F.lit(False)).alias("coded")).join(new.select("entry_id"), "entry_id", "left_anti"))


def first_error(df: DataFrame, checks: Sequence[tuple[str, Column, str]], row_number: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): checks (field, is wrong, message) are tried in order, and a row is rejected with the first
    that holds. Rejects: row_number, field, message, raw_value."""
    tests = F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(said).alias("message"), F.col(name).cast("string").alias("raw_value"))) for name, wrong, said in checks])
    judged = df.withColumn("__error", F.get(F.array_compact(tests), F.lit(0)))
    return judged.where("__error IS NULL").drop("__error"), judged.where("__error IS NOT NULL").select(row_number, "__error.*")


def unparsed(raw: str, parsed: Column) -> Column:
    """A value was given but didn't parse."""
    return F.col(raw).isNotNull() & (F.trim(F.col(raw)) != "") & parsed.isNull()
