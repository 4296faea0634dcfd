"""N-gram Jaccard self-join of whole documents with count-vector R-trees.

A document's set holds its distinct ``n``-word shingles. Sets are put in one order, rare words first (word counts of
the whole corpus in a fixed table), so that a similar pair must share one of its first keys (prefix filter): the rows
of a key are a cell. Of keys with the same documents the first stays, as it is the first that any of their pairs share.

Shingles are hashed into groups (about as many as the set has members, 64 to 4096), and a set's group counts are a
point. In the cell of the first key that a pair shares, nothing before that key is common, so the points there count
what follows alone. An R-tree over a cell's points bounds every overlap by the sum of coordinate minima, against boxes
first and points then (cells of up to ``LEAF`` sets are a single leaf); what survives is verified on whole sets.

Work that copies would cause is avoided first: each set is compared with one leader among those it shares cells with,
and verified links are joined into components. Then the R-trees look for pairs of different components alone, and skip
subtrees that are all of one. A cell with more than ``DENSE`` survivors a set gives each set's likeliest partner, and
is looked through once more when those links are joined. So a family of near copies costs its size where links hold it
together, and no link between components is lost. Large cells are cut into blocks, and pairs of blocks become tasks.

Edge cases: null texts and texts without words have empty sets and link with nothing (their component is their own
id); with fewer than ``n`` words the whole sequence is the one shingle; equal sets are linked at once; rows that
repeat an id each get a row; null ids are passed over when the smallest id is taken; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import block_tasks, components, cut, kind_of, mark, small
from docketry.llm.word_hash import BASE, LOWER, RUN, Words, chunks, drawn, mix

SHINGLE, PERCENT = 4, 85
LEAF, BLOCK, DENSE = 48, 1024, 4
NARROW, WIDE, MOST = 6, 12, 15  # groups as powers of two, and what a count of four bits holds
SKETCH_BITS, LEVELS = 16, 63
PAIRS = 1 << 17  # compared at once


def word_counts(docs: DataFrame, bases: tuple = (BASE, RUN)) -> np.ndarray:
    """How often words of each of ``2**SKETCH_BITS`` hash classes occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch[0]):
                counts += np.bincount(Words(data, offsets, LOWER, bases=bases).hash >> np.uint64(64 - SKETCH_BITS), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["at", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    found = docs.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[found["at"]] = found["n"]
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, common: np.ndarray, n: int, bases: tuple = (BASE, RUN)) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of each distinct shingle, by document and then by the global order of shingles. A
    shingle's upper bits are its level, which grows with how common its words are."""
    words = Words(data, offsets, LOWER, bases=bases)
    doc = words.doc_of()
    starts = words.gram_starts(n)
    level = np.concatenate([[0], np.cumsum(common[words.hash >> np.uint64(64 - SKETCH_BITS)])])
    docs, hashes, levels = [doc[starts]], [words.gram_hash(starts, n)], [level[starts + n] - level[starts]]
    sizes = np.diff(words.first)
    for k in range(1, n):  # documents of fewer words
        short = words.first[:-1][sizes == k]
        docs.append(doc[short])
        hashes.append(words.gram_hash(short, k))
        levels.append(np.zeros(len(short), np.int64))
    rank = np.minimum(np.concatenate(levels) // 4, LEVELS).astype(np.uint64)
    docs, value = np.concatenate(docs), (rank << np.uint64(58)) | (np.concatenate(hashes) >> np.uint64(6))
    order = np.lexsort((value, docs))
    docs, value = docs[order], value[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (value[1:] != value[:-1])
    return docs[new], value[new]


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def group_bits(size: np.ndarray) -> np.ndarray:
    """Groups of sets of such sizes, as powers of two: about one for each member."""
    return np.clip(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), NARROW, WIDE)


def count_vectors(doc: np.ndarray, value: np.ndarray, size: np.ndarray, rows: int = 1024) -> list[bytes]:
    """For each document the counts of its shingles by hash group, up to ``MOST``, two in a byte."""
    out = [b""] * len(size)
    first = np.concatenate([[0], np.cumsum(size)])
    bits = group_bits(size)
    for a in range(0, len(size), rows):
        b = min(len(size), a + rows)
        own = slice(first[a], first[b])
        for kind in np.unique(bits[a:b][size[a:b] > 0]).tolist():
            groups = 1 << kind
            chosen = np.flatnonzero((bits[a:b] == kind) & (size[a:b] > 0))
            place = np.full(b - a, -1)
            place[chosen] = np.arange(len(chosen))
            at = place[doc[own] - a]
            group = (value[own] & np.uint64(groups - 1)).astype(np.int64)
            counts = np.minimum(np.bincount(at[at >= 0] * groups + group[at >= 0], minlength=len(chosen) * groups), MOST).astype(np.uint8)
            flat, half = (counts[::2] | counts[1::2] << 4).tobytes(), groups // 2
            for k, d in enumerate(chosen.tolist()):
                out[a + d] = flat[k * half : (k + 1) * half]
    return out


def features(docs: DataFrame, common, n: int, percent: int, bases: tuple) -> DataFrame:
    """Per row: doc_id, mark, n, hi, lo (digest of the set), keys (first shingles), heads (their groups), vec (group counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[2]):
                many = len(offsets) - 1
                doc, value = shingle_sets(data, offsets, common.value, n, bases)
                size = np.bincount(doc, minlength=many)
                first = np.concatenate([[0], np.cumsum(size)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)))]) for salt in (0x51ED27, 0xB5297A4D)]
                digests = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                lead = np.arange(len(value)) - first[doc] < prefix_length(size, percent)[doc]
                kept = np.concatenate([[0], np.cumsum(np.bincount(doc[lead], minlength=many))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(kept), pa.array(value[lead].view(np.int64)))
                groups = (value[lead] & np.uint64((1 << WIDE) - 1)).astype(np.uint16)
                heads = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(2 * kept), pa.py_buffer(groups.tobytes())])
                vecs = pa.array(count_vectors(doc, value, size), pa.binary())
                columns = [batch[0].slice(row, many), batch[1].slice(row, many), pa.array(size), *map(pa.array, digests), keys, heads, vecs]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "hi", "lo", "keys", "heads", "vec"])

    return docs.select("doc_id", mark(F.col("text")).alias("mark"), "text").mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, mark bigint, n bigint, hi bigint, lo bigint, keys array<bigint>, heads binary, vec binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, common, n: int, bases: tuple) -> DataFrame:
    """(id, members) of the sets in ``wanted`` (id, doc_id, mark), members being sorted 64-bit shingles."""
    named = docs.select(F.col("doc_id").alias("d"), mark(F.col("text")).alias("m"), "text")
    found = named.join(small(wanted), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[1]):
                many = len(offsets) - 1
                doc, value = shingle_sets(data, offsets, common.value, n, bases)
                first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=many))]) * 8
                members = pa.LargeBinaryArray.from_buffers(pa.large_binary(), many, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(value)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch[0].slice(row, many), members], names=["id", "members"])

    return found.select("id", "text").mapInArrow(run, "id bigint, members binary")


def verified(docs: DataFrame, pairs: DataFrame, known: DataFrame, common, n: int, percent: int, bases: tuple) -> DataFrame:
    """Those ``pairs`` (a, b) whose whole sets are similar enough; only their documents are read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(whole_sets(docs, cut(known.join(wanted, "id").select("id", "doc_id", "mark")), common, n, bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch[2], batch[3], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


class Sets:
    """Rows of cells: ``n`` and ``pos`` (place of the cell's key in the set) of each, its component and its counts."""

    def __init__(self, own, comp, n, pos, heads: pa.Array, vecs: pa.Array, percent: int):
        self.own, self.comp, self.n, self.pos, self.percent = own, comp, n.astype(np.int64), pos.astype(np.int64), percent
        self.heads, self.vecs = heads, vecs
        self.bits = group_bits(self.n)

    def near(self, overlap, total):
        """Whether sets of ``total`` members together, with at most ``overlap`` in common, can be similar."""
        return (100 + self.percent) * overlap >= self.percent * total

    def points(self, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, spill): counts of each row's members from its key on in ``2**bits`` groups, wider points being
        folded, and how many members of the set are in no count, since counts end at ``MOST``."""
        width = 1 << bits
        out, spill = np.zeros((len(rows), width), np.uint8), np.zeros(len(rows), np.int64)
        for kind in np.unique(self.bits[rows]).tolist():
            chosen = np.flatnonzero(self.bits[rows] == kind)
            packed = np.frombuffer(b"".join(self.vecs.take(pa.array(rows[chosen])).to_pylist()), np.uint8).reshape(len(chosen), -1)
            counts = np.empty((len(chosen), 1 << kind), np.uint8)
            counts[:, ::2], counts[:, 1::2] = packed & 15, packed >> 4
            if kind > bits:
                counts = np.minimum(counts.reshape(len(chosen), -1, width).sum(axis=1, dtype=np.int32), MOST).astype(np.uint8)
            spill[chosen] = self.n[rows[chosen]] - counts.sum(axis=1, dtype=np.int64)
            heads = self.heads.take(pa.array(rows[chosen])).to_pylist()
            long = np.array([len(h) // 2 for h in heads])
            at = np.repeat(np.arange(len(chosen)), long) * width + (np.frombuffer(b"".join(heads), np.uint16) & (width - 1))
            before = np.bincount(at, minlength=len(chosen) * width).reshape(len(chosen), width)
            out[chosen] = np.where(counts == MOST, MOST, counts - np.minimum(before, counts))
        return out, spill

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and places of the key leave room for similarity, and the components differ."""
        after = np.minimum(self.n[i] - self.pos[i], self.n[j] - self.pos[j])
        return (self.comp[i] != self.comp[j]) & self.near(after, self.n[i] + self.n[j])

    def compared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rows i, j and the bound in thousandths of both sizes, of the pairs of rows that the points don't tell apart."""
        bits, found = np.minimum(self.bits[i], self.bits[j]), [np.zeros((3, 0), np.int64)]
        for kind in np.unique(bits).tolist():
            chosen = np.flatnonzero(bits == kind)
            rows, at = np.unique(np.concatenate([i[chosen], j[chosen]]), return_inverse=True)
            found.append(self.near_points(rows, *self.points(rows, kind), at[: len(chosen)], at[len(chosen) :]))
        return np.concatenate(found, axis=1)

    def near_points(self, rows, points, spill, x, y) -> np.ndarray:
        found, step = [np.zeros((3, 0), np.int64)], max(1, (1 << 22) // points.shape[1])
        for k in range(0, len(x), step):
            a, b = x[k : k + step], y[k : k + step]
            shared = np.minimum(points[a], points[b]).sum(axis=1, dtype=np.int64) + np.minimum(spill[a], spill[b])
            total = self.n[rows[a]] + self.n[rows[b]]
            ok = self.near(shared, total)
            found.append(np.stack([rows[a][ok], rows[b][ok], (1000 * shared // total)[ok]]))
        return np.concatenate(found, axis=1)


class Tree:
    """R-tree of one cell's rows: a box's upper corner is what bounds need; with its least size, and the one component or None."""

    __slots__ = ("top", "least", "spill", "comp", "at", "parts")

    def __init__(self, at: np.ndarray, sets: Sets, rows: np.ndarray, points: np.ndarray, spill: np.ndarray):
        own = points[at]
        self.at, self.parts, n = at, [], sets.n[rows[at]]
        self.top, self.least, self.spill = own.max(axis=0), int(n.min()), int(spill[at].max())
        comps = sets.comp[rows[at]]
        self.comp = int(comps[0]) if (comps == comps[0]).all() else None
        if len(at) > LEAF and self.comp is None:
            spread = self.top.astype(np.int64) - own.min(axis=0)
            axis = int(spread.argmax())
            order = at[np.argsort(n if n.max() - n.min() > spread[axis] else own[:, axis], kind="stable")]
            self.parts = [Tree(half, sets, rows, points, spill) for half in (order[: len(order) // 2], order[len(order) // 2 :])]


def tree_pairs(sets: Sets, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As ``compared``, for all pairs of ``left`` and ``right`` rows (each pair once if both are the same rows)."""
    same, found = left is right, [np.zeros((3, 0), np.int64)]
    kinds = np.unique(sets.bits[np.concatenate([left, right])]).tolist()
    for wide in kinds:
        for slim in kinds[: kinds.index(wide) + 1]:
            for x, y in {(wide, slim), (slim, wide)} if not same else {(wide, slim)}:
                a, b = left[sets.bits[left] == x], right[sets.bits[right] == y]
                if not len(a) or not len(b):
                    continue
                twin = same and x == y
                rows = a if twin else np.concatenate([a, b])
                points, spill = sets.points(rows, slim)
                whole = Tree(np.arange(len(a)), sets, rows, points, spill)
                todo = [(whole, whole if twin else Tree(np.arange(len(a), len(rows)), sets, rows, points, spill))]
                while todo:
                    u, v = todo.pop()
                    if u.comp is not None and u.comp == v.comp:
                        continue
                    if not sets.near(int(np.minimum(u.top, v.top).sum(dtype=np.int64)) + min(u.spill, v.spill), u.least + v.least):
                        continue
                    if u is v and u.parts:
                        todo += [(u.parts[0], u.parts[0]), (u.parts[1], u.parts[1]), (u.parts[0], u.parts[1])]
                    elif u.parts and (not v.parts or len(u.at) >= len(v.at)):
                        todo += [(p, v) for p in u.parts]
                    elif v.parts:
                        todo += [(u, p) for p in v.parts]
                    else:
                        i, j = np.repeat(u.at, len(v.at)), np.tile(v.at, len(u.at))
                        ok = sets.likely(rows[i], rows[j]) & ((i < j) if u is v else True)
                        for k in range(0, len(i), PAIRS):
                            part = np.flatnonzero(ok[k : k + PAIRS]) + k
                            found.append(sets.near_points(rows, points, spill, i[part], j[part]))
    return np.concatenate(found, axis=1)


def leaf_pairs(sets: Sets, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """As ``compared``, for all pairs within each cell begin : begin + size."""
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # each row meets those of its cell before it
    row = np.repeat(begin, size) + place
    found, ends = [np.zeros((3, 0), np.int64)], np.cumsum(place)
    edges = np.unique(np.append(np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS), "left") + 1, 0)) if len(ends) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        many = place[a:b]
        j = np.repeat(row[a:b], many)
        i = j - np.repeat(many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ok = sets.likely(i, j)
        found.append(sets.compared(i[ok], j[ok]))
    return np.concatenate(found, axis=1)


def likeliest(found: np.ndarray) -> np.ndarray:
    """Of pairs with bounds the likeliest of each row."""
    keep = np.zeros(found.shape[1], bool)
    for side in (0, 1):
        order = np.lexsort((-found[2], found[side]))
        own = found[side][order]
        keep[order[np.append(True, own[1:] != own[:-1])[: len(own)]]] = True
    return found[:, keep]


def cell_pairs(percent: int, dense: int | None):
    """mapInArrow function over rows (key, i, j, block, id, comp, n, pos, heads, vec) sorted by the first three: pairs
    (a, b) to verify, and the keys of cells with over ``dense`` of them a set, which give the likeliest alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, pairs, many, opened = None, [], 0, set()

        def made() -> pa.RecordBatch:
            both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), axis=1)
            keys = np.array(sorted(opened), np.int64)
            dense_key = np.arange(both.shape[1] + len(keys)) >= both.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(np.append(both[0], keys)), pa.array(np.append(both[1], keys)), pa.array(dense_key)], names=["a", "b", "open"])

        def solve(whole: pa.RecordBatch, begin: np.ndarray, size: np.ndarray) -> None:
            nonlocal many
            key, i, j, block, own, comp, n, pos = (c.to_numpy() for c in whole.columns[:8])
            sets = Sets(own, comp, n, pos, whole[8], whole[9], percent)
            small = size <= LEAF
            out = [leaf_pairs(sets, begin[small], size[small])]
            for a, k in zip(begin[~small].tolist(), size[~small].tolist(), strict=True):
                rows = np.arange(a, a + k)
                out.append(tree_pairs(sets, rows, rows) if i[a] == j[a] else tree_pairs(sets, rows[block[rows] == i[a]], rows[block[rows] == j[a]]))
            found = np.concatenate(out, axis=1)
            if dense is not None:
                cell = np.searchsorted(begin, found[0], "right") - 1
                over = np.bincount(cell, minlength=len(begin)) > dense * size
                opened.update(key[begin[over]].tolist())
                full = over[cell]
                found = np.concatenate([found[:, ~full], likeliest(found[:, full])], axis=1)
            x, y = own[found[0]], own[found[1]]
            pairs.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))
            many += pairs[-1].shape[1]

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.concat_batches([rest, batch]) if rest is not None else batch
            keys = [whole[k].to_numpy() for k in range(3)]
            new = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
            if len(new):
                solve(whole, np.append(0, new[:-1]), np.diff(np.append(0, new)))
            rest = whole.slice(new[-1] if len(new) else 0)
            if many > 500_000:
                yield made()
                pairs, many, opened = [], 0, set()
        if rest is not None:
            solve(rest, np.zeros(1, np.int64), np.array([rest.num_rows]))
        yield made()

    return run


def first_of_equal(cells: DataFrame) -> DataFrame:
    """``cells`` without those whose documents all meet under an earlier key already (keys are ordered unsigned)."""
    flip = F.lit(-(1 << 63))
    lists = cells.groupBy("key").agg(F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y"), F.count("*").alias("rows"))
    first = lists.groupBy("x", "y", "rows").agg(F.min(F.col("key").bitwiseXOR(flip)).alias("k"))
    return cells.join(first.select(F.col("k").bitwiseXOR(flip).alias("key")), "key", "left_semi")


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, mark, n_shingles, component_id (the smallest doc_id of those connected by links)."""
    bases = drawn()
    counts = word_counts(docs, bases)
    quarters = np.rint(4 * np.log2(np.maximum(counts / max(counts.mean(), 1), 1)))
    common = docs.sparkSession.sparkContext.broadcast(quarters.astype(np.int64))
    feats = cut(features(docs, common, n, percent, bases))
    full = feats.where("n > 0").withColumn("row", F.xxhash64("doc_id", "mark"))
    sets = cut(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")).withColumn("id", F.monotonically_increasing_id()))
    named = sets.select("id", F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("row").alias("r"))
    met = full.join(named, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("row") == F.col("r")))
    reps = cut(met.dropDuplicates(["hi", "lo", "row"]).select("id", "doc_id", "mark", F.col("n").cast("int").alias("n"), "keys", "heads", "vec"))

    shared = cut(reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    cells = cut(reps.select("id", "n", F.posexplode("keys").alias("pos", "key")).join(shared, "key").select("key", "id", "n", "pos"))
    wanted = cut(reps.join(cells.select("id").distinct(), "id").select("id", "doc_id", "mark", "heads", "vec"))

    first = cut(cells.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("leader")))
    near = cells.join(first, "key").where("id != leader").groupBy("id", "leader").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    likely = near.where(200 * F.col("shared") >= (100 - percent) * F.col("n")).groupBy("id").agg(F.max_by("leader", "shared").alias("leader"))
    links = cut(verified(docs, cut(likely.select(F.col("id").alias("a"), F.col("leader").alias("b"))), wanted, common, n, percent, bases))
    comps = components(links)

    few = cut(first_of_equal(cells))
    for dense in (DENSE, None):
        placed = few.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        points = wanted.select("id", "heads", "vec")
        tasks = block_tasks(placed, BLOCK, "n", "pos").join(points, "id").select("key", "i", "j", "block", "id", "comp", "n", "pos", F.expr("substring(heads, 1, 2 * pos)").alias("heads"), "vec")
        found = cut(tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(cell_pairs(percent, dense), "a bigint, b bigint, open boolean").distinct())
        links = links.unionByName(cut(verified(docs, found.where("NOT open").select("a", "b"), wanted, common, n, percent, bases)))
        comps = components(links)
        opened = found.where("open").select(F.col("a").alias("key"))
        if dense is None or opened.isEmpty():
            break
        few = few.join(opened, "key", "left_semi")

    grouped = sets.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = grouped.join(least, "comp").select("hi", "lo", "component_id")
    out = feats.join(of_set, ["hi", "lo"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the row of the smallest id, of several such the smallest mark.
    Documents without words all stay. Rows that repeat id and text are one document and stay or go as one row."""
    found = jaccard_components(docs, n, percent)
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "mark")).alias("k"))
    named = docs.withColumn("__mark", mark(F.col("text"))).dropDuplicates(["doc_id", "__mark"])
    empty = found.where("n_shingles = 0").select("doc_id", "mark")
    stay = first.select("k.doc_id", "k.mark").unionByName(empty).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m")).distinct()
    return named.join(stay, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__m")), "left_semi").select(*docs.columns)


#: DuckDB SQL for ``op9_ngram_join``; equal sets are compared once.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, hash(array_to_string(w[k:k + 3], ' ')) AS h FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 3, 1))) AS k) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n, md5(string_agg(h::VARCHAR, ',' ORDER BY h)) AS s FROM shingles GROUP BY r),
sets AS (SELECT s, min(r) AS r, any_value(n) AS n FROM sizes GROUP BY s),
members AS (SELECT r, n, h FROM sets JOIN shingles USING (r)),
pairs AS (SELECT a.r AS a, b.r AS b FROM members a JOIN members b ON a.h = b.h AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT r, r FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
of_set AS (SELECT reach.a AS r, min(words.doc_id) AS least FROM reach JOIN sets ON reach.b = sets.r JOIN sizes USING (s) JOIN words ON words.r = sizes.r GROUP BY reach.a)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, CASE WHEN sizes.n IS NULL THEN doc_id ELSE least END AS component_id
FROM words LEFT JOIN sizes USING (r) LEFT JOIN sets USING (s) LEFT JOIN of_set ON of_set.r = sets.r
"""
