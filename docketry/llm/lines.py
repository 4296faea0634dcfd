"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence per connected group.

A line is normalised to its words of letters and digits, A-Z in lower case, joined by a blank. Lines of equal normal
form are one line from the start. A line's features are its distinct words and the joints between them (three characters
on either side), of which one edit changes two or three; normal forms of at most ``SHORT`` code points also have character
3-grams. Lines meet under blocks of their 64-bit SimHashes (pigeonhole: no pair within ``NEAR`` bits is missed there)
and, since few edits change more bits than that, under ``BANDS`` keys of ``TAKEN`` least features each, for either kind
of features. Those that meet and whose SimHashes differ in at most ``BITS`` bits are candidates, and link where the edit
distance of the normal forms is at most a fifth of the longer one. What part of such pairs is found: README. Of each group of linked lines the first occurrence (by id, nulls last, then text digest and line number) stays.

As copies come in thousands, each line is first verified against one near leader it shares a key with, then, in large keys, against
its nearest line of another component; all pairs are then sought between different components alone, in blocks of large keys. There the lines' wide SimHashes (``WIDE`` words of
64 bits) decide too: 64 bits alone can't tell lines that share half their features from lines that share four fifths, and
the former, lines around one passage, come in pairs by the square.

Edge cases: lines without letters and digits are never duplicates and stay; null texts have no lines and stay null;
rows that repeat id and text are one document and get the same result; an empty table gives no rows; a document whose
lines all go is left with an empty text (``deduplicated`` can drop it); other columns are kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import block_tasks, components, cut, discard, groups, kind_of, mark, returned
from docketry.llm.word_hash import BASE, LOWER, RUN, Words, chunks, mix, runs

BITS, SIMILARITY = 22, 0.8
FEW, FEWER_BITS = 24, 4  # longer lines have more features, so their SimHashes vary less: that many bits fewer
NEAR, BLOCKS, BANDS, TAKEN, SHORT = 1, 2, 10, 3, 100
SIG, LONG_WORD, LONG_JOINT = 12 + 4 * BANDS, 6, 10
LENGTHS = 80  # percent: an edit similarity is at most the shorter form's code points over the longer's
ODD = [int(x) | 1 for x in np.random.default_rng(29).integers(1 << 62, 1 << 63, TAKEN * BANDS)]
WIDE, WIDE_BITS, WIDE_BITS_FEW = 4, 68, 88  # of 256: a share s of equal features differs in acos(s) / pi of the bits on average
SEEDS = [np.uint64(int(x)) for x in np.random.default_rng(31).integers(1, 1 << 63, WIDE)]
WIDE_COLUMNS = [f"w{k}" for k in range(2 * WIDE)]  # by words and joints, then by 3-grams
BLOCK_ROWS, LARGE_CELL, PAIRS, LINES_SENT = 1024, 32, 65_536, 2_000_000
WORDS_TOGETHER, FEW_TOGETHER, TOGETHER, TOGETHER_BYTES = 8, 32, 4096, 4 << 20  # of edit distances: words of 64 code points, and pairs, that go together
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of lines, first line of each document). A line's bytes end with its newline, if it has one."""
    after = np.flatnonzero(data == 10) + 1
    inner = np.setdiff1d(np.union1d(offsets[:-1], after), [len(data)]) if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, inner, "right") - 1
    # a text that ends with a newline has an empty last line
    closed = (np.diff(offsets) > 0) & (data[np.maximum(offsets[1:] - 1, 0)] == 10) if len(data) else np.zeros(len(offsets) - 1, bool)
    ends_open = offsets[1:][closed]
    starts = np.concatenate([inner, ends_open])
    docs = np.concatenate([doc, np.flatnonzero(closed)])
    order = np.lexsort((starts, docs))
    first = np.searchsorted(docs[order], np.arange(len(offsets)))
    return np.append(starts[order], len(data)), first


def line_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, value, is telling: no short word) of each line's distinct words and joints (the last three characters of a word and the first three
    of the next). One edit changes two of them, or three."""
    data, (starts, ends) = LOWER[words.data].astype(np.uint64) + np.uint64(1), (words.starts, words.ends)
    tail, head = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(3):
        far = ends - starts > k
        tail[far] = tail[far] << np.uint64(9) | data[ends[far] - 1 - k]
        head[far] = head[far] << np.uint64(9) | data[starts[far] + k]
    pairs, doc = words.gram_starts(2), words.doc_of()
    joints = mix((tail[pairs] << np.uint64(32) | head[pairs]) ^ np.uint64(0x7015))
    long = ends - starts
    return distinct(np.concatenate([doc, doc[pairs]]), np.concatenate([mix(words.hash), joints]), np.append(long >= LONG_WORD, long[pairs] + long[pairs + 1] >= LONG_JOINT))


def short_features(words: Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, value) of the distinct character 3-grams of the normal forms of ``wanted`` lines, with a blank at both ends."""
    a, b = words.first[:-1][wanted], words.first[1:][wanted]
    at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
    size = words.ends[at] - words.starts[at] + 1
    begin = np.cumsum(size) - size
    form = np.append(LOWER[np.append(words.data, np.uint8(32))[np.repeat(words.starts[at] - begin, size) + np.arange(size.sum())]], [32, 32]).astype(np.uint64)
    form[begin + size - 1] = 32
    line = np.repeat(np.repeat(wanted, b - a), size)
    n = len(line)
    before = np.append(np.uint64(32), form)[:n]  # every line ends with a blank, so the next one's first gram has it in front
    inner = np.append(line[1:] == line[:-1], False) if n else np.zeros(0, bool)
    value = before << np.uint64(16) | form[:n] << np.uint64(8) | form[1 : n + 1]
    return distinct(line[inner], mix(value[inner] ^ np.uint64(0x35 << 32)), np.ones(inner.sum(), bool))


def distinct(line: np.ndarray, value: np.ndarray, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by line. 39 bits of a value count, so that a row is one number to sort; they are mixed anew."""
    value = value >> np.uint64(25) << np.uint64(1) | telling.astype(np.uint64)
    if len(line) and line.max() >= 1 << 24:
        order = np.lexsort((value, line))
        line, value = line[order], value[order]
        new = np.append(True, (line[1:] != line[:-1]) | (value[1:] != value[:-1]))
        return line[new], mix(value[new]), (value[new] & np.uint64(1)) > 0
    both = np.sort(line.astype(np.uint64) << np.uint64(40) | value)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(40)).astype(np.int64), mix(both & np.uint64((1 << 40) - 1)), (both & np.uint64(1)) > 0


def edges_of(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, line[1:] != line[:-1]))


def summed(line: np.ndarray, value: np.ndarray, _: np.ndarray, out: np.ndarray) -> None:
    """Puts the SimHash of each line's features into ``out``: a bit is set where it is in more than half of them."""
    if not len(line):
        return
    edges = edges_of(line)
    size = np.diff(np.append(edges, len(line))).astype(np.uint64)
    lanes = 4 if size.max() < 1 << 16 else 2  # counters in each sum
    width = 64 // lanes
    ones, low = np.uint64(sum(1 << (width * k) for k in range(lanes))), np.uint64((1 << width) - 1)
    found = np.zeros(len(edges), np.uint64)
    for bit in range(width):
        counts = np.add.reduceat((value >> np.uint64(bit)) & ones, edges)
        for k in range(lanes):
            found |= (((counts >> np.uint64(width * k)) & low) * np.uint64(2) > size).astype(np.uint64) << np.uint64(bit + width * k)
    out[line[edges]] = found


def minima(line: np.ndarray, value: np.ndarray, telling: np.ndarray, salt: int, lines: int) -> np.ndarray:
    """``BANDS`` keys of each line with features: each a digest of the least telling features under seeded orders."""
    if len(line):
        kept = telling | (np.bincount(line, telling, lines) == 0)[line]  # some lines have short words alone
        line, value = line[kept], value[kept]
    out = np.zeros((lines, BANDS), np.uint64)
    if not len(line):
        return out
    edges, own = edges_of(line), value ^ (value >> np.uint64(29))
    for k in range(BANDS):
        key = np.full(len(edges), salt * BANDS + k, np.uint64)
        for odd in ODD[TAKEN * k : TAKEN * (k + 1)]:
            key = mix(key + np.minimum.reduceat(own * np.uint64(odd), edges))
        out[line[edges], k] = key
    return out


def form_lengths(words: Words) -> np.ndarray:
    """Code points of each line's normal form."""
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    total = np.concatenate([[0], np.cumsum(points[words.ends] - points[words.starts] + 1)])
    return np.maximum(total[words.first[1:]] - total[words.first[:-1]] - 1, 0)


def length_codes(length: np.ndarray) -> np.ndarray:
    """Bits to flip by a line's length: two more for each quarter that it is longer, so lines of one size differ in few
    and lines of very different sizes in most. After 64 flips bits are flipped back in turn."""
    steps = np.floor(np.log(np.maximum(length, 1)) / np.log(1.25) * 2).astype(np.uint64) % np.uint64(128)
    low = lambda n: np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))
    return np.where(steps <= 64, low(steps), ~low(np.maximum(steps, np.uint64(64)) - np.uint64(64)))


def signatures(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(SimHash by words and joints, SimHash by 3-grams, band keys by either) of each line; lines over ``SHORT`` have
    no 3-grams and 0 there. Lines of four fifths of that up to it have both."""
    lines, length = len(words.first) - 1, form_lengths(words)
    sims, shorts = np.zeros(lines, np.uint64), np.zeros(lines, np.uint64)
    own, grams = line_features(words), short_features(words, np.flatnonzero((length > 0) & (length <= SHORT)))
    summed(*own, sims)
    sims ^= length_codes(length)
    summed(*grams, shorts)
    return sims, shorts, minima(*own, 1, lines), minima(*grams, 2, lines)


def wide_signatures(words: Words, wanted: np.ndarray) -> np.ndarray:
    """Wide SimHashes of the ``wanted`` lines (distinct, ascending): ``WIDE`` columns by words and joints, 0 in lines whose partners all have
    3-grams, and as many by 3-grams, 0 in lines over ``SHORT``."""
    out = np.zeros((len(words.first) - 1, 2 * WIDE), np.uint64)
    length = form_lengths(words)
    some, worded = np.zeros(len(out), bool), 100 * length > LENGTHS * SHORT
    some[wanted] = True
    for kind, (line, value, telling) in enumerate((line_features(words), short_features(words, np.flatnonzero(some & (length > 0) & (length <= SHORT))))):
        kept = some[line] & worded[line] if kind == 0 else some[line]
        line, value = line[kept], value[kept]
        for k, seed in enumerate(SEEDS):
            summed(line, mix(value ^ seed), telling, out[:, kind * WIDE + k])
    return out[wanted]


def wide_near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether wide SimHashes (rows of ``a`` and ``b``) are near by 3-grams where both lines have them, or by words and joints where both have those."""
    longer, shorter = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    most = np.where(longer <= FEW, WIDE_BITS_FEW, WIDE_BITS)
    apart = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int32)
    return ((100 * shorter.astype(np.int64) > LENGTHS * SHORT) & (apart[:, :WIDE].sum(axis=1) <= most)) | ((longer <= SHORT) & (apart[:, WIDE:].sum(axis=1) <= most))


def packed(words: Words, kept: np.ndarray) -> pa.Array:
    """Signatures of the ``kept`` lines as bytes: SimHash, length and bands by words, and for short lines those by 3-grams."""
    sims, shorts, bands, short_bands = signatures(words)
    length = form_lengths(words)[kept]
    brief = length <= SHORT
    rows = np.zeros((len(kept), 2, SIG), np.uint8)
    for k, (sim, keys) in enumerate(((sims, bands), (shorts, short_bands))):
        rows[:, k, :8] = sim[kept, None].view(np.uint8)
        rows[:, k, 8:12] = length[:, None].astype(np.int32).view(np.uint8)
        rows[:, k, 12:] = (keys[kept] >> np.uint64(32)).astype(np.uint32).view(np.uint8).reshape(len(kept), -1)
    use = np.stack([np.ones(len(kept), bool), brief], axis=1)
    ends = np.concatenate([[0], np.cumsum(np.where(brief, 2 * SIG, SIG))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(ends), pa.py_buffer(rows[use].tobytes())])


def keyed_rows(masks: list[int]):
    """mapInArrow function over (id, sig): rows (key, id, sim, size), one for each choice of blocks (odd keys) and for each
    band (even keys)."""
    masks = np.array(masks, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch[0].to_numpy()
            brief = pc.binary_length(batch[1]).to_numpy() > SIG
            data = np.frombuffer(b"".join(batch[1].to_pylist()), np.uint8).reshape(-1, SIG)
            second = np.zeros(len(data), bool)
            second[np.cumsum(brief + 1)[brief] - 1] = True
            ids = np.repeat(own, brief + 1)
            sim = np.ascontiguousarray(data[:, :8]).view(np.uint64)[:, 0]
            size = np.ascontiguousarray(data[:, 8:12]).view(np.int32)[:, 0]
            bands = np.ascontiguousarray(data[:, 12:]).view(np.uint32).astype(np.uint64)
            salt = (np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(BANDS) * second[:, None].astype(np.uint64)) << np.uint64(32)
            at = np.flatnonzero(~second)
            blocks = mix((sim[at][:, None] & masks[None, :]) ^ mix(np.arange(len(masks), dtype=np.uint64) + np.uint64(1))[None, :]) | np.uint64(1)
            banded = mix(bands | salt) & ~np.uint64(1)
            key = np.concatenate([blocks.ravel(), banded.ravel()])
            who, sims, sizes = (np.concatenate([np.repeat(x[at], len(masks)), np.repeat(x, BANDS)]) for x in (ids, sim, size))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who), pa.array(sims.view(np.int64)), pa.array(sizes)], names=["key", "id", "sim", "size"])

    return run


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lengths are near enough for the edit similarity."""
    return 100 * np.minimum(a, b).astype(np.int64) >= LENGTHS * np.maximum(a, b)


def reach(key: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Bits in which SimHashes may differ: ``NEAR`` where blocks of them are the key, which agree in lines of no likeness
    too; else ``bits``, and fewer for lines of more than ``FEW`` code points."""
    return np.where(key & 1, min(NEAR, bits), np.where(size <= FEW, bits, max(bits - FEWER_BITS, 0)))


def simhashes(words: Words) -> np.ndarray:
    """SimHash of each line: by 3-grams for short lines, else by words and joints."""
    sims, shorts, _, _ = signatures(words)
    return np.where(form_lengths(words) <= SHORT, shorts, sims)


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, mark, n_lines and for its lines with words the arrays line, hi, lo (of the normal form), sig (``packed``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[2]):
                many = len(offsets) - 1
                bounds, first = line_offsets(data, offsets)
                words = Words(data, bounds, LOWER, MARKS)
                a, b = words.first[:-1], words.first[1:]
                kept = np.flatnonzero(b > a)
                doc = np.searchsorted(first, kept, "right") - 1
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=many))]).astype(np.int32)
                hashes = [runs(words.hash, a[kept], b[kept], base).view(np.int64) for base in (RUN, BASE)]
                lists = [(kept - first[doc]).astype(np.int32), *hashes, packed(words, kept)]
                yield pa.RecordBatch.from_arrays(
                    [batch[0].slice(row, many), batch[1].slice(row, many), pa.array(np.diff(first)), *(pa.ListArray.from_arrays(pa.array(ends), x if isinstance(x, pa.Array) else pa.array(x)) for x in lists)],
                    names=["doc_id", "mark", "n_lines", "line", "hi", "lo", "sig"],
                )

    return docs.select("doc_id", mark(F.col("text")).alias("mark"), "text").mapInArrow(returned(run), f"doc_id {kind_of(docs, 'doc_id')}, mark bigint, n_lines bigint, line array<int>, hi array<bigint>, lo array<bigint>, sig array<binary>")


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - bits`` blocks, as signed 64-bit numbers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), blocks - bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def shared_keys(bits: int):
    """mapInArrow function over rows (key, id, sim, size) sorted by key and id: those of keys with several ids, with the
    key's first id as ``leader`` and the bits by which they differ from it. One row is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "sim", "size", "leader", "apart"]
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, own, sim, size_of = (batch[k].to_numpy() for k in range(4))
            if held is not None:  # the open run's leader goes in front; whether it was given out is known
                key, own, sim, size_of = (np.append(x, y) for x, y in zip(held[:4], (key, own, sim, size_of), strict=True))
            first = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, len(key)))
            lead = np.repeat(begin, size)
            keep = np.repeat(size > 1, size)
            given = held is not None and held[4]
            if given:
                keep[0] = False
            two = np.flatnonzero((size[:-1] == 2) & ((np.arange(len(begin) - 1) > 0) | (held is None)))  # done with: two lines, which aren't near
            x, y = begin[two], begin[two] + 1
            far = (np.bitwise_count((sim[x] ^ sim[y]).view(np.uint64)) > reach(key[x], size_of[x], bits)) | ~alike(size_of[x], size_of[y])
            keep[x[far]] = keep[y[far]] = False
            rows = np.flatnonzero(keep)
            apart = np.bitwise_count((sim[rows] ^ sim[lead[rows]]).view(np.uint64)).astype(np.int32)
            apart[(apart > reach(key[rows], size_of[rows], bits)) | ~alike(size_of[rows], size_of[lead[rows]])] = 65
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(own[rows]), pa.array(sim[rows]), pa.array(size_of[rows]), pa.array(own[lead[rows]]), pa.array(apart)], names=names)
            k = begin[-1]
            held = (key[k], own[k], sim[k], size_of[k], bool(size[-1] > 1) or (given and k == 0))

    return run


def nearest(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of pairs that are the least apart of either of their rows."""
    kept = []
    for own in (x, y):
        order = np.lexsort((apart, own))
        kept.append(order[np.append(True, own[order][1:] != own[order][:-1])] if len(order) else order)
    return np.unique(np.concatenate(kept))


def near_pairs(bits: int, first: bool = False):
    """mapInArrow function over rows (key, i, j, block, id, comp, sim, size, wide columns) sorted by the first three: pairs of
    different components whose SimHashes are near, the wide ones too. With ``first`` each row's nearest alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def made() -> pa.RecordBatch:
            a, b = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(2))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for columns in groups(batches, 3):
            block, own, comp, sim, size = (c.to_numpy() for c in columns[3:8])
            i, j = columns[1][0].as_py(), columns[2][0].as_py()
            left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(len(own)),) * 2
            near = (np.bitwise_count((sim[left][:, None] ^ sim[right][None, :]).view(np.uint64)) <= reach(np.int64(columns[0][0].as_py()), size[left][:, None], bits)) & (comp[left][:, None] != comp[right][None, :]) & alike(size[left][:, None], size[right][None, :])
            x, y = np.nonzero(near)
            x, y = left[x], right[y]
            wide = np.stack([c.to_numpy() for c in columns[8:]], axis=1)
            close = np.concatenate([wide_near(wide[x[k : k + PAIRS]], wide[y[k : k + PAIRS]], size[x[k : k + PAIRS]], size[y[k : k + PAIRS]]) for k in range(0, max(len(x), 1), PAIRS)])
            x, y = x[close], y[close]
            if first and len(x):
                apart = np.concatenate([np.bitwise_count((wide[x[k : k + PAIRS]] ^ wide[y[k : k + PAIRS]]).view(np.uint64)).sum(axis=1, dtype=np.int32) for k in range(0, len(x), PAIRS)])
                chosen = nearest(x, y, apart)
                x, y = x[chosen], y[chosen]
            if len(x):
                held.append((own[x], own[y]))
                many += len(x)
            if many > 500_000:
                yield made()
                held.clear()
                many = 0
        yield made()

    return run


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, form: normal form, wide SimHashes) of the lines in ``wanted`` (id, place struct<unknown, doc_id, mark, line>)."""
    at = cut(wanted.groupBy(F.col("place.doc_id").alias("d"), F.col("place.mark").alias("m")).agg(F.collect_list(F.struct("place.line", "id")).alias("lines")))
    sent = (at.agg(F.sum(F.size("lines"))).first()[0] or 0) <= LINES_SENT
    named = docs.select("doc_id", mark(F.col("text")).alias("mark"), "text")
    both = named.join(F.broadcast(at) if sent else at.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[0]):
                many = len(offsets) - 1
                bounds, first = line_offsets(data, offsets)
                words, low = Words(data, bounds, LOWER, MARKS), LOWER[data].tobytes()
                lists = batch[1].slice(row, many)
                parts = lists.flatten()
                line = parts.field(0).to_numpy() + first[np.repeat(np.arange(many), lists.value_lengths().to_numpy())]
                starts, ends = words.starts.tolist(), words.ends.tolist()
                texts = [b" ".join([low[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)]) for a, b in zip(words.first[line].tolist(), words.first[line + 1].tolist(), strict=True)]
                wanted, where = np.unique(line, return_inverse=True)
                wide = wide_signatures(words, wanted)[where].view(np.int64)
                yield pa.RecordBatch.from_arrays([parts.field(1), pa.array(texts, pa.binary()).cast(pa.string()), *(pa.array(np.ascontiguousarray(w)) for w in wide.T)], names=["id", "form", *WIDE_COLUMNS])

    return both.select("text", "lines").mapInArrow(returned(run), f"id bigint, form string, {', '.join(f'{w} bigint' for w in WIDE_COLUMNS)}").dropDuplicates(["id"])


def common_length(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or some number over ``most``. All cells of a column are bits of one number, so long lines take
    one pass, and pairs that differ in too much end early (Spark's own function takes four times as long on such pairs)."""
    k = common_length(a, b)
    a, b = a[k:], b[k:]
    k = common_length(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = whole, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = masks.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up), up & across
        score += bool(more & top) - bool(less & top)
        if score - left > most:
            return most + 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(level | more)) & whole, more & level & whole
    return score


def within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``. As in ``edit_distance`` cells of a column are bits, here of words
    of 64, and all pairs whose shorter text has as many words go through the columns together; where they are few, or have more than ``WORDS_TOGETHER`` words, alone."""
    near, sides, left = np.zeros(len(pairs), bool), [], []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most[k]:
            continue
        same = common_length(a, b)
        a, b = a[same:], b[same:]
        same = common_length(a[::-1], b[::-1])
        a, b = a[: len(a) - same], b[: len(b) - same]
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if max(len(a), len(b)) <= most[k]:
            near[k] = True
        elif a and len(a) <= 64 * WORDS_TOGETHER:
            sides.append((a, b))
            left.append(k)
        elif a:
            near[k] = edit_distance(a, b, int(most[k])) <= most[k]
    if left:
        at = np.array(left)
        m, n = (np.array([len(x[side]) for x in sides]) for side in (0, 1))
        order = np.lexsort((-n, (m + 63) // 64))
        words = (m[order] + 63) // 64
        cuts = [0, *(np.flatnonzero(words[1:] != words[:-1]) + 1).tolist(), len(order)]
        for first, last in zip(cuts, cuts[1:], strict=False):
            step = max(TOGETHER // int(words[first]), 1)
            for k in range(first, last, step):
                rows = order[k : min(k + step, last)]
                if len(rows) < FEW_TOGETHER * words[first]:
                    near[at[rows]] = [edit_distance(*sides[r], int(most[at[r]])) <= most[at[r]] for r in rows]
                    continue
                near[at[rows]] = columns_passed([sides[r][0] for r in rows], [sides[r][1] for r in rows], m[rows], n[rows], most[at[rows]])
    return near


def coded(texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points one after another, where each text begins)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size


def columns_passed(a: list[str], b: list[str], m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether edit distances of pairs (of falling ``n``) are at most ``most``; all of ``a`` have as many words of 64."""
    (x, x_at), (y, y_at), words, one = coded(a, m), coded(b, n), (int(m[0]) + 63) // 64, np.uint64(1)
    others = np.unique(np.concatenate([x[x > 127], y[y > 127]]))
    x, y = (np.where(z > 127, 128 + np.searchsorted(others, z), z).astype(np.int64) for z in (x, y))
    kinds = 128 + len(others)
    masks = np.zeros((words, len(a) * kinds), np.uint64)
    for p in range(int(m.max())):
        own = np.flatnonzero(m > p)
        masks[p >> 6, own * kinds + x[x_at[own] + p]] |= one << np.uint64(p & 63)
    up, down = np.full((words, len(a)), ~np.uint64(0)), np.zeros((words, len(a)), np.uint64)
    score, top, near, rows = m.copy(), ((m - 1) & 63).astype(np.uint64), np.zeros(len(a), bool), np.arange(len(a))
    n_at, limit = n.copy(), most
    for j in range(int(n[0])):
        ended = np.searchsorted(-n_at, -j)  # texts from here on have no more than j code points
        if ended < len(rows):
            near[rows[ended:]] = score[ended:] <= limit[ended:]
        if ended < len(rows) or j & 7 == 7:  # those that can't come back to the limit leave
            kept = np.flatnonzero(score[:ended] - (n_at[:ended] - j) <= limit[:ended])
            if ended < len(rows) or len(kept) < 0.9 * len(rows):
                rows, score, top, n_at, limit, up, down = rows[kept], score[kept], top[kept], n_at[kept], limit[kept], up[:, kept], down[:, kept]
            if not len(rows):
                return near
        own = rows * kinds + y[y_at[rows] + j]
        plus, minus = one, np.uint64(0)  # the first row's cells grow by one a column
        for w in range(words):
            same, v, d = masks[w][own], up[w], down[w]
            level = same | d
            same = same | minus
            across = (((same & v) + v) ^ v) | same
            more, less = d | ~(across | v), v & across
            last = top if w == words - 1 else np.uint64(63)
            next_plus, next_minus = (more >> last) & one, (less >> last) & one
            more, less = more << one | plus, less << one | minus
            up[w], down[w] = less | ~(level | more), more & level
            plus, minus = next_plus, next_minus
        score += plus.astype(np.int64) - minus.astype(np.int64)
    near[rows] = score <= limit
    return near


def verified(forms: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose normal forms (id, form) are similar enough."""
    both = pairs.join(forms.select(F.col("id").alias("a"), F.col("form").alias("x")), "a").join(forms.select(F.col("id").alias("b"), F.col("form").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.concat_batches(held)
            pairs = list(zip(whole[2].to_pylist(), whole[3].to_pylist(), strict=True))
            most = ((1 - similarity) * np.array([max(len(x), len(y)) for x, y in pairs]) + 1e-9).astype(np.int64)
            return pa.RecordBatch.from_arrays(whole.columns[:2], names=["a", "b"]).filter(pa.array(within(pairs, most), pa.bool_()))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(h.num_rows for h in held) >= TOGETHER or sum(h.nbytes for h in held) >= TOGETHER_BYTES:
                yield judged(held)
                held.clear()
        if held:
            yield judged(held)

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def removed_lines(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, mark, lines): numbers of the lines of a document that repeat an earlier occurrence."""
    if 100 * similarity < LENGTHS:
        raise ValueError(f"lines are sought by lengths that hold for a similarity of {LENGTHS} percent or more")
    rows = cut(scanned(docs))
    signed = rows.select("doc_id", "mark", F.explode(F.arrays_zip("line", "hi", "lo", "sig")).alias("l")).select("doc_id", "mark", "l.*")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark", "line")
    told = cut(signed.groupBy("hi", "lo").agg(F.min(place).alias("place"), F.first("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()))
    lines = cut(signed.drop("sig"))  # what comes later is without signatures, which take most of both tables
    discard(rows)
    keyed = told.select("id", "sig").mapInArrow(returned(keyed_rows(block_masks(min(NEAR, bits), blocks))), "key bigint, id bigint, sim bigint, size int")
    cells = cut(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(returned(shared_keys(bits)), "key bigint, id bigint, sim bigint, size int, leader bigint, apart int"))
    known = cut(told.drop("sig"))
    discard(told)
    likely = cells.where((F.col("apart") <= bits) & (F.col("id") != F.col("leader"))).groupBy("id").agg(F.min_by("leader", "apart").alias("leader"))
    forms = cut(line_texts(docs, known.join(cells.select("id").distinct(), "id").select("id", "place")))
    links = cut(verified(forms, likely.select(F.col("leader").alias("a"), F.col("id").alias("b")), similarity))
    wide = forms.select("id", *WIDE_COLUMNS)

    def between(comps: DataFrame, first: bool) -> DataFrame:
        """Near pairs of different components in each cell; ``first``: those of large cells, and each line's nearest alone."""
        placed = cells.select("key", "id", "sim", "size").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        tasks = block_tasks(placed, BLOCK_ROWS, "sim", "size", wide=wide, over=LARGE_CELL if first else 0)
        return cut(tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(returned(near_pairs(bits, first)), "a bigint, b bigint").distinct())

    # a large group's lines become one component by their nearest, so that its pairs, the square of its size, are not made
    links = links.unionByName(cut(verified(forms, between(components(links), True), similarity)))
    more = between(components(links), False)
    discard(cells)
    joined = components(links.unionByName(verified(forms, more, similarity)))
    classed = known.join(joined, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    first = classed.groupBy("comp").agg(F.min("place").alias("stays"))
    stays = classed.join(first, "comp").select("hi", "lo", "stays")
    gone = lines.join(stays, ["hi", "lo"]).where(~((F.col("mark") == F.col("stays.mark")) & (F.col("line") == F.col("stays.line")) & F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))))
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("lines"))


def _with_removed(docs: DataFrame, bits: int, blocks: int, similarity: float) -> DataFrame:
    """``docs`` with ``__lines``, the numbers of the lines to remove or null."""
    gone = cut(removed_lines(docs, bits, blocks, similarity).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("lines").alias("__lines")))
    sent = (gone.agg(F.sum(F.size("__lines"))).first()[0] or 0) <= LINES_SENT
    named = docs.withColumn("__mark", mark(F.col("text")))
    both = named.join(F.broadcast(gone) if sent else gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__m")), "left")
    return both.drop("__mark", "__d", "__m")


def _kept(text: str, gone: set[int]) -> str:
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def line_digests(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256 (lines kept, joined by newlines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums = [], [], []
            for text, gone in zip(batch[1], batch[2], strict=True):
                text, gone = text.as_py() or "", set(gone.as_py() or ())
                total.append(text.count("\n") + 1 if text else 0)
                removed.append(len(gone))
                sums.append(hashlib.sha256(_kept(text, gone).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    both = _with_removed(docs, bits, blocks, similarity).select("doc_id", "text", "__lines")
    return both.mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, n_lines bigint, n_removed bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, drop_emptied: bool = False, bits: int = BITS, blocks: int = BLOCKS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines that stay; documents that lose all their words can be dropped."""
    both = _with_removed(docs, bits, blocks, similarity)

    touched = F.col("__lines").isNotNull()
    stay = F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains("__lines", k))
    out = both.withColumn("text", F.when(touched, F.array_join(stay, "\n")).otherwise(F.col("text")))
    if drop_emptied:
        out = out.where(~touched | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return out.select(*docs.columns)
