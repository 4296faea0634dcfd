"""Hashes of words and word runs of a whole Arrow batch at once, with numpy over the UTF-8 bytes.

Words are runs of bytes that aren't separators. A word's hash is a polynomial over its bytes modulo the prime 2**61 - 1, taken
from prefix sums and then mixed; runs of words are hashed from the words' hashes in the same way. In a field two
different runs of n values meet for at most n of its 2**61 bases, so no text collides for every base, as some do modulo
a power of two. For a base that is known, texts can be built that do; results that rest on equal hashes alone take
``drawn`` bases, which a run draws for itself. Words of ``LONG_WORD`` bytes or more are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE, RUN = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Known(dict):
    """A memory of one process: it is pickled empty, so that tasks aren't sent it."""

    def __reduce__(self):
        return Known, ()


_powers = Known()
KEPT = 4  # bases whose powers a process keeps
PRIME, LOW31, LOW30, LOW29, LOW32 = (np.uint64((1 << k) - 1) for k in (61, 31, 30, 29, 32))
LONG_WORD = 1 << 20
SMALL, SMALL_RUN = 1 << 10, 1 << 21  # with powers' halves of 32 bits, sums stay under 2**63


def drawn() -> tuple[np.uint64, np.uint64]:
    """Two bases at random, for words and for runs. All tasks of one job must be given the same ones."""
    word, run = (np.uint64((1 << 32) + secrets.randbelow(int(PRIME) - (1 << 33))) for _ in range(2))
    return word, run


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves."""
    au, ad, bu, bd = a >> np.uint64(31), a & LOW31, b >> np.uint64(31), b & LOW31
    mid = ad * bu + au * bd
    return reduced(((au * bu) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & LOW30) << np.uint64(31)) + ad * bd)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo the prime for k below n (at least)."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        size, prime = max(n, CHUNK + 4096), int(PRIME)
        both = []
        for b in (int(base) % prime, pow(int(base) % prime, -1, prime)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, times(out, np.uint64(pow(b, len(out), prime)))])
            both.append(out[:size])
        while len(_powers) >= KEPT and int(base) not in _powers:
            _powers.pop(next(iter(_powers)))
        known = _powers[int(base)] = (both[0], both[1])
    return known


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each pair. Prefix sums are of halves, whose differences fit in 64 bits
    up to 2**32 values a run."""
    up, down = powers(base, len(values) + 1)
    up, parts = up[: len(values)], []
    if values.max(initial=0) < SMALL and (ends - starts).max(initial=0) < SMALL_RUN:  # bytes: their products fit as they are
        halves = (values * (up >> np.uint64(32)), values * (up & LOW32))
    else:
        terms = times(reduced(values), up)
        halves = (terms >> np.uint64(32), terms & LOW32)
    for half in halves:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(half, out=sums[1:])
        parts.append(sums[ends] - sums[starts])
    high = reduced(parts[0])  # times 2**32: what passes bit 61 comes in again at bit 0
    total = reduced((high >> np.uint64(29)) + ((high & LOW29) << np.uint64(32)) + reduced(parts[1]))
    return mix(times(total, down[starts]))


class Words:
    """Words of the documents of one chunk: ``hash``, and ``first[d] : first[d + 1]`` are document d's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = SAME, separators: np.ndarray = WHITE, bases: tuple[np.uint64, np.uint64] = (BASE, RUN)):
        inside = ~separators[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        at = edges[edges < len(data)]
        begins[at] = inside[at]
        back = edges[edges > 0] - 1
        stops[back] = inside[back]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.hash = runs((fold[data] if fold is not SAME else data).astype(np.uint64) + np.uint64(1), self.starts, self.ends, bases[0])
        for k in np.flatnonzero(self.ends - self.starts >= LONG_WORD):
            word = (fold[data[self.starts[k] : self.ends[k]]]).tobytes()
            self.hash[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest())
        self.first = np.searchsorted(self.starts, offsets)
        self.data, self.offsets, self.bases = data, offsets, bases

    def part(self, start: int, stop: int) -> Words:
        """The words start:stop as those of one document."""
        out = Words.__new__(Words)
        out.hash, out.first, out.bases = self.hash[start:stop], np.array([0, stop - start]), self.bases
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def gram_starts(self, n: int) -> np.ndarray:
        """Indexes of the words at which n words of one document begin."""
        last = np.repeat(self.first[1:], np.diff(self.first)) - n
        return np.flatnonzero(np.arange(len(self.hash)) <= last)

    def gram_hash(self, starts: np.ndarray, n: int) -> np.ndarray:
        return runs(self.hash, starts, starts + n, self.bases[1])


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
