"""Quality rules by suffix-array repetition.

The words of some documents at a time are sorted as suffixes (prefix doubling with numpy, only suffixes that still share
their beginning are sorted again). Longest common prefixes of neighbours in that order give, for every word, the
longest stretch from there on that occurs elsewhere in its own text: the deepest interval of common prefixes that its
suffix lies in. Stretches that another one holds whole aren't maximal and go; the rest are the text's maximal repeats.
Their spans are united, and a text is refused if they cover too large a share of it, or if one repeat alone is too large.
Words are compared as numbers that a dictionary of each text hands out, never by hash.

Edge cases: null and empty texts have no words and aren't kept; a text of any length is read in pieces of ``PIECE`` bytes and
held as 8 bytes a word, some more for each doubling; rows that repeat are judged one by one; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import kind_of
from docketry.llm.word_hash import WHITE, chunks

#: Shortest repeat that counts (words); largest share of words that repeats may cover; largest share, and least number of
#: words, of one repeat that is too long.
REPEAT, COVERED, LONGEST, LONGEST_WORDS = 10, 0.3, 0.25, 50
#: The base rules: least number of words, window, largest percentage of words in repeated windows.
WORDS, WINDOW, PERCENT = 50, 3, 50
PIECE = 1 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def numbered(raw: bytes) -> np.ndarray:
    """The words of a text as numbers from 0 on, equal for equal words."""
    known: dict[bytes, int] = {}
    if len(raw) <= PIECE:
        return np.fromiter((known.setdefault(w, len(known)) for w in raw.split()), np.int64)
    cuts = np.flatnonzero(WHITE[np.frombuffer(raw, np.uint8)])
    edges = [0, *(int(cuts[k]) for k in np.unique(np.searchsorted(cuts, np.arange(PIECE, len(raw), PIECE))) if k < len(cuts)), len(raw)]
    return np.concatenate([np.fromiter((known.setdefault(w, len(known)) for w in raw[a:b].split()), np.int64) for a, b in zip(edges, edges[1:], strict=False)])


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks by the first 1, 2, 4, ... numbers). Every text must end with a number that no other place has."""
    order = np.argsort(ids, kind="stable")
    levels, n = [], len(ids)
    slots, values = np.arange(n), ids[order]
    rank = np.empty(n, np.int64)
    while True:
        at = order[slots]
        new = np.ones(len(slots), bool)
        new[1:] = values[1:] != values[:-1]
        heads = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] if len(slots) else slots
        rank[at] = heads
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        if not len(slots):
            return order, levels
        at, step = order[slots], 1 << (len(levels) - 1)
        values = rank[at] * (n + 1) + rank[at + step]  # a suffix that shares its beginning reaches at most its text's end
        moved = np.argsort(values, kind="stable")
        order[slots], values = at[moved], values[moved]


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of what each suffix shares with the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[pairs - 1].copy(), order[pairs].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        a += same
        b += same
    out[pairs] = b - order[pairs]
    return out


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each place the length of the longest stretch from there on that occurs at another place too."""
    order, levels = suffix_array(ids)
    shared = common_prefixes(order, levels)
    out = np.empty(len(ids), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], 0))
    return out


def maximal(repeats: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of maximal repeats' occurrences: at least so long, and not the rest of one that starts a word earlier."""
    inner = np.zeros(len(repeats), bool)
    inner[1:] = repeats[:-1] > repeats[1:]
    starts = np.flatnonzero((repeats >= least) & ~inner)
    return starts, repeats[starts]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    open_ = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(open_[:n]) > 0


class Limits(NamedTuple):
    repeat: int = REPEAT
    covered: float = COVERED
    longest: float = LONGEST
    longest_words: int = LONGEST_WORDS


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats")


def counts(data: np.ndarray, offsets: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The counts of each text of one chunk."""
    texts, raw = len(offsets) - 1, data.tobytes()
    per_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    out = {"word_chars": per_text(((data & 0xC0) != 0x80) & ~WHITE[data]), "n_symbols": per_text(SYMBOL[data])}
    parts, again, base = [], np.zeros(texts, np.int64), 0
    for k in range(texts):
        own = raw[offsets[k] : offsets[k + 1]]
        full = [line for line in own.split(b"\n") if not line.isspace() and line]
        again[k] = len(full) - len(set(full))
        ids = numbered(own)
        parts.append(np.append(ids, ids.max(initial=-1) + 1) + base)
        base = int(parts[-1][-1]) + 1
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n = len(ids)
    repeats = longest_repeats(ids)
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[first])
    windows = np.flatnonzero(repeats >= WINDOW)
    starts, lengths = maximal(repeats, least)
    out |= {
        "n_words": np.diff(first) - 1,
        "n_dup_lines": again,
        "n_repeat_words": sums(covered(windows, np.full(len(windows), WINDOW), n)),
        "n_covered": sums(covered(starts, lengths, n)),
        "longest_repeat": np.maximum.reduceat(repeats, first[:-1]) if texts else again,
        "n_repeats": sums(np.bincount(starts, minlength=n)),
    }
    return out


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the counts, base_failed, kept of every row. ``n_covered`` words lie in maximal repeats of at least
    ``limits.repeat`` words, ``n_repeats`` such stretches start in the text, and ``longest_repeat`` is in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(data, offsets, limits.repeat) for _, data, offsets in chunks(batch[1], PIECE)]
            c = {name: np.concatenate([f[name] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for name in COUNTS}
            n = c["n_words"]
            failed = (n < WORDS) | (100 * c["n_repeat_words"] > PERCENT * n)
            long = (c["longest_repeat"] >= limits.longest_words) & (c["longest_repeat"] > limits.longest * n)
            kept = ~failed & (c["n_covered"] <= np.round(limits.covered * n, 6)) & ~long
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(c[name]) for name in COUNTS), pa.array(failed), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    schema = f"doc_id {kind_of(docs, 'doc_id')}, " + ", ".join(f"{name} bigint" for name in COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# Windows are numbered by doubling (each number tells a stretch of 1, 2, 4, ... words of one text), so counts are exact. Covered words
# are those of windows of REPEAT words that come twice; a repeat is too long where a window of that many words does.
ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts),
sized AS (SELECT *, len(ws) AS n, greatest(50, len(ws) // 4 + 1) AS most FROM words),
g1 AS (SELECT *, dense_rank() OVER (ORDER BY r, w) AS g1 FROM (SELECT r, n, most, unnest(ws) AS w, unnest(range(1, n + 1)) AS i FROM sized)),
g2 AS (SELECT *, dense_rank() OVER (ORDER BY g1, x) AS g2 FROM (SELECT *, lead(g1) OVER (PARTITION BY r ORDER BY i) AS x FROM g1)),
g4 AS (SELECT * EXCLUDE (x), dense_rank() OVER (ORDER BY g2, x) AS g4 FROM (SELECT * EXCLUDE (x), lead(g2, 2) OVER (PARTITION BY r ORDER BY i) AS x FROM g2)),
g8 AS (SELECT * EXCLUDE (x), dense_rank() OVER (ORDER BY g4, x) AS g8 FROM (SELECT *, lead(g4, 4) OVER (PARTITION BY r ORDER BY i) AS x FROM g4)),
g16 AS (SELECT * EXCLUDE (x), dense_rank() OVER (ORDER BY g8, x) AS g16 FROM (SELECT *, lead(g8, 8) OVER (PARTITION BY r ORDER BY i) AS x FROM g8)),
g32 AS (SELECT * EXCLUDE (x), dense_rank() OVER (ORDER BY g16, x) AS g32 FROM (SELECT *, lead(g16, 16) OVER (PARTITION BY r ORDER BY i) AS x FROM g16)),
ahead AS (SELECT *, lead(g1, 2) OVER w AS a3, lead(g2, 8) OVER w AS a10, lead(g16, 32) OVER w AS a48, lead(g2, 48) OVER w AS a50 FROM g32 WINDOW w AS (PARTITION BY r ORDER BY i)),
times AS (SELECT r, i, n, most, count(*) OVER (PARTITION BY g2, a3) AS c3, count(*) OVER (PARTITION BY g8, a10) AS c10, count(*) OVER (PARTITION BY g32, a48, a50) AS c50 FROM ahead),
in3 AS (SELECT r, count(*) AS k FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) FROM times WHERE i + 2 <= n AND c3 > 1) GROUP BY r),
in10 AS (SELECT r, count(*) AS k FROM (SELECT DISTINCT r, unnest(range(i, i + 10)) FROM times WHERE i + 9 <= n AND c10 > 1) GROUP BY r),
long AS (SELECT DISTINCT r FROM (SELECT r, count(*) AS c FROM times JOIN sized USING (r) WHERE c50 > 1 AND i + times.most - 1 <= times.n GROUP BY r, ws[i : i + times.most - 1]) WHERE c > 1),
dup AS (SELECT r, sum(c - 1) AS k FROM (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
counted AS (SELECT s.doc_id, s.n AS n_words, length(regexp_replace(s.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(dup.k, 0) AS BIGINT) AS n_dup_lines,
    coalesce(in3.k, 0) AS n_repeat_words, coalesce(in10.k, 0) AS n_covered, long.r IS NOT NULL AS too_long
  FROM sized s LEFT JOIN in3 USING (r) LEFT JOIN in10 USING (r) LEFT JOIN long USING (r) LEFT JOIN dup USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_covered <= 3 * n_words AND NOT too_long AS kept, n_covered
FROM counted"""
