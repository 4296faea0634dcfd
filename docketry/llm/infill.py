"""Fill-in-the-middle: texts cut in three at unit boundaries and put together in another order.

The tokenizers library's Split pre-tokenizer (nothing is trained) isolates the units ``[A-Za-z]+|[^A-Za-z]`` and gives each one's
code-point offsets. How many offsets there are is the text's number of units; the offsets at two ranks, drawn from a hash
of the id, cut prefix, middle and suffix. Texts go through the library in pieces of about ``PIECE`` code points that end behind a
code point that is no letter, where a unit always ends; so a text of any length needs little memory, and only the
pieces that a rank falls in are looked at again.

Edge cases: null counts as empty; empty texts and texts that hold a marker stay plain; a null id draws as the text
``null``; rows that repeat get the same output; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import kind_of

UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: texts that are transformed, and those of them that take the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PIECE = 512
NO_LETTER = re.compile("[^A-Za-z]")


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``PIECE`` code points, none of which cuts a unit."""
    start = 0
    while start < len(text):
        found = NO_LETTER.search(text, start + PIECE)
        end = found.end() if found else len(text)
        yield start, end
        start = end


class Units:
    """Number of units of one text, and the code point at which the unit of some rank starts."""

    def __init__(self, text: str, split):
        self.text, self.split, self.n = text, split, 0
        self.known: list[tuple[int, int, int]] = []  # first rank, bounds
        for start, end in pieces(text):
            self.last = split.pre_tokenize_str(text[start:end])
            self.known.append((self.n, start, end))
            self.n += len(self.last)

    def offset(self, rank: int) -> int:
        if rank == self.n:
            return len(self.text)
        low, high = 0, len(self.known) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.known[mid][0] <= rank else (low, mid - 1)
        first, start, end = self.known[low]
        offsets = self.last if low == len(self.known) - 1 else self.split.pre_tokenize_str(self.text[start:end])
        return start + offsets[rank - first][1][0]


def infill(docs: DataFrame) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(UNITS), "isolated")
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for key, value in zip(batch[0], batch[1], strict=True):
                text = value.as_py() or ""
                units, doc_id = Units(text, split), key.as_py()
                draw = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(draw[k : k + 8], 16) for k in (0, 8, 16, 24))
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= TRANSFORMED:
                    made = (units.n, "plain", None, None, text)
                else:
                    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
                    a, b = units.offset(a), units.offset(b)
                    first = h4 % 100 < SUFFIX_FIRST
                    before, after = f"{PREFIX}{text[:a]}", f"{SUFFIX}{text[b:]}"
                    made = (units.n, "spm" if first else "psm", a, b - a, f"{after}{before}{MIDDLE}{text[a:b]}" if first else f"{before}{after}{MIDDLE}{text[a:b]}")
                for column, value in zip(rows, made, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"doc_id {kind_of(docs, 'doc_id')}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. A marker can't begin within a part, so each is where it first stands."""
    body = F.substring(output, F.lit(4), F.length(output))
    part = lambda text, mark: F.substring_index(text, mark, 1)
    rest = lambda text, mark: F.substring(text, F.length(part(text, mark)) + 4, F.length(text))
    one = F.when(form == "psm", part(body, SUFFIX)).otherwise(part(body, PREFIX))
    tail = F.when(form == "psm", rest(body, SUFFIX)).otherwise(rest(body, PREFIX))
    two, middle = part(tail, MIDDLE), rest(tail, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def output_digests(docs: DataFrame) -> DataFrame:
    """The outputs' digests, and those of the texts rebuilt from them."""
    made = infill(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
formed AS (SELECT *, len(units) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
ranked AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM formed),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 : n], '') AS suffix FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
