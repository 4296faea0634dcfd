"""Benchmark decontamination with DataFrame functions alone.

Texts are lower-cased over A-Z only and cut into words; a window is ``WINDOW`` consecutive words, and an item
with fewer words (but not none) is one window. Window hashes of the benchmark go out as a broadcast hash set when
their words take up to ``broadcast_bytes`` (summed first; beyond it Spark joins them by shuffle). Each hit is
verified word by word before it counts. Contaminated documents go, or hit words alone (``without_hits``).

Edge cases: null and empty texts have no words and no hits; null ids of documents keep their rows; null item texts
are no items; items that share a window all count; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GIVEN_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.coalesce(lower, F.lit("")), SEPARATORS), lambda w: w != "")


def _window_hashes(tokens: Column, length: int) -> Column:
    """Array of (pos, h) over every window of ``length`` words."""
    starts = F.when(F.size(tokens) >= length, F.sequence(F.lit(0), F.size(tokens) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(tokens, i + k) for k in range(length)]).alias("h")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window of an item: length, h, item_id, tokens."""
    items = benchmark.select("item_id", words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    length = F.least(F.lit(window), F.size("tokens"))
    starts = F.sequence(F.lit(1), F.size("tokens") - length + 1)
    cut = items.select("item_id", length.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("tokens", i, length))).alias("tokens"))
    cases = F.lit(None).cast("long")
    for n in range(1, window + 1):
        cases = F.when(F.col("length") == n, F.xxhash64(*[F.get("tokens", F.lit(k)) for k in range(n)])).otherwise(cases)
    return cut.select("length", cases.alias("h"), "item_id", "tokens").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (positions of hit words)."""
    grams = benchmark_windows(benchmark, window)
    stats = grams.agg(F.collect_set("length").alias("lengths"), F.coalesce(F.sum(F.length(F.array_join("tokens", " ")) + 64), F.lit(0)).alias("size")).first()
    keys = grams.groupBy("length", "h").agg(F.collect_set(F.struct("item_id", "tokens")).alias("items"))
    if stats["size"] <= broadcast_bytes:
        keys = F.broadcast(keys)
    mark = F.md5(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("doc_id", "text", mark.alias("mark"))
    cut = texts.select("doc_id", "mark", words(F.col("text")).alias("tokens"))
    scanned = None
    for n in sorted(stats["lengths"]) or [window]:
        at = cut.select("doc_id", "mark", F.explode(_window_hashes(F.col("tokens"), n)).alias("w"))
        at = at.select("doc_id", "mark", F.lit(n).alias("length"), "w.pos", "w.h")
        scanned = at if scanned is None else scanned.unionByName(at)
    found = scanned.join(keys, ["length", "h"]).groupBy(F.col("doc_id").alias("hit_doc"), F.col("mark").alias("hit_mark"))
    found = found.agg(F.collect_set(F.struct("pos", "length", "items")).alias("found"))
    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("mark") == F.col("hit_mark")), "left")
    held = joined.select("doc_id", words(F.col("text")).alias("tokens"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
    real = F.filter(
        F.transform(
            "found",
            lambda f: F.struct(
                f["pos"].alias("pos"),
                f["length"].alias("length"),
                F.filter(f["items"], lambda i: i["tokens"] == F.slice("tokens", f["pos"] + 1, f["length"]))["item_id"].alias("items"),
            ),
        ),
        lambda f: F.size(f["items"]) > 0,
    )
    sure = held.select("doc_id", F.size("tokens").cast("long").alias("n_words"), real.alias("real"))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("real", lambda f: F.sequence(f["pos"], f["pos"] + f["length"] - 1)))))
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.col("real")["items"])), lambda i: i.cast("string")))
    out = sure.select("doc_id", "n_words", hits.alias("hits"), items.alias("items"))
    n_hit = F.size("hits").cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "hits",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents; ties of id are settled by text."""
    named = docs.withColumn("__mark", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    bad = contamination_marks(docs, benchmark, window)
    same = F.col("doc_id").eqNullSafe(F.col("__bad_doc")) & (F.col("__mark") == F.col("__bad_mark"))
    return named.join(bad, same, "left_anti").drop("__mark")


def contamination_marks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, text digest) of contaminated documents."""
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mark")).alias("doc_id"), "text")
    bad = contamination(keyed, benchmark, window).where("contaminated")
    return bad.select(F.col("doc_id.id").alias("__bad_doc"), F.col("doc_id.mark").alias("__bad_mark")).distinct()


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut out of every text; what stood between words stays."""
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mark")).alias("doc_id"), "text")
    found = contamination(keyed, benchmark, window).where("n_hit > 0").select(F.col("doc_id.id").alias("__bad_doc"), F.col("doc_id.mark").alias("__bad_mark"), F.col("hits").alias("__hits")).dropDuplicates(["__bad_doc", "__bad_mark"])
    named = docs.withColumn("__mark", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    both = named.join(found, F.col("doc_id").eqNullSafe(F.col("__bad_doc")) & (F.col("__mark") == F.col("__bad_mark")), "left")
    pieces = F.regexp_extract_all("text", F.lit(GIVEN_SEPARATORS.replace("[", "([^") + "|" + GIVEN_SEPARATORS + ")"), 1)
    begin = F.when(F.regexp_extract("text", f"^{GIVEN_SEPARATORS}", 0) == "", 0).otherwise(1)
    is_hit = lambda k: ((k - begin) % 2 == 0) & (k >= begin) & F.array_contains("__hits", F.floor((k - begin) / 2).cast("int"))
    kept = F.array_join(F.filter(pieces, lambda _, k: ~is_hit(k)), "")
    return both.withColumn("text", F.when(F.col("__hits").isNotNull(), kept).otherwise(F.col("text"))).select(*docs.columns)


ORACLE = r"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(13, len(t)) AS n, array_to_string(t[i : i + least(13, len(t)) - 1], ' ') AS g
          FROM (SELECT item_id, t, unnest(range(1, len(t) - least(13, len(t)) + 2)) AS i FROM items WHERE len(t) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
spots AS (SELECT r, n, i, array_to_string(t[i : i + n - 1], ' ') AS g
          FROM (SELECT r, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM lowered, sizes WHERE len(t) >= n)),
found AS (SELECT s.r, s.i, s.n, b.item_id FROM spots s JOIN grams b ON s.n = b.n AND s.g = b.g),
hit AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS w FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY r)
SELECT l.doc_id, CAST(len(l.t) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(l.t) AS contaminated
FROM lowered l LEFT JOIN hit h USING (r) LEFT JOIN named m USING (r)
"""
