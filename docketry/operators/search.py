"""Full-text, token and vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.staging import settle

STOP_WORDS = ["the", "of", "and", "a", "an", "in", "on", "to", "for", "or"]  # fixed values


def tokens(text: str | Column) -> Column:
    """Distinct words of letters and digits, in lower case."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def term_index(df: DataFrame, key: str, text: str, prefixes: Sequence[str] = ()) -> DataFrame:
    """(token, key, tf): how often each record holds each token, of those that begin with one of ``prefixes`` if given.
    Others go before anything is exploded."""
    begins = lambda t: reduce(lambda a, b: a | b, [F.startswith(t, F.lit(p)) for p in prefixes], F.lit(not prefixes))
    words = F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & begins(t)))
    return df.select(key, words.alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def query_terms(query: str) -> list[str]:
    """Terms of a query: quotes go, blanks part terms. A query without terms asks nothing."""
    return query.replace('"', " ").lower().split()


def prefix_search(df: DataFrame, key: str, text: str, query: str, k: int = 50) -> DataFrame:
    """(key, score): records in which every term is the beginning of a word, by the sum of matched words' weights
    (tf * ln(1 + N / df), rounded). No terms give no rows."""
    terms = query_terms(query)
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    index = term_index(df, key, text, terms)
    which = F.explode(F.filter(F.array(*[F.when(F.startswith("token", F.lit(t)), t) for t in terms]), lambda t: t.isNotNull()))
    hits = settle(index.select("token", key, "tf", which.alias("term")))
    seen = hits.groupBy("token").agg(F.countDistinct(key).alias("df"))
    total = F.broadcast(df.agg(F.count("*").alias("n_all")))
    weighed = hits.join(seen, "token").crossJoin(total).withColumn("w", F.col("tf") * F.log(1 + F.col("n_all") / F.col("df")))
    scored = weighed.groupBy(key).agg(F.countDistinct("term").alias("terms"), F.round(F.sum("w"), 6).alias("score")).where(F.col("terms") == len(set(terms)))
    return scored.select(key, "score").orderBy(F.desc("score"), key).limit(k)


def token_search(df: DataFrame, key: str, text: str, query: str, k: int = 50) -> DataFrame:
    """(key, score): number of query words of three letters or more (no stop words) that the text contains."""
    words = [w for w in (t.strip("\"'(),.") for t in query.lower().split()) if len(w) >= 3 and w not in STOP_WORDS]
    if not words:
        return df.select(key, F.lit(0).alias("score")).limit(0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])
    return df.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def top_across(scopes: Sequence[DataFrame], k: int) -> DataFrame:
    """Best ``k`` of several ranked scopes (record_type, id, score): each gives its best ``k``; ties by scope and id."""
    parts = [s.orderBy(F.desc_nulls_last("score"), "id").limit(k).withColumn("scope", F.lit(n)) for n, s in enumerate(scopes)]
    all_parts = reduce(DataFrame.unionByName, parts)
    return all_parts.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "scope", "id").limit(k)


QUERY_ROWS, VECTOR_ROWS, AT_ONCE = 1024, 4096, 128  # vectors in a block, and queries that a product takes
BATCH_BYTES = 4 << 20  # of blocks that Python gets at once; Spark reads it when a job runs


def blocks(df: DataFrame, key: str, vector: str, rows: int, name: str) -> DataFrame:
    """(name_ids, name_vectors): arrays of about ``rows`` rows each."""
    many = max(1, -(-df.count() // rows))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(many)).alias("__b")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("r")).select(F.col("r.id").alias(f"{name}_ids"), F.col("r.v").alias(f"{name}_vectors"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query, key, score, position): the ``k`` nearest by cosine of every query, exactly; ties by key. Blocks of queries
    meet blocks of vectors, each pair in a task as one matrix product that keeps the best ``k`` of its vectors for each
    query; those are all that is shuffled. A task holds about ``BATCH_BYTES`` of blocks and one product of ``AT_ONCE`` queries. Vectors without length score null, which comes last."""
    k = min(50, max(1, k))
    pairs = blocks(vectors, key, vector, VECTOR_ROWS, "v").crossJoin(blocks(queries, key, vector, QUERY_ROWS, "q"))
    kind = vectors.schema[key].dataType.simpleString()
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def ranked(own: np.ndarray, ids: np.ndarray, asked: np.ndarray, names: np.ndarray) -> pd.DataFrame:
        length = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(own, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(length > 0, asked @ own.T / length, np.nan)
        score = np.round(score, 6)
        order = np.lexsort(np.broadcast_arrays(ids[None, :], -np.nan_to_num(score, nan=-2.0)), axis=1)[:, :k]
        at = np.repeat(np.arange(len(asked)), order.shape[1])
        found = score[at, order.ravel()]
        return pd.DataFrame({"query": names[at], key: ids[order.ravel()], "score": pd.array(found, dtype="Float64")})

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                own, asked, ids, names = np.stack(row.v_vectors), np.stack(row.q_vectors), np.asarray(row.v_ids), np.asarray(row.q_ids)
                for n in range(0, len(asked), AT_ONCE):
                    yield ranked(own, ids, asked[n : n + AT_ONCE], names[n : n + AT_ONCE])

    scored = pairs.mapInPandas(best, f"query {kind}, {key} {kind}, score double")
    window = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), key)
    return scored.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)


def fused(keyword: DataFrame, vector: DataFrame, key: str, k: int = 10, damping: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two lists (key, position); a list that lacks a record adds nothing."""
    both = keyword.select(key, F.col("position").alias("a")).join(vector.select(key, F.col("position").alias("b")), key, "full_outer")
    score = F.coalesce(1.0 / (damping + F.col("a")), F.lit(0.0)) + F.coalesce(1.0 / (damping + F.col("b")), F.lit(0.0))
    return both.select(key, F.round(score, 8).alias("score")).orderBy(F.desc("score"), key).limit(k)


def prompt(hits: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row: numbered records for an answer that must cite them; no hits give an empty text."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(key).alias("id"), F.col(text).alias("t"))))
    said = F.transform(lines, lambda r: F.concat(F.lit("["), r["n"].cast("string"), F.lit("] "), r["id"].cast("string"), F.lit(": "), r["t"]))
    return hits.agg(F.array_join(said, "\n").alias("records"))
