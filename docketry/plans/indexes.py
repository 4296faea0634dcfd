"""Queries on stored indexes, which they build in the shared folder from the given tables."""

from __future__ import annotations

import uuid

from docketry.operators.staging import shared_folder
from docketry.operators.text_index import TextIndex
from docketry.operators.vector_index import VectorIndex
from docketry.plans.carriers import Carriers
from docketry.plans.catalog import ORACLES, query

WORDS = r"w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t != '') AS ws FROM documents)"


def text_index(t: Carriers) -> TextIndex:
    """Documents with even ids, then those with odd ids as a segment that is added later."""
    docs, index = t.table("documents"), TextIndex(t.spark, f"{shared_folder(t.spark)}/indexes/{uuid.uuid4()}", "doc_id")
    index.add(docs.where("doc_id % 2 = 0"), "text")
    index.add(docs, "text")
    return index


@query(ORACLES["fts_prefix_and"])
def index_prefix_search(t):
    return text_index(t).prefix_search('"licen" the', 500)


@query(f"""WITH {WORDS}, l AS (SELECT doc_id, len(ws) AS n FROM w), p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS token FROM w) GROUP BY ALL),
 s AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM l), d AS (SELECT token, count(*) AS df FROM p WHERE token IN ('license', 'apache', 'version') GROUP BY 1)
 SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM p JOIN d USING (token) JOIN l USING (doc_id), s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500""")
def index_bm25(t):
    return text_index(t).bm25("license apache version", 500)


@query(f"""WITH {WORDS} SELECT doc_id, CAST(len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'the' AND ws[i + 1] = 'apache' AND ws[i + 2] = 'license')) AS INT) AS times FROM w
 WHERE len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'the' AND ws[i + 1] = 'apache' AND ws[i + 2] = 'license')) > 0""")
def index_phrase(t):
    index = text_index(t)
    index.merge()
    return index.phrase("the Apache License")


@query()
def vector_index_topk(t):
    """Ids divisible by 50 against all vectors, by probed cells; compare ``vector_topk``, which is exact."""
    vectors, index = t.table("embeddings"), VectorIndex(t.spark, f"{shared_folder(t.spark)}/indexes/{uuid.uuid4()}", "vec_id", "embedding")
    index.build(vectors)
    return index.nearest(vectors, vectors.where("vec_id % 50 = 0"), 10)
