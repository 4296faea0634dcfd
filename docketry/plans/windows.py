"""Event-time windows, interval joins, bucketed merges and collated keys on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.functions.scalars import collated
from docketry.operators.staging import shared_folder
from docketry.plans.catalog import ORACLES, incoming, query
from docketry.sources.tables import BucketedTable
from docketry.streaming import incremental


def events(t):
    return t.table("events").select("event_id", F.col("user_id").alias("docket_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH e AS (SELECT user_id AS docket_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOURS, true) AS fresh FROM events),
 s AS (SELECT docket_id, ts, sum(CAST(fresh AS INT)) OVER (PARTITION BY docket_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
 SELECT docket_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY docket_id, k""")
def session_counts(t):
    return incremental.session_counts(events(t), "ts", "docket_id", "12 hours")


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL (6 * unnest(range(4))) HOURS AS start FROM events) GROUP BY ALL""")
def sliding_counts(t):
    return incremental.sliding_counts(events(t), "ts", "event_type")


@query("""SELECT p.event_id AS event_id, c.event_id AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 2 DAYS
 WHERE p.event_type = 'purchase' AND c.event_type = 'click'""")
def clicks_before_purchases(t):
    bought = events(t).where("event_type = 'purchase'").select("event_id", "docket_id", "ts")
    clicks = events(t).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "docket_id", F.col("ts").alias("click_ts"))
    return incremental.joined_within(bought, clicks, "docket_id", "ts", "click_ts", "2 DAYS").select("event_id", "click_id")


@query(ORACLES["merge_coalesce"])
def merge_bucketed(t):
    table = BucketedTable(t.spark, f"{shared_folder(t.spark)}/tables/{uuid.uuid4()}", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", ["c_custkey"], 16)
    table.merge(t.table("customer"))
    table.merge(incoming(t))
    return table.read()


SPELT = "CASE doc_id % 3 WHEN 0 THEN upper(source) WHEN 1 THEN source || '  ' ELSE source END"


@query(f"WITH d AS (SELECT rtrim(lower({SPELT})) AS k, doc_id, n_chars FROM documents) SELECT k AS source, count(*) AS documents, sum(n_chars)::BIGINT AS n_chars FROM d GROUP BY 1")
def collated_groups(t):
    docs = collated(t.table("documents").withColumn("source", F.expr(SPELT)), "source")
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("n_chars")).select(F.rtrim(F.lower(F.collate("source", "UTF8_BINARY"))).alias("source"), "documents", "n_chars")


@query(f"WITH d AS (SELECT rtrim(lower({SPELT})) AS k, doc_id FROM documents), s AS (SELECT DISTINCT lower(source) AS k FROM documents WHERE source < 'src3') SELECT doc_id FROM d JOIN s USING (k)")
def collated_join(t):
    docs = collated(t.table("documents").withColumn("source", F.expr(SPELT)), "source")
    known = collated(t.table("documents").where("source < 'src3'").select(F.upper("source").alias("source")), "source").distinct()
    return docs.join(known, "source").select("doc_id")
