"""The records of the domain on the tables that are there: orders are matters, line items are documents and citations,
events are reported events."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Carriers:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def matters(self) -> DataFrame:
        """docket_id, year_filed, final_outcome, highest_review_level, applicant, family, county, cost, filed, custkey."""
        orders, customer, nation = self.table("orders"), self.table("customer"), self.table("nation")
        outcome = F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "O", "Denied").when(F.col("o_orderstatus") == "P", "Pending")
        joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("o_orderkey").alias("docket_id"),
            F.year("o_orderdate").alias("year_filed"),
            outcome.alias("final_outcome"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("highest_review_level"),
            F.col("c_name").alias("applicant"),
            F.col("c_mktsegment").alias("family"),
            F.col("n_name").alias("county"),
            F.col("o_totalprice").alias("cost"),
            F.to_date("o_orderdate").alias("filed"),
            F.col("o_custkey").alias("custkey"),
        )

    @cached_property
    def services(self) -> DataFrame:
        """docket_id, service_type: each pair once."""
        items, part = self.table("lineitem"), self.table("part")
        return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("docket_id"), F.col("p_type").alias("service_type")).distinct()

    @cached_property
    def filings(self) -> DataFrame:
        """entry_id, docket_id, doc_type, validation_status, doc_date, pages, partkey."""
        return self._filings(self.table("lineitem"))

    def _filings(self, items: DataFrame, *more: Column) -> DataFrame:
        status = F.when(F.col("l_linestatus") == "F", "Validated").otherwise("Unvalidated")
        return items.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"),
            F.col("l_orderkey").alias("docket_id"),
            F.col("l_returnflag").alias("doc_type"),
            status.alias("validation_status"),
            F.to_date("l_shipdate").alias("doc_date"),
            F.col("l_quantity").cast("int").alias("pages"),
            F.col("l_partkey").alias("partkey"),
            *more,
        )

    @cached_property
    def citations(self) -> DataFrame:
        """cite_id, citing_docket, cited, treatment, cite."""
        return self._citations(self.filings)

    @cached_property
    def placed_citations(self) -> DataFrame:
        """The citations with ``file`` and ``place``, their row's place in it: rows may repeat an id, and the first one counts."""
        items = self.table("lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        return self._citations(self._filings(items, F.col("file"), F.col("place")), F.col("file"), F.col("place"))

    def _citations(self, filings: DataFrame, *more: Column) -> DataFrame:
        treatment = F.when(F.col("doc_type") == "A", "Followed").when(F.col("doc_type") == "R", "Reversed").when(F.col("pages") > 25, "Distinguished")
        return filings.select(F.col("entry_id").alias("cite_id"), F.col("docket_id").alias("citing_docket"), F.col("partkey").alias("cited"), treatment.alias("treatment"), F.concat(F.col("docket_id").cast("string"), F.lit(" R. "), F.col("pages").cast("string")).alias("cite"), *more)

    @cached_property
    def events(self) -> DataFrame:
        """event_id, report_date, docket_id, section, cost, props."""
        return self.table("events").select("event_id", F.to_date("ts").alias("report_date"), "ts", F.col("user_id").alias("docket_id"), F.col("event_type").alias("section"), F.col("value").alias("cost"), "props")

    @cached_property
    def old_snapshot(self) -> DataFrame:
        return self.table("documents").where("doc_id % 19 != 0").select("doc_id", "lang", "source", "n_chars")

    @cached_property
    def new_snapshot(self) -> DataFrame:
        bumped = F.when(F.col("doc_id") % 13 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
        return self.table("documents").where("doc_id % 17 != 0").select("doc_id", "lang", "source", bumped.alias("n_chars"))


# The same records for DuckDB.
MATTERS = """matters AS (SELECT o_orderkey AS docket_id, CAST(year(o_orderdate) AS INT) AS year_filed,
 CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Denied' WHEN 'P' THEN 'Pending' END AS final_outcome,
 CAST(substr(o_orderpriority, 1, 1) AS INT) AS highest_review_level, c_name AS applicant, c_mktsegment AS family, n_name AS county,
 o_totalprice AS cost, CAST(o_orderdate AS DATE) AS filed, o_custkey AS custkey
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SERVICES = "services AS (SELECT DISTINCT l_orderkey AS docket_id, p_type AS service_type FROM lineitem JOIN part ON l_partkey = p_partkey)"
FILINGS = """filings AS (SELECT l_orderkey * 10 + l_linenumber AS entry_id, l_orderkey AS docket_id, l_returnflag AS doc_type,
 CASE WHEN l_linestatus = 'F' THEN 'Validated' ELSE 'Unvalidated' END AS validation_status, CAST(l_shipdate AS DATE) AS doc_date,
 CAST(trunc(l_quantity) AS INT) AS pages, l_partkey AS partkey FROM lineitem)"""
CITATIONS = FILINGS + """, citations AS (SELECT entry_id AS cite_id, docket_id AS citing_docket, partkey AS cited,
 CASE WHEN doc_type = 'A' THEN 'Followed' WHEN doc_type = 'R' THEN 'Reversed' WHEN pages > 25 THEN 'Distinguished' END AS treatment,
 docket_id || ' R. ' || pages AS cite FROM filings)"""
EVENTS = "evs AS (SELECT event_id, CAST(ts AS DATE) AS report_date, ts, user_id AS docket_id, event_type AS section, value AS cost, props FROM events)"
SNAPSHOTS = """old AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 19 != 0),
 new AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 13 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 17 != 0)"""
