"""Queries on incoming rows: typed exports and their rejects, text records, tags, links, ledgers and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import scalars as s
from docketry.operators import intake
from docketry.plans.registry import query

# What each test export is made of: orders as rows of texts, some of them wrong in one or several columns.
EXPORT = """x AS (SELECT o_orderkey AS k, o_orderkey % 97 = 1 AS no_id, o_orderkey % 89 = 2 AS no_docket, o_orderkey % 83 = 3 AS bad_county, o_orderkey % 79 = 4 AS bad_beds,
 o_orderkey % 73 = 5 AS bad_date, o_orderkey % 71 = 6 AS bad_cost, o_orderkey % 61 = 7 AS bad_level, o_totalprice FROM orders)"""


def export(t) -> DataFrame:
    key = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    wrong = lambda n, r, bad, good: F.when(key % n == r, bad).otherwise(good)
    return t.table("orders").select(
        key.alias("row_number"),
        wrong(97, 1, F.lit(" "), F.concat(F.lit(" "), text(key))).alias("entry_id"),
        wrong(89, 2, F.lit("see file"), F.concat(F.lit("con "), F.lpad(text(key), 7, "0"))).alias("docket_id"),
        wrong(83, 3, F.lit("Nowhere"), F.when(key % 2 == 0, "DE KALB county").otherwise("ben-hill")).alias("county"),
        wrong(79, 4, F.lit("many"), F.when(key % 3 == 0, "").otherwise(text(key % 400))).alias("bed_count"),
        wrong(73, 5, F.lit("2024-02-30"), F.lit("2/29/2024")).alias("decision_deadline"),
        wrong(71, 6, F.lit("n/a"), F.concat(F.lit("$"), text(key), F.lit(" thousand"))).alias("estimated_cost"),
        wrong(61, 7, F.lit("3 Desk Decision"), F.lit("3 Superior Court Decision")).alias("decision_level"),
        F.when(key % 5 == 0, "validated").when(key % 5 == 1, "Provisional").when(key % 5 == 2, "").alias("validation_status"),
        F.lit("MRI; pet;MRI").alias("service_type"),
    )


@query(
    f"""WITH {EXPORT} SELECT k AS row_number, k AS entry_id, 'CON-' || lpad(CAST(k AS VARCHAR), 7, '0') AS docket_id, 'CON' AS docket_family, CASE WHEN k % 2 = 0 THEN 'DeKalb' ELSE 'Ben Hill' END AS county,
 CASE WHEN k % 3 != 0 THEN CAST(k % 400 AS INT) END AS bed_count, DATE '2024-02-29' AS decision_deadline, CAST(k * 1000 AS DECIMAL(18, 2)) AS estimated_cost, 3 AS decision_level,
 CASE WHEN k % 5 = 0 THEN 'Validated' ELSE 'Unvalidated' END AS validation_status, CASE WHEN k % 5 = 1 THEN 'validation_status: Provisional' END AS warnings, 'MRI;PET' AS services
 FROM x WHERE NOT (no_id OR no_docket OR bad_county OR bad_beds OR bad_date OR bad_cost OR bad_level)"""
)
def shape_tag_rows(t):
    good, _ = intake.shape_rows(export(t))
    services = F.array_join(F.array_distinct("service_type"), ";").alias("services")
    return good.select("row_number", "entry_id", "docket_id", "docket_family", "county", "bed_count", "decision_deadline", "estimated_cost", "decision_level", "validation_status", "warnings", services)


REJECTED = """CASE WHEN no_id THEN 'entry_id' WHEN no_docket THEN 'docket_id' WHEN bad_county THEN 'county' WHEN bad_level THEN 'decision_level' WHEN bad_beds THEN 'bed_count' WHEN bad_cost THEN 'estimated_cost' ELSE 'decision_deadline' END"""


@query(
    f"""WITH {EXPORT}, r AS (SELECT *, {REJECTED} AS field FROM x WHERE no_id OR no_docket OR bad_county OR bad_beds OR bad_date OR bad_cost OR bad_level)
 SELECT k AS row_number, field, CASE field WHEN 'entry_id' THEN ' ' WHEN 'docket_id' THEN 'see file' WHEN 'county' THEN 'Nowhere' WHEN 'decision_level' THEN '3 Desk Decision' WHEN 'bed_count' THEN 'many' WHEN 'estimated_cost' THEN 'n/a' ELSE '2024-02-30' END AS raw_value FROM r"""
)
def shape_tag_rejects(t):
    return intake.shape_rows(export(t))[1].select("row_number", "field", "raw_value")


@query(f"""WITH {EXPORT}, r AS (SELECT k, no_id OR no_docket OR bad_county OR bad_beds OR bad_date OR bad_cost OR bad_level AS bad FROM x)
 SELECT count(*) AS read, count(*) FILTER (NOT bad) AS upserted, count(*) FILTER (NOT bad) AS keys, count(*) FILTER (bad) AS rejected, CAST(ceil(count(*) FILTER (NOT bad) / 500) AS BIGINT) AS commits FROM r""")
def dry_run_statistics(t):
    return intake.run_statistics(*intake.shape_rows(export(t)), "entry_id")


def text_lines(t) -> DataFrame:
    """Documents as JSON lines, some of them wrong."""
    key = F.col("doc_id")
    body = F.to_json(F.struct(F.when(key % 29 == 1, F.lit("x")).otherwise(key.cast("string")).alias("entry_id"), F.when(key % 11 == 2, " ").otherwise(F.col("text")).alias("full_text"), F.when(key % 13 == 3, "fax").otherwise("Native").alias("text_source"), F.when(key % 17 == 4, "sure").when(key % 2 == 0, "0.5").alias("di_confidence"), F.when(key % 3 == 0, F.array(F.struct(F.lit(" 1 ").alias("num"), F.lit("part").alias("text")))).alias("paragraphs")))
    return t.table("documents").select(key.alias("row_number"), F.when(key % 31 == 5, "[1, 2]").when(key % 37 == 6, '{"entry_id": ').otherwise(body).alias("line"))


TEXT_CASES = "c AS (SELECT doc_id, text, CASE WHEN doc_id % 31 = 5 OR doc_id % 37 = 6 THEN 'record' WHEN doc_id % 29 = 1 THEN 'entry_id' WHEN doc_id % 11 = 2 OR trim(coalesce(text, '')) = '' THEN 'full_text' WHEN doc_id % 13 = 3 THEN 'text_source' WHEN doc_id % 17 = 4 THEN 'di_confidence' END AS field FROM documents)"


@query(f"WITH {TEXT_CASES} SELECT doc_id AS entry_id, sha256(text) AS text_sha256, CAST(length(text) AS BIGINT) AS char_count, 'native' AS text_source, CASE WHEN doc_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS di_confidence, CASE WHEN doc_id % 3 = 0 THEN '1:part' END AS paragraphs FROM c WHERE field IS NULL")
def shape_text_records(t):
    good, _ = intake.shape_texts(text_lines(t))
    parts = F.array_join(F.transform("paragraphs", lambda p: F.concat(p["num"], F.lit(":"), p["text"])), ";")
    return good.select("entry_id", F.sha2("full_text", 256).alias("text_sha256"), "char_count", "text_source", "di_confidence", parts.alias("paragraphs"))


@query(f"WITH {TEXT_CASES} SELECT doc_id AS row_number, field FROM c WHERE field IS NOT NULL")
def shape_text_rejects(t):
    return intake.shape_texts(text_lines(t))[1].select("row_number", "field")


@query(f"""WITH {TEXT_CASES}, s AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS sure FROM c WHERE field IS NULL), h AS (SELECT doc_id, 3 AS n, CAST(0.25 AS DOUBLE) AS sure FROM documents WHERE doc_id % 5 = 0)
 SELECT doc_id AS entry_id, CAST(coalesce(s.n, h.n) AS BIGINT) AS char_count, CASE WHEN s.n IS NULL THEN 'ocr' ELSE 'native' END AS text_source, coalesce(s.sure, h.sure) AS di_confidence FROM s FULL JOIN h USING (doc_id)""")
def document_text_merge(t):
    held = t.table("documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("entry_id"), F.lit("old").alias("full_text"), F.lit(3).cast("long").alias("char_count"), F.lit("ocr").alias("text_source"), F.lit(0.25).alias("di_confidence"))
    return intake.merge_texts(held, intake.shape_texts(text_lines(t))[0]).select("entry_id", "char_count", "text_source", "di_confidence")


AXES = {"axis1": ["A", "N"], "axis2": ["Order", "Masterfile"], "axis3": ["3.1", "3.2"], "axis4": ["4.1"]}


@query("""SELECT l_orderkey * 10 + l_linenumber AS entry_id, concat_ws('|', CASE WHEN l_returnflag = 'R' THEN 'axis1: unknown R' END, CASE WHEN l_linenumber = 3 THEN 'axis2: unknown Memo' END,
 CASE WHEN l_linenumber = 1 THEN 'axis3: duplicate 3.1' END, CASE WHEN l_linenumber = 4 THEN 'axis4: unknown 9' END, CASE WHEN l_linestatus = 'F' AND l_linenumber IN (1, 4) THEN 'Masterfile: no codes may stand beside it' END) AS errors FROM lineitem""")
def axis_tag_errors(t):
    line, none = F.col("l_linenumber"), F.array().cast("array<string>")
    axis2 = F.when(line == 3, "Memo").when(F.col("l_linestatus") == "F", "Masterfile").otherwise("Order")
    rows = t.table("lineitem").select((F.col("l_orderkey") * 10 + line).alias("entry_id"), F.col("l_returnflag").alias("axis1"), axis2.alias("axis2"), F.when(line == 1, F.array(F.lit("3.1"), F.lit("3.2"), F.lit("3.1"))).otherwise(none).alias("axis3"), F.when(line == 4, F.array(F.lit("9"))).otherwise(none).alias("axis4"))
    return rows.select("entry_id", F.array_join(intake.tag_errors(AXES), "|").alias("errors"))


@query("SELECT event_id AS row_number, CAST(user_id AS VARCHAR) AS raw_value FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def unknown_entry_rejects(t):
    rows = t.table("events").select(F.col("event_id").alias("row_number"), F.col("user_id").alias("doc_id"))
    return intake.known_only(rows, t.table("labels"), "doc_id")[1].select("row_number", "raw_value")


@query("SELECT count(*) FILTER (event_type = 'purchase') AS processed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped FROM events")
def sweep_counts(t):
    named = F.when(F.col("event_type") == "purchase", "processed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped")
    return intake.sweep_counts(t.table("events").select(named.alias("status")))


@query("""WITH l AS (SELECT l_orderkey AS entry_id, max({'p': l_linenumber * 1000000 + l_partkey, 'a': l_returnflag}).a AS a1, list_sort(list_distinct(list('c' || (l_linenumber % 3)))) AS codes FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1),
 h AS (SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey % 2 = 0)
 SELECT entry_id, CASE WHEN l.codes IS NULL THEN 'old' ELSE a1 END AS axis1, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN h.entry_id IS NOT NULL THEN ['b9'] ELSE [] END, coalesce(l.codes, [])))), ';') AS codes FROM h FULL JOIN l USING (entry_id)""")
def axis_assignment(t):
    rows = t.table("lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("entry_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("row_number"), F.col("l_returnflag").alias("axis1"), F.lit(None).cast("string").alias("axis2"), F.array(F.concat(F.lit("c"), (F.col("l_linenumber") % 3).cast("string"))).alias("codes"))
    held = t.table("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("entry_id"), F.lit("old").alias("axis1"), F.lit(None).cast("string").alias("axis2"), F.array(F.lit("b9")).alias("codes"))
    return intake.set_axes(held, rows).select("entry_id", "axis1", F.array_join("codes", ";").alias("codes"))


@query("SELECT l_orderkey AS entry_id, count(DISTINCT l_partkey) AS files FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def prior_source_counts(t):
    status = F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed")
    return intake.prior_sources(t.table("lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").cast("string").alias("file_hash"), status.alias("status")))


@query("""WITH f AS (SELECT doc_id, ['pdf', 'pdf', 'image', 'text', 'html', 'unknown'][doc_id % 6 + 1] AS kind, CASE WHEN doc_id % 4 = 0 THEN 'Order' ELSE 'Exhibit' END AS doc_type, length(trim(text)) / nullif(doc_id % 50, 0) AS per_page FROM documents)
 SELECT doc_id, CASE WHEN kind = 'pdf' AND coalesce(per_page >= 20, false) THEN 'native' WHEN kind IN ('pdf', 'image') THEN CASE WHEN doc_type = 'Order' THEN 'ocr' ELSE 'skip' END WHEN kind IN ('text', 'html') THEN kind ELSE 'skip' END AS route FROM f""")
def file_routing(t):
    kinds = F.array(*map(F.lit, ["pdf", "pdf", "image", "text", "html", "unknown"]))
    kind = F.get(kinds, (F.col("doc_id") % 6).cast("int"))
    doc_type = F.when(F.col("doc_id") % 4 == 0, "Order").otherwise("Exhibit")
    return t.table("documents").select("doc_id", intake.route(kind, doc_type, F.col("text"), F.col("doc_id") % 50, ["Order", "Decision/Determination"]).alias("route"))


@query("""SELECT d.doc_id AS entry_id, d.doc_id * 3 AS docket_id, coalesce(CASE WHEN doc_id % 4 != 1 THEN 'Firm ' || source END, CASE WHEN doc_id % 2 = 0 THEN 'held' END) AS applicant, CAST(round_even(100.0 * (doc_id % 997) / 997, 2) AS DOUBLE) AS ocr_confidence FROM documents d WHERE doc_id % 3 != 1""")
def record_load(t):
    docs = t.table("documents").where("doc_id % 3 != 1")
    key = F.col("doc_id")
    files = docs.select(key.alias("entry_id"), F.lit("stem").alias("stem"), F.lit("Order").alias("doc_type"), F.lit("Initial Application").alias("phase"), "text", F.lit("native").alias("source"), ((key % 997) / 997.0).alias("confidence"))
    where = F.when(key % 4 != 1, F.concat(F.lit("a\\b/"), (key * 3).cast("string"), F.lit(" Firm "), F.col("source"), F.lit("\\x"))).otherwise("a\\b\\c")
    index = docs.select(key.alias("entry_id"), (key * 3).alias("docket_id"), where.alias("path"))
    held = docs.where("doc_id % 2 = 0").select(key.alias("entry_id"), (key * 3).alias("docket_id"), F.lit("held").alias("applicant"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("phase"), F.lit("old").alias("title"), F.lit(None).cast("double").alias("ocr_confidence"), F.lit("Validated").alias("validation_status"))
    return intake.one_record(files, index, held)[0].select("entry_id", "docket_id", "applicant", "ocr_confidence")


@query("SELECT page_id, split_part(url, '://', 2) AS path, split_part(split_part(url, '://', 2), '/', 1) AS container, substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2) AS name FROM pages")
def blob_paths(t):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return t.table("pages").select("page_id", path.alias("path"), s.blob_parts(F.concat(F.lit("/"), path)).alias("b")).select("page_id", "path", "b.container", "b.name")
