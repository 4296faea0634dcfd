"""Queries on reading records: lists and details, dockets in any form, proceedings, feeds, digests and small columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import scalars as s
from docketry.operators import filters, graphs, lookups, proceedings, statistics
from docketry.plans.carriers import CITATIONS, EVENTS, FILINGS, MATTERS, SERVICES, SNAPSHOTS
from docketry.plans.registry import query

COUNTED = "count(*) AS total, count(*) FILTER (final_outcome = 'Approved') AS a, count(*) FILTER (final_outcome = 'Denied') AS d"
DAY = lambda x: F.lit(x).cast("date")

# Lists and details


@query(f"WITH {FILINGS} SELECT entry_id, docket_id, doc_date, pages AS page_count FROM filings WHERE doc_type = 'A' AND doc_date >= DATE '1996-01-01' AND doc_date <= DATE '1999-12-31' AND pages >= 10 AND pages <= 40 AND validation_status = 'Validated' AND contains(lower('item ' || partkey), 'item 1') ORDER BY doc_date DESC NULLS LAST, entry_id LIMIT 100 OFFSET 20")
def documents_filtered_page(t):
    rows = t.filings.withColumnRenamed("pages", "page_count").withColumn("title", F.concat(F.lit("Item "), F.col("partkey").cast("string")))
    wanted = {"doc_type": "a", "doc_date_from": DAY("1996-01-01"), "doc_date_to": DAY("1999-12-31"), "page_count_min": 10, "page_count_max": 40, "validation_status": "validated", "party": None}
    return lookups.documents_page(rows, wanted, "ITEM 1", "-doc_date", 100, 20).select("entry_id", "docket_id", "doc_date", "page_count")


@query("""WITH d AS (SELECT o_orderkey AS entry_id, o_custkey AS docket_id, 'Case ' || o_orderkey AS title FROM orders),
 c AS (SELECT l_orderkey * 10 + l_linenumber AS citation_id, l_orderkey AS citing, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS cited, CASE WHEN l_partkey % 3 = 1 THEN CAST(l_suppkey AS VARCHAR) END AS statute,
  CASE WHEN l_partkey % 3 = 2 THEN 'Ext ' || l_partkey END AS ext, CASE l_returnflag WHEN 'A' THEN 'Followed' WHEN 'R' THEN 'Reversed' WHEN 'N' THEN 'Criticized' END AS treatment, CASE WHEN l_linenumber % 2 = 0 THEN 'at ' || l_linenumber END AS pinpoint, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey % 25 END AS topic FROM lineitem),
 r AS (SELECT o_orderkey AS entry_id, o_orderkey || ' R. 1' AS cite FROM orders WHERE o_orderkey % 2 = 0),
 f AS (SELECT cited, count(*) AS citing, count(*) FILTER (treatment = 'Followed') AS positive, count(*) FILTER (treatment = 'Criticized') AS caution, count(*) FILTER (treatment = 'Reversed') AS negative FROM c WHERE cited IS NOT NULL GROUP BY 1)
 SELECT entry_id, 'flag' AS part, k AS position, ['Citing', 'Positive', 'Cautionary', 'Negative'][k + 1] AS label, coalesce([citing, positive, caution, negative][k + 1], 0) AS count, NULL AS kind, NULL AS target, NULL AS title, NULL AS cite, NULL AS pinpoint, NULL AS treatment, NULL AS level, NULL AS badge, NULL AS docket, NULL AS snippet, NULL AS key_number
 FROM d LEFT JOIN f ON f.cited = d.entry_id, (SELECT unnest(range(4)) AS k)
 UNION ALL SELECT c.cited, 'citing', citation_id, NULL, NULL, NULL, CAST(c.citing AS VARCHAR), e.title, r.cite, pinpoint, treatment, CASE treatment WHEN 'Followed' THEN 'positive' WHEN 'Criticized' THEN 'caution' WHEN 'Reversed' THEN 'negative' ELSE 'neutral' END, c_mktsegment,
  CASE WHEN c.citing % 5 = 0 THEN 'S' || c.citing ELSE CAST(e.docket_id AS VARCHAR) END, 'held', n_name
  FROM c JOIN d ON d.entry_id = c.cited JOIN d e ON e.entry_id = c.citing LEFT JOIN customer ON c_custkey = e.docket_id LEFT JOIN nation ON n_nationkey = topic LEFT JOIN r ON r.entry_id = c.citing
 UNION ALL SELECT c.citing, 'authority', citation_id, NULL, NULL, CASE WHEN c.cited IS NOT NULL THEN 'case' WHEN statute IS NOT NULL THEN 'stat' ELSE 'external' END, coalesce(CAST(c.cited AS VARCHAR), statute),
  CASE WHEN c.cited IS NOT NULL THEN d.title WHEN statute IS NOT NULL THEN 'Sec ' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ' — ' || s_name END ELSE ext END,
  CASE WHEN c.cited IS NOT NULL THEN r.cite WHEN statute IS NOT NULL THEN CASE WHEN s_nationkey % 2 = 0 THEN 'Ga. Code Ann.' ELSE 'Ga. Comp. R. & Regs.' END END, pinpoint, NULL, NULL, NULL, NULL, NULL, NULL
  FROM c LEFT JOIN d ON d.entry_id = c.cited LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = statute LEFT JOIN r ON r.entry_id = c.cited WHERE c.citing IN (SELECT entry_id FROM d)""")
def citator_report(t):
    orders, items, part, key = t.table("orders"), t.table("lineitem"), F.col("l_partkey"), F.col("o_orderkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    treatment = F.when(F.col("l_returnflag") == "A", "Followed").when(F.col("l_returnflag") == "R", "Reversed").when(F.col("l_returnflag") == "N", "Criticized")
    citations = items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("citation_id"),
        F.col("l_orderkey").alias("citing_entry_id"),
        F.when(part % 3 == 0, part).alias("cited_entry_id"),
        F.when(part % 3 == 1, F.col("l_suppkey").cast("string")).alias("cited_statute_id"),
        F.when(part % 3 == 2, text("Ext ", "l_partkey")).alias("cited_external"),
        treatment.alias("treatment"),
        F.when(F.col("l_linenumber") % 2 == 0, text("at ", "l_linenumber")).alias("pinpoint"),
        F.lit("held").alias("snippet"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 25).alias("topic_id"),
    )
    suppliers = t.table("supplier")
    return graphs.citator_report(
        citations,
        orders.select(key.alias("entry_id"), F.col("o_custkey").alias("docket_id"), text("Case ", "o_orderkey").alias("title")),
        t.table("customer").select(F.col("c_custkey").alias("docket_id"), F.col("c_mktsegment").alias("docket_family")),
        orders.where(key % 5 == 0).select(key.alias("entry_id"), text("S", "o_orderkey").alias("court_docket_no")),
        t.table("nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("key_number")),
        suppliers.select(F.col("s_suppkey").cast("string").alias("statute_id"), F.when(F.col("s_nationkey") % 2 == 0, "OCGA").otherwise("RULE").alias("kind"), text("Sec ", "s_suppkey").alias("citation_label"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("title")),
        orders.where(key % 2 == 0).select(key.alias("entry_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("cite_id")).select("entry_id", "cite_id", F.concat(F.col("entry_id").cast("string"), F.lit(" R. "), F.col("cite_id").cast("string")).alias("citation")),
    )


MATTER_ROWS = f"""{MATTERS}, rows_ AS (SELECT *, 'Center ' || custkey AS facility, family AS matter_type, 'Type ' || docket_id % 3 AS action_type, county || ', ' || family AS service_area,
 CAST(docket_id % 90 AS INT) AS bed_count, filed + 100 AS final_decision_date, CASE WHEN docket_id % 2 = 0 THEN 'stub' ELSE 'full' END AS flag FROM matters)"""


def matter_rows(t):
    key = F.col("docket_id")
    flags = F.to_json(F.array(F.lit("x"), F.when(key % 2 == 0, "stub").otherwise("full")))
    own = {"facility": F.concat(F.lit("Center "), F.col("custkey").cast("string")), "matter_type": F.col("family"), "action_type": F.concat(F.lit("Type "), (key % 3).cast("string")), "service_area": F.concat("county", F.lit(", "), "family")}
    return t.matters.withColumns(own | {"bed_count": (key % 90).cast("int"), "final_decision_date": F.date_add("filed", 100), "completeness_flags": flags})


def matter_children(t):
    phases = t.filings.select("docket_id", F.concat(F.lit("Phase "), "doc_type").alias("phase"))
    return {"service_type": t.services, "phase": phases, "docket_variant": t.matters.select("docket_id", F.concat(F.lit("con-"), (F.col("docket_id") % 50).cast("string")).alias("variant"))}


@query(f"""WITH {MATTER_ROWS} SELECT docket_id, county, bed_count, final_decision_date FROM rows_ m WHERE lower(applicant) LIKE '%customer%' AND lower(facility) LIKE '%center 1%' AND lower(matter_type) = 'building' AND lower(action_type) = 'type 1'
 AND lower(service_area) LIKE '%nation%' AND bed_count >= 5 AND bed_count <= 80 AND final_outcome = 'Approved' AND final_decision_date >= DATE '1996-01-01' AND final_decision_date <= DATE '2000-12-31' AND highest_review_level = 2
 AND flag = 'full' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = docket_id AND l_returnflag = 'A') ORDER BY final_decision_date DESC NULLS LAST, docket_id LIMIT 500""")
def matters_many_filters(t):
    wanted = {"applicant": "customer", "facility": "CENTER 1", "matter_type": "building", "action_type": "type 1", "service_area": "Nation", "bed_count_min": 5, "bed_count_max": 80, "year_filed": None, "final_outcome": "approved", "final_decision_date_from": DAY("1996-01-01"), "final_decision_date_to": DAY("2000-12-31"), "highest_review_level": 2, "phase": "phase a", "completeness_flag": "full"}
    return lookups.matters_page(matter_rows(t), matter_children(t), wanted, sort="-final_decision_date", limit=500).select("docket_id", "county", "bed_count", "final_decision_date")


@query(f"""WITH {MATTER_ROWS}, p AS (SELECT docket_id, unnest(list_filter(regexp_split_to_array(lower(service_area), '[^a-z0-9]+'), lambda x: x != '')) AS token FROM rows_), tf AS (SELECT token, docket_id, count(*) AS tf FROM p WHERE starts_with(token, '1') OR starts_with(token, 'mach') GROUP BY ALL),
 df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT docket_id, round(sum(tf * ln(1 + (SELECT count(*) FROM matters) / df)), 6) AS score FROM tf JOIN df USING (token) GROUP BY 1 HAVING count(DISTINCT substr(token, 1, 1)) = 2)
 SELECT docket_id, county, score FROM rows_ JOIN r USING (docket_id) WHERE final_outcome = 'Denied' AND docket_id % 50 = 7 ORDER BY score DESC, docket_id LIMIT 100""")
def matters_ranked(t):
    """A full-text search's ranks joined back to the records, with filters."""
    from docketry.operators import search

    rows = matter_rows(t)
    ranks = search.prefix_search(rows, "docket_id", "service_area", "1 mach", 1 << 30)
    return lookups.matters_page(rows, matter_children(t), {"final_outcome": "Denied", "docket_variant": "CON-7"}, "1 mach", ranks, limit=100).select("docket_id", "county", "score")


@query(f"WITH {FILINGS} SELECT entry_id FROM filings WHERE contains(lower('[\"Party ' || partkey || '\",\"State\"]'), 'party 12') ORDER BY entry_id LIMIT 500")
def documents_by_party(t):
    parties = F.to_json(F.array(F.concat(F.lit("Party "), F.col("partkey").cast("string")), F.lit("State")))
    return lookups.documents_page(t.filings.withColumn("parties", parties), {"party": "Party 12"}, limit=500).select("entry_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{\"lang\":\"' || lang || '\"}' WHEN doc_id % 3 = 1 THEN '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' ELSE '{\"n\":' || n_chars || '}' END AS record FROM documents")
def compact_records(t):
    from docketry.sources import readers

    key = F.col("doc_id")
    record = F.struct(F.when(key % 3 != 2, F.col("lang")).alias("lang"), F.when(key % 3 != 0, F.col("n_chars")).alias("n"))
    return t.table("documents").select("doc_id", readers.compact_json(record).alias("record"))


@query(f"WITH {MATTERS}, {FILINGS} SELECT docket_id, applicant, count(entry_id) AS n, string_agg(CAST(entry_id AS VARCHAR), ';' ORDER BY doc_date DESC, entry_id) AS entries FROM matters LEFT JOIN filings USING (docket_id) GROUP BY 1, 2")
def docket_documents(t):
    order = F.array_sort(F.collect_list(F.struct((-F.unix_date("doc_date")).alias("d"), "entry_id")))
    lists = t.filings.groupBy("docket_id").agg(order.alias("f"))
    whole = t.matters.select("docket_id", "applicant").join(lists, "docket_id", "left")
    entries = F.array_join(F.transform("f", lambda x: x["entry_id"].cast("string")), ";")
    return whole.select("docket_id", "applicant", F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("n"), entries.alias("entries"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CON-' || lpad(CAST(user_id AS VARCHAR), 7, '0') WHEN 1 THEN 'CON-' || lpad(CAST(user_id AS VARCHAR), 7, '0') WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'CON-' || lpad(CAST(user_id AS VARCHAR), 7, '0') END END AS docket_id
 FROM events WHERE user_id IN (SELECT o_orderkey FROM orders) OR event_id % 4 = 3""")
def resolve_dockets(t):
    """Texts in several forms: canonical, loosely written, as a variant of even dockets, and of no docket at all."""
    number = F.lpad(F.col("user_id").cast("string"), 7, "0")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("CON-"), number)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Docket No. con"), number)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("old name "), number)).otherwise("nothing")
    known = t.table("orders").select(F.concat(F.lit("CON-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("docket_id"), F.col("o_orderkey").alias("k"))
    there = t.table("events").join(known.select(F.col("k").alias("user_id")), "user_id", "left_semi").union(t.table("events").join(known.select(F.col("k").alias("user_id")), "user_id", "left_anti").where("event_id % 4 = 3"))
    variants = known.where("k % 2 = 0").select("docket_id", F.concat(F.lit("old name "), F.substring("docket_id", 5, 7)).alias("variant"))
    return lookups.resolve_dockets(there.select("event_id", raw.alias("raw")), known, variants).select("event_id", "docket_id")


@query("""WITH x AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem), c AS (SELECT l_partkey AS cited, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT p_partkey, p_name, coalesce(c.n, 0) AS citing, (SELECT count(*) FROM x WHERE x.a = p_partkey) AS related FROM part LEFT JOIN c ON c.cited = p_partkey""")
def statute_detail(t):
    related = graphs.both_ways(t.table("lineitem"), "l_suppkey", "l_partkey").groupBy(F.col("source").alias("p_partkey")).agg(F.count("*").alias("related"))
    citing = t.citations.groupBy(F.col("cited").alias("p_partkey")).agg(F.count("*").alias("citing"))
    both = t.table("part").select("p_partkey", "p_name").join(citing, "p_partkey", "left").join(related, "p_partkey", "left")
    return both.fillna(0, ["citing", "related"]).select("p_partkey", "p_name", "citing", "related")


@query("SELECT coalesce(CASE WHEN p_size > 10 THEN p_brand END, '') AS grp, string_agg(CAST(p_partkey AS VARCHAR), ';' ORDER BY p_name, p_partkey) AS articles, count(*) AS n FROM part GROUP BY 1")
def wiki_listing(t):
    rows = t.table("part").select(F.coalesce(F.when(F.col("p_size") > 10, F.col("p_brand")), F.lit("")).alias("grp"), "p_name", "p_partkey")
    lists = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))).alias("a"))
    return lists.select("grp", F.array_join(F.transform("a", lambda x: x["p_partkey"].cast("string")), ";").alias("articles"), F.size("a").cast("long").alias("n"))


@query("SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'under') AS INT) + CAST(contains(lower(text), 'version') AS INT) AS score FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(text), 'under') OR contains(lower(text), 'version')) ORDER BY 2 DESC, 1 LIMIT 100")
def advanced_query(t):
    text, facets = lookups.advanced("license", "under the", "version of", " ", {"lang": "en", "source": ""})
    return lookups.typed_query(filters.facet_filter(t.table("documents"), facets), text, "lang", "text", "doc_id")


@query("SELECT doc_id, 0 AS score FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') ORDER BY doc_id LIMIT 50")
def docket_type_query(t):
    rows = t.table("documents").withColumn("kind", F.upper("lang"))
    return lookups.typed_query(filters.facet_filter(rows, {"source": ["src1", "src2"]}), "docket-type: en", "kind", "text", "doc_id", 50)


# Proceedings

SHORT = "strftime({0}, '%b ') || day({0}) || strftime({0}, ', %Y')"
PROCEEDING = f"""m AS (SELECT o_orderkey AS docket_id, CASE WHEN o_orderkey % 3 = 0 THEN 'DET' ELSE 'CON' END AS base, CASE WHEN o_orderkey % 7 = 0 THEN make_date(CAST(year(o_orderdate) AS INT), 1, 1) ELSE CAST(o_orderdate AS DATE) END AS filed,
 o_orderstatus != 'P' AS closed, CAST(o_orderdate AS DATE) + 100 AS decided FROM orders),
 d AS (SELECT *, CASE WHEN closed THEN decided WHEN base = 'CON' THEN filed + 120 ELSE filed + 45 END AS desk, date_diff('day', filed, DATE '2000-01-01') AS age FROM m),
 e AS (SELECT *, desk + CASE base WHEN 'CON' THEN 143 ELSE 113 END AS hearing, desk + CASE base WHEN 'CON' THEN 171 ELSE 141 END AS ruling,
  CASE WHEN base = 'CON' THEN CASE WHEN age < 120 THEN 1 WHEN age < 150 THEN 2 WHEN age < 240 THEN 3 ELSE 4 END ELSE CASE WHEN age < 45 THEN 1 WHEN age < 60 THEN 2 WHEN age < 100 THEN 3 ELSE 4 END END AS stage FROM d),
 st AS (SELECT docket_id, base, closed, stage, n, CASE WHEN base = 'CON' THEN ['Letter of Intent', 'Initial Filing Review', 'Initial Decision Challenge', 'Administrative Appeal', 'Final Agency Decision', 'Judicial Review', 'Appellate Review', 'Terminal Outcomes'][n + 1]
   ELSE ['Request Submission', 'DCH Review & Letter Issued', 'Finality or Challenge', 'Administrative Appeal', 'Judicial & Appellate'][n] END AS title,
  CASE WHEN base = 'CON' THEN CASE n WHEN 0 THEN 'Filed ' || {SHORT.format("filed")} WHEN 1 THEN 'Submitted ' || {SHORT.format("filed")} || CASE WHEN closed THEN ' · Decision ' || {SHORT.format("desk")} ELSE ' · 120-day review clock' END
    WHEN 2 THEN CASE WHEN closed THEN 'Challenge window closed' ELSE 'Opens on desk decision · 30-day window' END WHEN 3 THEN CASE WHEN closed THEN 'Hearing ' || {SHORT.format("hearing")} || ' · Decision ' || {SHORT.format("ruling")} ELSE 'Appointed ' || {SHORT.format("(desk + 44)")} END
    WHEN 4 THEN CASE WHEN closed THEN 'Effective ' || {SHORT.format("ruling")} ELSE 'Triggered upon Stage 3 conclusion' END WHEN 5 THEN 'Petition within 30 days of final agency decision' WHEN 6 THEN 'Upon Superior Court disposition' ELSE CASE WHEN closed THEN 'Record closed ' || {SHORT.format("decided")} ELSE '' END END
   ELSE CASE n WHEN 1 THEN 'Filed ' || {SHORT.format("filed")} WHEN 2 THEN CASE WHEN closed THEN 'Letter issued ' || {SHORT.format("desk")} ELSE 'Due ~60 days from filing' END WHEN 3 THEN CASE WHEN closed THEN 'Challenge window closed' ELSE 'Opens on letter issuance · 30-day window' END
    WHEN 4 THEN 'Identical mechanics to CON administrative appeal' ELSE 'Upon final agency decision' END END AS line,
  CASE WHEN closed OR n < stage THEN 'complete' WHEN n = stage THEN 'active' ELSE 'pending' END AS status FROM e, (SELECT unnest(range(8)) AS n) WHERE base = 'CON' OR n BETWEEN 1 AND 5)"""


def proceeding_matters(t):
    key = F.col("o_orderkey")
    outcome = F.when(F.col("o_orderstatus") == "F", "Remanded").when(F.col("o_orderstatus") == "O", "Denied")
    return t.table("orders").select(key.alias("docket_id"), F.when(key % 3 == 0, "DET-EQT").otherwise("CON").alias("family"), F.when(key % 7 != 0, F.to_date("o_orderdate")).alias("received"), F.year("o_orderdate").alias("year_filed"), F.date_add(F.to_date("o_orderdate"), 100).alias("decided"), outcome.alias("final_outcome"))


@query(f"WITH {PROCEEDING} SELECT docket_id, n, title, line, status FROM st WHERE docket_id % 5 != 0 UNION ALL SELECT o_orderkey, l_linenumber, 'Label ' || l_linenumber, 'Held', CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'complete' END FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 = 0 UNION ALL SELECT docket_id, n, title, line, status FROM st WHERE docket_id % 5 = 0 AND docket_id NOT IN (SELECT l_orderkey FROM lineitem)")
def proceeding_stages(t):
    line = F.col("l_linenumber")
    stored = t.table("lineitem").where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("docket_id"), (line * 1000000 + F.col("l_partkey")).alias("sort_order"), line.alias("stage_num"), (F.col("l_linestatus") == "O").alias("is_current"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("Label "), line.cast("string")).alias("stage_label"), F.lit("Held").alias("summary"))
    made = proceedings.proceedings(proceeding_matters(t), stored, DAY("2000-01-01"))
    return made.select("docket_id", F.explode("stages").alias("x")).select("docket_id", "x.n", "x.title", F.col("x.date_line").alias("line"), "x.status")


@query(f"WITH {PROCEEDING} SELECT st.docket_id, n AS stage_num, title, CASE WHEN n = 0 OR (base = 'CON' AND n = 1) OR (base = 'DET' AND n = 1) THEN e.filed WHEN base = 'CON' AND n = 3 THEN CASE WHEN closed THEN hearing ELSE desk + 44 END WHEN closed AND base = 'CON' AND n = 4 THEN ruling WHEN closed AND base = 'CON' AND n = 7 THEN decided WHEN closed AND base = 'DET' AND n = 2 THEN desk END AS stage_date, status = 'active' AS is_current, CAST(n - CASE base WHEN 'DET' THEN 1 ELSE 0 END AS INT) AS sort_order FROM st JOIN (SELECT docket_id, filed, hearing, desk, ruling, decided FROM e) e USING (docket_id)")
def stages_to_rows(t):
    return proceedings.stage_rows(proceedings.synthesized(proceeding_matters(t), DAY("2000-01-01"))).select("docket_id", "stage_num", "title", "stage_date", "is_current", "sort_order")


@query("SELECT l_orderkey AS docket_id, coalesce((max({'p': l_linenumber * 1000000 + l_partkey, 'a': l_returnflag}) FILTER (l_linestatus = 'F')).a, max({'p': l_linenumber * 1000000 + l_partkey, 'a': l_returnflag}).a) AS outcome FROM lineitem GROUP BY 1")
def last_decided_stage(t):
    own = F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("n"), F.col("l_returnflag").alias("outcome"), F.when(F.col("l_linestatus") == "F", "green").otherwise("gray").alias("color"))))
    return proceedings.last_decided(t.table("lineitem").groupBy(F.col("l_orderkey").alias("docket_id")).agg(own.alias("stages")))


# Feeds and filters


@query(f"WITH {SNAPSHOTS} SELECT doc_id, CASE WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'added' END AS change_type FROM old o FULL JOIN new n USING (doc_id) WHERE (o.doc_id IS NULL OR n.doc_id IS NULL) AND doc_id % 2 = 0 AND doc_id % 28 >= 10 AND n.doc_id IS NOT NULL")
def changes_feed(t):
    from docketry.operators import records

    log = records.diff(t.old_snapshot, t.new_snapshot, "doc_id").select("doc_id", F.col("change").alias("change_type"), (F.col("doc_id") % 2 == 0).alias("in_scope"), F.date_add(DAY("2024-01-01"), (F.col("doc_id") % 28).cast("int")).alias("detected_at"))
    return lookups.changes(log, DAY("2024-01-11"), "added", True).select("doc_id", "change_type")


WATCHES = "w AS (SELECT c_custkey AS watch_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS docket_id, CASE WHEN c_custkey % 3 = 1 THEN c_custkey * 2 END AS entry_id, CASE WHEN c_custkey % 3 = 2 THEN 'a/' || c_custkey % 40 END AS prefix FROM customer WHERE c_custkey % 5 != 0)"


@query(f"WITH {WATCHES} SELECT DISTINCT event_id, watch_id FROM events JOIN w ON events.user_id = w.docket_id OR events.event_id = w.entry_id OR 'a/' || event_id % 40 || '/x' = w.prefix OR starts_with('a/' || event_id % 40 || '/x', w.prefix || '/')")
def watchlist_alerts(t):
    key = F.col("c_custkey")
    watches = t.table("customer").select(key.alias("watch_id"), F.when(key % 3 == 0, key).alias("docket_id"), F.when(key % 3 == 1, key * 2).alias("entry_id"), F.when(key % 3 == 2, F.concat(F.lit("a/"), (key % 40).cast("string"), F.lit("/"))).alias("path_prefix"), (key % 5 != 0).alias("active"))
    events = t.table("events").select("event_id", F.col("user_id").alias("docket_id"), F.col("event_id").alias("entry_id"), F.concat(F.lit("a/"), (F.col("event_id") % 40).cast("string"), F.lit("/x")).alias("path"))
    return lookups.watched(events, watches).select("event_id", "watch_id")


@query("SELECT c_custkey AS watch_id FROM customer WHERE c_custkey % 5 != 0")
def active_watches(t):
    return lookups.active_only(t.table("customer").select(F.col("c_custkey").alias("watch_id"), F.when(F.col("c_custkey") % 5 != 0, 1).alias("active"))).select("watch_id")


TYPES = ["CON", "DET", "DET-EQT", "DET-ASC", "LNR-ASC", "LNR-EQT"]


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'DET-EQT' ELSE 'LNR-EQT' END AS type FROM orders WHERE o_orderkey % 6 IN (2, 5)")
def scope_filter(t):
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("o_orderkey") % 6).cast("int"))
    return lookups.in_scope(t.table("orders").select("o_orderkey", kind.alias("type")), "equipment", "type")


@query(f"WITH {MATTERS} SELECT family, CASE final_outcome WHEN 'Approved' THEN 'granted' WHEN 'Denied' THEN 'denied' WHEN 'Pending' THEN 'pending' ELSE 'other' END AS bucket, count(*) AS n FROM matters GROUP BY 1, 2")
def application_buckets(t):
    return t.matters.groupBy("family", lookups.status_bucket(F.col("final_outcome")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS topic_key, count(*) AS n FROM part GROUP BY 1 HAVING contains(lower(p_brand), '#1') OR bool_or(contains(lower(p_name), 'ring'))")
def topic_filter(t):
    topics = t.table("part").groupBy(F.col("p_brand").alias("topic_key")).agg(F.collect_list(F.struct(F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("key"))).alias("children"), F.count("*").alias("n"))
    found = lookups.matching_topics(topics.withColumn("title", F.lit("")), "RING").unionByName(lookups.matching_topics(topics.withColumn("title", F.col("topic_key")).withColumn("children", F.array().cast("array<struct<title:string,key:string>>")), "#1"))
    return found.select("topic_key", "n").distinct()


@query(f"WITH {EVENTS} SELECT event_id FROM evs WHERE section IN ('purchase', 'signup')")
def history_tab(t):
    return lookups.in_tab(t.events, "section", "decisions", {"decisions": ["purchase", "signup"], "errors": ["error"]}).select("event_id")


@query("SELECT doc_id, court, rank FROM (SELECT doc_id, court, CAST(row_number() OVER (ORDER BY CASE court WHEN 'Ga. Ct. App.' THEN 1 WHEN 'Superior Court' THEN 3 WHEN 'OSAH' THEN 4 ELSE 9 END, doc_id) AS INT) AS rank FROM (SELECT doc_id, ['Ga. Ct. App.', 'OSAH', 'Superior Court', 'Elsewhere'][doc_id % 4 + 1] AS court FROM documents)) WHERE rank <= 100")
def results_by_court(t):
    court = F.get(F.array(*map(F.lit, ["Ga. Ct. App.", "OSAH", "Superior Court", "Elsewhere"])), (F.col("doc_id") % 4).cast("int"))
    return lookups.ranked(t.table("documents").withColumn("court", court), "court", "n_chars", "n_chars", "court", "doc_id").select("doc_id", "court", "rank")


# Joins and digests


@query("SELECT l_orderkey * 10 + l_linenumber AS headnote_id, p_brand AS topic FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 20")
def headnote_topics(t):
    topics = t.table("part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    return t.table("lineitem").join(topics, "l_partkey", "left").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("headnote_id"), "topic")


@query("SELECT p_brand AS topic, count(*) AS headnotes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def headnotes_per_topic(t):
    return t.table("lineitem").join(t.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic")), "l_partkey").groupBy("topic").agg(F.count("*").alias("headnotes"))


@query("SELECT n_name AS county, coalesce(r_name, 'elsewhere') AS region, coalesce(r_regionkey, -1) AS volume FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def curated_regions(t):
    curated = t.table("region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"), F.col("r_regionkey").alias("volume"))
    return t.table("nation").join(curated, "n_regionkey", "left").select(F.col("n_name").alias("county"), F.coalesce("region", F.lit("elsewhere")).alias("region"), F.coalesce("volume", F.lit(-1)).alias("volume"))


@query("SELECT doc_id, sha256(text) AS text_sha256, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def text_export(t):
    return t.table("documents").join(t.table("labels").where("quality IS NOT NULL"), "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "quality")


@query("SELECT count(*) AS entries, max(doc_id) AS last_entry FROM documents")
def snapshot_baseline(t):
    return t.table("documents").agg(F.count("*").alias("entries"), F.max("doc_id").alias("last_entry"))


@query(f"WITH {MATTERS} SELECT highest_review_level AS level, count(*) AS n, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(round_even(100.0 * count(*) FILTER (final_outcome = 'Denied') / count(*), 1) AS DOUBLE) END AS reversal_pct FROM matters GROUP BY 1")
def reversal_by_stage(t):
    sums = t.matters.groupBy(F.col("highest_review_level").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("final_outcome") == "Denied").alias("r"))
    return sums.select("level", "n", s.percent(F.col("r"), F.col("n")).alias("reversal_pct"))


@query(f"WITH {CITATIONS} SELECT coalesce(treatment, 'Neutral') AS treatment, count(*) AS n, count(DISTINCT cited) AS cited FROM citations GROUP BY 1")
def treatment_mix(t):
    return t.citations.groupBy(F.coalesce("treatment", F.lit("Neutral")).alias("treatment")).agg(F.count("*").alias("n"), F.countDistinct("cited").alias("cited"))


@query(f"WITH {EVENTS} SELECT report_date, count(*) FILTER (section = 'signup') AS filed, count(*) FILTER (section IN ('purchase', 'error')) AS issued FROM evs GROUP BY 1")
def section_digest(t):
    return statistics.digest(t.events, "report_date", "section", ["signup"], ["purchase", "error"])


@query(f"WITH {MATTERS}, {SERVICES}, g AS (SELECT service_type, {COUNTED} FROM services JOIN matters USING (docket_id) GROUP BY 1), p AS (SELECT service_type, total, CAST(floor(100.0 * a / total + 0.5) AS BIGINT) AS grant_pct, CAST(floor(100.0 * d / total + 0.5) AS BIGINT) AS deny_pct FROM g) SELECT *, greatest(0, 100 - grant_pct - deny_pct) AS withdrawn_pct FROM p ORDER BY total DESC, service_type LIMIT 8")
def service_breakdown(t):
    return statistics.breakdown(statistics.by_service(t.matters, t.services), "service_type", 8)


@query(f"WITH {EVENTS} SELECT docket_id, count(*) FILTER (section = 'signup') AS saved, count(*) FILTER (section = 'error') AS flagged FROM evs GROUP BY 1")
def project_counts(t):
    return t.events.groupBy("docket_id").agg(F.count_if(F.col("section") == "signup").alias("saved"), F.count_if(F.col("section") == "error").alias("flagged"))


@query(f"WITH {EVENTS} SELECT section, count(*) AS events, count(*) FILTER (docket_id % 10 = 0) AS without_docket FROM evs GROUP BY 1")
def report_summary(t):
    return t.events.withColumn("d", F.when(F.col("docket_id") % 10 != 0, F.col("docket_id"))).groupBy("section").agg(F.count("*").alias("events"), F.count_if(F.col("d").isNull()).alias("without_docket"))


# Small columns


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS plain FROM conversations GROUP BY 1")
def rich_text_plain(t):
    parts = t.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("style"), "text"))).alias("p"))
    return parts.select("conv_id", s.flat_text("p").alias("plain"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 3 = 0 AS has_flags, event_id % 6 = 0 AS is_stub FROM events")
def derived_flags(t):
    flags = F.when(F.col("event_id") % 6 == 0, '["stub_from_report"]').when(F.col("event_id") % 3 == 0, '["no_date"]').when(F.col("event_id") % 3 == 1, "not json").otherwise("[]")
    rows = t.table("events").select("event_id", s.json_or_null("props", "k int").alias("p"), s.json_or_null(flags, "array<string>").alias("f"))
    return rows.select("event_id", F.col("p.k").alias("k"), s.has_flags("f").alias("has_flags"), s.is_stub("f").alias("is_stub"))


@query("""WITH x AS (SELECT event_id, ts, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00') / 60000000) AS BIGINT) AS m FROM events)
 SELECT event_id, CAST(year(ts) AS INT) AS doc_year, CAST(ts AS DATE) AS detected_date, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS ago FROM x""")
def event_ages(t):
    return t.table("events").select("event_id", F.year("ts").alias("doc_year"), F.to_date("ts").alias("detected_date"), s.time_ago("ts", F.lit("2024-01-20").cast("timestamp_ntz").cast("timestamp")).alias("ago"))


@query("SELECT doc_id, CAST(round_even(100 * CAST(n_chars % 1000 AS DOUBLE) / 1000, 2) AS DOUBLE) AS confidence, CAST((r > 0.14)::INT + (r > 0.32)::INT + (r > 0.55)::INT + (r > 0.8)::INT AS INT) AS shade FROM (SELECT doc_id, n_chars, (n_chars % 1000) / 1000 AS r FROM documents)")
def confidence_and_shade(t):
    share = (F.col("n_chars") % 1000) / 1000.0
    return t.table("documents").select("doc_id", share.alias("r")).select("doc_id", s.as_percent("r").alias("confidence"), s.ratio_shade("r").alias("shade"))
