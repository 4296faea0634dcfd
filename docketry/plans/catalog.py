"""Queries on statistics, filters, joins, search, versions and rules, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import dockets, reports, texts
from docketry.functions import scalars as s
from docketry.operators import filters, graphs, matching, records, search, statistics
from docketry.plans.carriers import CITATIONS, EVENTS, FILINGS, MATTERS, SERVICES, SNAPSHOTS
from docketry.plans.registry import ORACLES, QUERIES, query
from docketry.sources import readers, vocabulary

RATE = "CASE WHEN {1} = 0 THEN 0.0 ELSE CAST(round_even(100.0 * {0} / {1}, 1) AS DOUBLE) END"
GROUPED = "count(*) AS total, count(*) FILTER (final_outcome = 'Approved') AS approved, count(*) FILTER (final_outcome = 'Denied') AS denied"


# Outcome statistics


@query(f"WITH {MATTERS}, {SERVICES} SELECT *, {RATE.format('approved', '(approved + denied)')} AS approval_pct FROM (SELECT service_type, {GROUPED} FROM services JOIN matters USING (docket_id) GROUP BY 1)")
def stats_by_service(t):
    return statistics.by_service(t.matters, t.services)


@query(f"WITH {MATTERS} SELECT *, {RATE.format('approved', '(approved + denied)')} AS approval_pct FROM (SELECT year_filed, {GROUPED} FROM matters WHERE year_filed >= 2001 - 3 GROUP BY 1)")
def stats_by_year(t):
    return statistics.by_group(statistics.since_year(t.matters, 2001, 3), "year_filed")


@query(f"WITH {MATTERS} SELECT *, {RATE.format('approved', '(approved + denied)')} AS approval_pct FROM (SELECT family, {GROUPED} FROM matters GROUP BY 1)")
def stats_by_family(t):
    return statistics.by_group(t.matters, "family")


@query(f"WITH {MATTERS} SELECT *, {RATE.format('approved', '(approved + denied)')} AS approval_pct FROM (SELECT county, year_filed, {GROUPED} FROM matters GROUP BY 1, 2)")
def stats_by_county_year(t):
    return statistics.by_group(t.matters, "county", "year_filed")


@query(f"WITH {MATTERS} SELECT final_outcome, count(*) AS n FROM matters GROUP BY 1")
def stats_outcome_counts(t):
    return statistics.outcome_counts(t.matters)


@query(
    f"""WITH {MATTERS} SELECT *, {RATE.format("appealed", "total")} AS appeal_pct, {RATE.format("reversed", "appealed")} AS reversal_pct FROM
 (SELECT count(*) AS total, count(*) FILTER (highest_review_level >= 2) AS appealed, count(*) FILTER (final_outcome = 'Denied') AS reversed,
 count(*) FILTER (final_outcome = 'Approved') AS affirmed FROM matters)"""
)
def stats_kpis(t):
    return statistics.key_figures(t.matters)


@query(
    f"""WITH {MATTERS} SELECT county, count(*) AS total, count(*) FILTER (final_outcome = 'Approved') AS approved,
 count(*) FILTER (final_outcome NOT IN ('Pending', 'Unknown', 'Withdrawn')) AS decided,
 count(*) FILTER (final_outcome = 'Approved') / nullif(count(*) FILTER (final_outcome NOT IN ('Pending', 'Unknown', 'Withdrawn')), 0) AS approval_rate FROM matters GROUP BY 1"""
)
def bi_approval_rate(t):
    return statistics.approval_rate(t.matters, "county")


@query(
    f"""WITH {MATTERS}, {FILINGS} SELECT median(d) AS median_days, count(*) AS sample_size FROM (SELECT date_diff('day', s, e) AS d FROM
 (SELECT docket_id, min(filed) AS s FROM matters GROUP BY 1) JOIN (SELECT docket_id, min(doc_date) AS e FROM filings GROUP BY 1) USING (docket_id) WHERE e >= s)"""
)
def bi_median_days(t):
    return statistics.median_days(t.matters, t.filings, "docket_id", "filed", "doc_date")


@query(
    f"""WITH joined AS (SELECT d.doc_id, CASE quality WHEN 1 THEN 'Validated' WHEN 0 THEN 'Rejected' ELSE 'Unvalidated' END AS status, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
 sums AS (SELECT count(*) AS total, count(*) FILTER (status = 'Validated') AS validated, count(*) FILTER (status = 'Unvalidated') AS unvalidated,
 count(*) FILTER (status = 'Rejected') AS rejected, count(*) FILTER (status = 'Corrected') AS corrected, count(*) FILTER (quality IS NULL) AS missing_quality,
 count(*) FILTER (toxic IS NULL) AS missing_toxic FROM joined) SELECT *, {RATE.format("validated", "total")} AS validated_pct FROM sums"""
)
def bi_completeness_audit(t):
    joined = t.table("documents").select("doc_id").join(t.table("labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "Validated").when(F.col("quality") == 0, "Rejected").otherwise("Unvalidated")
    return statistics.audit(joined.withColumn("status", status), "status", ["quality", "toxic"])


@query(f"WITH {EVENTS} SELECT section, report_date, count(*) AS n, count(DISTINCT docket_id) AS dockets FROM evs WHERE report_date > DATE '2024-01-24' - 7 GROUP BY 1, 2")
def bi_change_activity(t):
    recent = t.events.where(F.col("report_date") > F.date_sub(F.lit("2024-01-24").cast("date"), 7))
    return recent.groupBy("section", "report_date").agg(F.count("*").alias("n"), F.countDistinct("docket_id").alias("dockets"))


@query(f"WITH {MATTERS} SELECT 'Stage ' || l_linenumber AS stage_label, county, median(date_diff('day', filed, CAST(l_shipdate AS DATE))) AS median, count(*) AS sample_size FROM lineitem JOIN matters ON l_orderkey = docket_id GROUP BY ALL")
def stage_durations(t):
    stages = t.table("lineitem").select(F.col("l_orderkey").alias("docket_id"), F.concat(F.lit("Stage "), F.col("l_linenumber").cast("string")).alias("stage_label"), F.to_date("l_shipdate").alias("at"))
    taken = stages.join(t.matters, "docket_id").withColumn("duration_days", F.date_diff("at", "filed"))
    return statistics.median_by(taken, ["stage_label", "county"], "duration_days")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS changes, count(*) FILTER (event_id % 3 = 0) AS in_scope_changes, count(*) FILTER (event_id % 3 = 0 AND event_type = 'error') AS revalidations FROM events GROUP BY 1")
def change_activity(t):
    scoped = F.when(F.col("event_id") % 3 == 0, True)
    log = t.table("events").select(F.col("ts").alias("detected_at"), scoped.alias("in_scope"), (scoped & (F.col("event_type") == "error")).alias("revalidation_flagged"))
    return statistics.change_activity(log)


@query("SELECT count(*) AS documents, count(DISTINCT l.doc_id) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage_counts(t):
    own = t.table("labels").withColumn("known", F.col("doc_id"))
    joined = t.table("documents").select("doc_id").join(own, "doc_id", "left")
    return joined.agg(F.count("*").alias("documents"), F.countDistinct("known").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(f"WITH {FILINGS}, c AS (SELECT doc_type, validation_status, count(*) AS n FROM filings GROUP BY 1, 2) SELECT doc_type, validation_status, n FROM c")
def document_type_counts(t):
    return t.filings.groupBy("doc_type", "validation_status").agg(F.count("*").alias("n"))


@query(f"WITH {MATTERS}, c AS (SELECT county, count(*) AS n FROM matters GROUP BY 1) SELECT county, n, CAST(round_even(n / (SELECT max(n) FROM c), 4) AS DOUBLE) AS share_of_largest FROM c")
def county_shares(t):
    return statistics.shares(t.matters, "county")


@query(f"WITH {MATTERS} SELECT county, n FROM (SELECT county, count(*) AS n FROM matters GROUP BY 1) ORDER BY n DESC, county LIMIT 7")
def top_counties(t):
    return t.matters.groupBy("county").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "county").limit(7)


# Filters, sorts, pages

MATTER_FILTERS = {"county": ("county", "eq"), "applicant": ("applicant", "like"), "year_from": ("year_filed", "gte"), "year_to": ("year_filed", "lte"), "outcome": ("final_outcome", "eq"), "cost_from": ("cost", "gte")}
MATTER_SORTS = {"year_filed": "year_filed", "cost": "cost", "applicant": "applicant"}


@query(f"WITH {MATTERS} SELECT docket_id, county, year_filed, final_outcome FROM matters WHERE lower(county) = 'nation_11' AND lower(applicant) LIKE '%customer%' AND year_filed >= 1996 AND year_filed <= 2000 AND final_outcome = 'Approved' AND cost >= 20000 ORDER BY year_filed DESC NULLS LAST, docket_id LIMIT 50 OFFSET 10")
def matters_filtered_page(t):
    wanted = {"county": "Nation_11", "applicant": "CUSTOMER", "year_from": 1996, "year_to": 2000, "outcome": "Approved", "cost_from": 20000.0}
    rows = filters.where_all(t.matters, MATTER_FILTERS, wanted).select("docket_id", "county", "year_filed", "final_outcome")
    return filters.page(filters.order(rows, MATTER_SORTS, "-year_filed", ["docket_id"]), 50, 10)


@query(f"WITH {MATTERS}, {SERVICES} SELECT docket_id, county, final_outcome FROM matters m WHERE EXISTS (SELECT 1 FROM services s WHERE s.docket_id = m.docket_id AND lower(s.service_type) = (SELECT lower(min(p_type)) FROM part))")
def matters_exists_service(t):
    least = F.broadcast(t.table("part").agg(F.lower(F.min("p_type")).alias("least")))
    chosen = t.services.join(least, F.lower("service_type") == F.col("least"))
    return t.matters.join(chosen.select("docket_id"), "docket_id", "left_semi").select("docket_id", "county", "final_outcome")


@query(f"WITH {MATTERS} SELECT docket_id, applicant, county FROM matters WHERE contains(lower(applicant), '00012') OR contains(lower(county), 'an')")
def matters_like_any(t):
    low = filters.like_any(t.matters, ["applicant", "county"], "AN").select("docket_id", "applicant", "county")
    digits = filters.like_any(t.matters, ["applicant"], "00012").select("docket_id", "applicant", "county")
    return low.union(digits).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50")
def json_flag_filter(t):
    return t.events.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS INT)").alias("k")).where("k >= 50")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def untagged_anti_join(t):
    return filters.without_child(t.table("documents").select("doc_id", "lang", "source"), t.table("labels"), "doc_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def masterfile_violations(t):
    own = t.table("labels")
    return own.where("quality = 1").select("doc_id").join(own.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1, 2")
def facet_counts(t):
    return filters.facet_counts(t.table("documents"), ["lang", "source"])


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3')")
def facet_filter(t):
    return filters.facet_filter(t.table("documents"), {"lang": ["de", "fr"], "source": ["src1", "src2", "src3"], "n_chars": []}).select("doc_id", "lang", "source")


@query(f"WITH {FILINGS} SELECT entry_id, docket_id, doc_date FROM filings WHERE validation_status = 'Unvalidated' AND doc_date >= DATE '1999-01-01'")
def validation_queue(t):
    return t.filings.where((F.col("validation_status") == "Unvalidated") & (F.col("doc_date") >= F.lit("1999-01-01").cast("date"))).select("entry_id", "docket_id", "doc_date")


@query(f"WITH {EVENTS} SELECT event_id, docket_id, section, report_date FROM evs WHERE section = 'purchase' AND report_date >= DATE '2024-01-20'")
def report_events_filtered(t):
    allowed = {"section": ("section", "eq"), "since": ("report_date", "gte")}
    return filters.where_all(t.events, allowed, {"section": "purchase", "since": F.lit("2024-01-20").cast("date")}).select("event_id", "docket_id", "section", "report_date")


@query(f"WITH {EVENTS} SELECT docket_id, section, last_at FROM (SELECT docket_id, section, max(ts) AS last_at FROM evs GROUP BY 1, 2) ORDER BY last_at DESC, docket_id, section LIMIT 10")
def recent_distinct_top10(t):
    last = t.events.groupBy("docket_id", "section").agg(F.max("ts").alias("last_at"))
    return last.orderBy(F.desc("last_at"), "docket_id", "section").limit(10)


# Joins, citations, roll-ups


@query(
    f"""WITH {MATTERS}, {SERVICES}, {FILINGS}, s AS (SELECT docket_id, string_agg(service_type, ';' ORDER BY service_type) AS services FROM services GROUP BY 1),
 f AS (SELECT docket_id, string_agg(CAST(entry_id AS VARCHAR), ';' ORDER BY entry_id) AS entries, count(*) AS n_entries FROM filings GROUP BY 1)
 SELECT m.docket_id, m.applicant, coalesce(s.services, '') AS services, coalesce(f.entries, '') AS entries, coalesce(f.n_entries, 0) AS n_entries
 FROM matters m LEFT JOIN s USING (docket_id) LEFT JOIN f USING (docket_id)"""
)
def matter_rollup_nested(t):
    whole = graphs.nested(t.matters.select("docket_id", "applicant"), "docket_id", services=(t.services, ["service_type"]), filings=(t.filings, ["entry_id", "doc_type", "doc_date"]))
    entries = F.transform("filings", lambda f: f["entry_id"].cast("string"))
    return whole.select("docket_id", "applicant", F.array_join(F.col("services.service_type"), ";").alias("services"), F.array_join(entries, ";").alias("entries"), F.size("filings").cast("long").alias("n_entries"))


@query(f"WITH {SERVICES} SELECT docket_id, string_agg(service_type, ';' ORDER BY service_type) AS service_type FROM services GROUP BY 1")
def string_agg_services(t):
    return graphs.joined(t.services, "docket_id", "service_type")


LEVEL = "CASE treatment WHEN 'Followed' THEN 'positive' WHEN 'Distinguished' THEN 'caution' WHEN 'Criticized' THEN 'caution' WHEN 'Reversed' THEN 'negative' WHEN 'Overruled' THEN 'negative' ELSE 'neutral' END"


@query(
    f"""WITH {CITATIONS}, levels(level) AS (VALUES ('positive'), ('caution'), ('negative'), ('neutral')),
 c AS (SELECT cited, {LEVEL} AS level, count(*) AS n FROM citations GROUP BY 1, 2)
 SELECT k.cited, l.level, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT cited FROM citations) k CROSS JOIN levels l LEFT JOIN c ON c.cited = k.cited AND c.level = l.level"""
)
def citator_flags(t):
    return graphs.citation_flags(t.citations, "cited")


@query(f"WITH {MATTERS}, {CITATIONS} SELECT c.cite_id, c.cited, c.treatment, {LEVEL} AS level, m.applicant, m.county, p_name FROM citations c LEFT JOIN matters m ON c.citing_docket = m.docket_id LEFT JOIN part ON p_partkey = c.cited WHERE c.treatment = 'Distinguished'")
def citing_cases(t):
    named = t.citations.where("treatment = 'Distinguished'").withColumn("level", graphs.level_of(F.col("treatment")))
    matters = t.matters.select(F.col("docket_id").alias("citing_docket"), "applicant", "county")
    part = t.table("part").select(F.col("p_partkey").alias("cited"), "p_name")
    return named.join(matters, "citing_docket", "left").join(part, "cited", "left").select("cite_id", "cited", "treatment", "level", "applicant", "county", "p_name")


@query(
    f"""WITH {CITATIONS} SELECT c.cite_id, coalesce('entry ' || o.o_orderkey, 'statute ' || p.p_name, 'external ' || c.cite) AS authority
 FROM citations c LEFT JOIN orders o ON o.o_orderkey = c.cited AND o.o_orderstatus = 'F' LEFT JOIN part p ON p.p_partkey = c.cited AND p.p_size > 25"""
)
def table_of_authorities(t):
    entry = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cited"), F.concat(F.lit("entry "), F.col("o_orderkey").cast("string")).alias("entry"))
    statute = t.table("part").where("p_size > 25").select(F.col("p_partkey").alias("cited"), F.concat(F.lit("statute "), "p_name").alias("statute"))
    joined = t.citations.join(entry, "cited", "left").join(statute, "cited", "left")
    return joined.select("cite_id", F.coalesce("entry", "statute", F.concat(F.lit("external "), "cite")).alias("authority"))


@query("SELECT l_suppkey AS source, l_partkey AS target FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem")
def statute_xrefs_union(t):
    return graphs.both_ways(t.table("lineitem"), "l_suppkey", "l_partkey")


@query(f"WITH {CITATIONS} SELECT cited, arg_min(cite, cite_id) AS cite FROM citations GROUP BY 1")
def first_citation_per_doc(t):
    return graphs.first_citation(t.placed_citations, "cited", "cite", "cite_id", "file", "place")


@query(f"WITH {MATTERS}, {FILINGS} SELECT p_brand AS topic, f.entry_id, f.doc_date, m.county FROM filings f JOIN part ON p_partkey = f.partkey LEFT JOIN matters m USING (docket_id) WHERE p_brand = (SELECT min(p_brand) FROM part)")
def topic_documents(t):
    part = t.table("part")
    least = F.broadcast(part.agg(F.min("p_brand").alias("topic")))
    chosen = part.join(least, F.col("p_brand") == F.col("topic")).select(F.col("p_partkey").alias("partkey"), "topic")
    return t.filings.join(chosen, "partkey").join(t.matters.select("docket_id", "county"), "docket_id", "left").select("topic", "entry_id", "doc_date", "county")


@query(f"WITH {MATTERS}, {FILINGS}, items AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS docket_id, user_id * 10 + 1 AS entry_id FROM events) SELECT i.event_id, m.docket_id, m.applicant FROM items i LEFT JOIN filings f USING (entry_id) LEFT JOIN matters m ON m.docket_id = coalesce(i.docket_id, f.docket_id)")
def project_items_coalesce_join(t):
    items = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("docket_id")).alias("own"), (F.col("docket_id") * 10 + 1).alias("entry_id"))
    found = items.join(t.filings.select("entry_id", F.col("docket_id").alias("of_entry")), "entry_id", "left").withColumn("docket_id", F.coalesce("own", "of_entry"))
    named = t.matters.select(F.col("docket_id").alias("d"), "applicant")
    return found.join(named, F.col("docket_id") == F.col("d"), "left").select("event_id", F.col("d").alias("docket_id"), "applicant")


@query("WITH RECURSIVE nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey // 5 END AS parent FROM part), tree AS (SELECT id, id AS root, 0 AS level FROM nodes WHERE parent IS NULL OR parent NOT IN (SELECT id FROM nodes) UNION ALL SELECT n.id, t.root, t.level + 1 FROM nodes n JOIN tree t ON n.parent = t.id) SELECT id, root, CAST(level AS INT) AS level FROM tree")
def topic_tree(t):
    parent = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 11 == 0, -1).otherwise(F.floor(F.col("p_partkey") / 5))
    nodes = t.table("part").select(F.col("p_partkey").alias("id"), parent.cast("long").alias("parent"))
    return graphs.tree(nodes, "id", "parent").select("id", "root", "level")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY 1")
def case_reader(t):
    rows = t.table("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    return lists.select("conv_id", F.size("p").cast("long").alias("turns"), F.array_join(F.col("p.role"), ">").alias("roles"), F.sha2(F.array_join(F.col("p.text"), "\n"), 256).alias("text_sha256"))


@query(f"WITH {EVENTS} SELECT docket_id, event_id, report_date, section, row_number() OVER (PARTITION BY docket_id ORDER BY report_date DESC, event_id DESC) AS position FROM evs")
def docket_history(t):
    order = Window.partitionBy("docket_id").orderBy(F.desc("report_date"), F.desc("event_id"))
    return t.events.select("docket_id", "event_id", "report_date", "section", F.row_number().over(order).cast("long").alias("position"))


# Views and search


@query(
    f"""WITH {MATTERS}, {SERVICES}, {FILINGS}, s AS (SELECT docket_id, string_agg(service_type, ';' ORDER BY service_type) AS services FROM services GROUP BY 1)
 SELECT f.entry_id, coalesce(nullif(m.applicant, ''), 'Document ' || f.entry_id) AS title, m.county, s.services, greatest(f.doc_date, m.filed) AS updated FROM filings f LEFT JOIN matters m USING (docket_id) LEFT JOIN s USING (docket_id)"""
)
def search_view(t):
    services = graphs.joined(t.services, "docket_id", "service_type").withColumnRenamed("service_type", "services")
    rows = t.filings.join(t.matters.select("docket_id", "applicant", "county", "filed"), "docket_id", "left").join(services, "docket_id", "left")
    title = F.coalesce(F.nullif("applicant", F.lit("")), F.concat(F.lit("Document "), F.col("entry_id").cast("string")))
    return rows.select("entry_id", title.alias("title"), "county", "services", F.greatest("doc_date", "filed").alias("updated"))


@query(
    f"""WITH {MATTERS}, {EVENTS} SELECT 'matter-' || docket_id AS id, 'matter' AS record_type, applicant || ' — ' || county AS title FROM matters UNION ALL
 SELECT 'document-' || doc_id, 'document', source || ' — ' || lang FROM documents UNION ALL SELECT 'event-' || event_id, 'event', section FROM evs"""
)
def search_docs_union(t):
    shape = lambda df, kind, key, title: df.select(F.concat(F.lit(f"{kind}-"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("record_type"), title.alias("title"))
    parts = [shape(t.matters, "matter", "docket_id", s.title("applicant", "county")), shape(t.table("documents"), "document", "doc_id", s.title("source", "lang")), shape(t.events, "event", "event_id", s.title("section"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 20")
def search_like_topk(t):
    return filters.like_any(t.table("documents"), ["text"], "the").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


PREFIXES = ["licen", "the"]


@query(
    r"""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS token FROM documents),
 tf AS (SELECT token, doc_id, count(*) AS tf FROM words WHERE token != '' GROUP BY 1, 2),
 hits AS (SELECT token, doc_id, tf, term FROM tf, (VALUES ('licen'), ('the')) v(term) WHERE starts_with(token, term)),
 df AS (SELECT token, count(DISTINCT doc_id) AS df FROM hits GROUP BY 1)
 SELECT doc_id, round(sum(tf * ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score FROM hits JOIN df USING (token) GROUP BY 1 HAVING count(DISTINCT term) = 2 ORDER BY score DESC, doc_id LIMIT 500"""
)
def fts_prefix_and(t):
    return search.prefix_search(t.table("documents"), "doc_id", "text", '"licen" the', 500)


@query("SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'apache') AS INT) + CAST(contains(lower(text), 'version') AS INT) AS score FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'apache') OR contains(lower(text), 'version') ORDER BY 2 DESC, 1 LIMIT 100")
def token_search(t):
    return search.token_search(t.table("documents"), "doc_id", "text", 'the "License" of Apache, version', 100)


@query(
    """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT q.query, v.vec_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.e[i] AS DOUBLE))) /
 (sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score FROM embeddings v, q)
 SELECT query, vec_id, score, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS position FROM s) WHERE position <= 10"""
)
def vector_topk(t):
    vectors = t.table("embeddings")
    return search.nearest(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query(f"""WITH {MATTERS}, ranked AS (SELECT 'matter' AS kind, docket_id AS id, cost AS score, 0 AS scope FROM matters UNION ALL SELECT 'event', event_id, cost, 1 FROM ({EVENTS[8:-1]}))
 SELECT kind, id, score, scope FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC NULLS LAST, id) AS n FROM ranked) WHERE n <= 25 ORDER BY coalesce(score, 0) DESC, scope, id LIMIT 25""")
def federated_topk(t):
    shape = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("cost").alias("score"))
    return search.top_across([shape(t.matters, "matter", "docket_id"), shape(t.events, "event", "event_id")], 25)


# Versions, diffs, ledgers


@query(f"WITH {SNAPSHOTS} SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.n_chars AS old_chars, n.n_chars AS new_chars FROM old o FULL JOIN new n USING (doc_id) WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.n_chars != n.n_chars OR o.lang != n.lang OR o.source != n.source")
def snapshot_diff(t):
    return records.diff(t.old_snapshot, t.new_snapshot, "doc_id").select("doc_id", "change", F.col("old.n_chars").alias("old_chars"), F.col("new.n_chars").alias("new_chars"))


@query(f"""WITH {SNAPSHOTS}, ch AS (SELECT doc_id, o.doc_id AS a, n.doc_id AS b, o.n_chars AS oc, n.n_chars AS nc, coalesce(n.lang, o.lang) AS lang, coalesce(n.source, o.source) AS source FROM old o FULL JOIN new n USING (doc_id) WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.n_chars != n.n_chars)
 SELECT doc_id, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'modified' END AS change,
 CASE WHEN a IS NULL OR b IS NULL THEN '{{"lang":"' || lang || '","source":"' || source || '","n_chars":' || coalesce(nc, oc) || '}}' ELSE '{{"n_chars":{{"old":' || oc || ',"new":' || nc || '}}}}' END AS details FROM ch""")
def change_details_json(t):
    return records.change_details(records.diff(t.old_snapshot, t.new_snapshot, "doc_id"), ["lang", "source", "n_chars"])


@query(f"WITH {SNAPSHOTS}, m AS (SELECT doc_id FROM old o JOIN new n USING (doc_id) WHERE o.n_chars != n.n_chars) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM m) THEN 'Unvalidated' ELSE 'Validated' END AS validation_status FROM documents")
def revalidation_apply(t):
    held = t.table("documents").select("doc_id", F.lit("Validated").alias("validation_status"))
    return records.revalidate(held, records.diff(t.old_snapshot, t.new_snapshot, "doc_id"), "doc_id")


INCOMING = "src AS (SELECT o_custkey AS c_custkey, arg_max(nm, o_orderkey) FILTER (nm IS NOT NULL) AS c_name, arg_max(bal, o_orderkey) FILTER (bal IS NOT NULL) AS c_acctbal, arg_max(seg, o_orderkey) FILTER (seg IS NOT NULL) AS c_mktsegment FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_orderkey END AS nm, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS bal, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS seg FROM orders) GROUP BY 1)"


def incoming(t) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.table("orders").select(F.col("o_custkey").alias("c_custkey"), key, F.when(key % 3 == 0, F.concat(F.lit("C"), key.cast("string"))).alias("c_name"), F.when(key % 5 == 0, F.col("o_totalprice")).alias("c_acctbal"), F.when(key % 7 == 0, F.col("o_orderpriority")).alias("c_mktsegment"))
    return records.fold(rows, ["c_custkey"], "o_orderkey")


@query(f"WITH {INCOMING} SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM src")
def last_non_null_fold(t):
    return incoming(t).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query(f"WITH {INCOMING} SELECT c_custkey, coalesce(s.c_name, c.c_name) AS c_name, c.c_nationkey, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(s.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN src s USING (c_custkey)")
def merge_coalesce(t):
    return records.merge(t.table("customer"), incoming(t), ["c_custkey"])


@query(f"WITH {INCOMING} SELECT c_custkey, coalesce(s.c_name, c.c_name) AS c_name, c.c_nationkey, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment FROM customer c FULL JOIN src s USING (c_custkey)")
def merge_direct_cols(t):
    return records.merge(t.table("customer"), incoming(t), ["c_custkey"], direct=["c_mktsegment"])


@query(f"WITH {SERVICES} SELECT docket_id, service_type FROM services")
def bridge_insert_missing(t):
    return records.insert_missing(t.services.where("docket_id % 2 = 0"), t.services.where("docket_id % 2 != 0 OR docket_id % 3 = 0"), ["docket_id", "service_type"])


@query("SELECT conv_id, CAST(turn AS BIGINT) AS sort_order, text FROM conversations WHERE conv_id % 3 != 0 UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT), upper(role) FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 2 = 0")
def replace_children(t):
    rows = t.table("conversations")
    lists = rows.where("conv_id % 3 = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("p"))
    fresh = F.transform("p", lambda x: F.struct(F.upper(x["role"]).alias("text")))
    coming = lists.select("conv_id", F.when(F.col("conv_id") % 2 == 0, fresh).otherwise(F.array().cast("array<struct<text:string>>")).alias("items"))
    untouched = rows.where("conv_id % 3 = 1").select("conv_id", F.lit(None).cast("array<struct<text:string>>").alias("items")).distinct()
    children = rows.select("conv_id", F.col("turn").cast("int").alias("sort_order"), "text")
    return records.replace_children(children, coming.unionByName(untouched), "conv_id", "items").withColumn("sort_order", F.col("sort_order").cast("long"))


HASHED = "sha256(CAST(report_date AS VARCHAR) || '|' || section || '|' || CAST(docket_id AS VARCHAR))"


@query(f"WITH {EVENTS}, h AS (SELECT event_id, {HASHED} AS dedupe_hash FROM evs) SELECT dedupe_hash, min(event_id) AS event_id FROM h GROUP BY 1")
def event_dedupe_hash(t):
    hashed = t.events.select("event_id", s.digest("report_date", "section", "docket_id").alias("dedupe_hash"))
    return records.first_by_digest(hashed, "dedupe_hash", ["event_id"]).select("dedupe_hash", "event_id")


@query("SELECT DISTINCT user_id AS docket_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 != 0)")
def stub_matters(t):
    return records.stubs(t.events, t.matters.where("docket_id % 4 != 0"))


@query("WITH led AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90) SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.user_id = e.user_id AND led.event_type = e.event_type)")
def ledger_skip(t):
    rows = t.table("events")
    ledger = rows.select("user_id", "event_type", F.when(F.col("value") > 90, "succeeded").otherwise("failed").alias("status"))
    return records.unprocessed(rows.select("event_id", "user_id", "event_type"), ledger, ["user_id", "event_type"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def ledger_latest(t):
    return records.latest(t.table("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT sha256(text) AS text_sha256, min(doc_id) AS canonical, count(*) - 1 AS surplus FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_of(t):
    groups = t.table("documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.min("doc_id").alias("canonical"), (F.count("*") - 1).alias("surplus"))
    return groups.where("surplus > 0")


# Scalars and rules


@query("SELECT CAST(d AS DATE) AS date, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month_num, strftime(d, '%b') AS month_name, 'Q' || quarter(d) AS quarter, strftime(d, '%Y-%m') AS year_month, year(d) || ' Q' || quarter(d) AS year_quarter FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d)")
def date_dimension(t):
    return readers.date_dimension(t.spark, "1990-01-01", "2001-12-31")


RULES = ", ".join(f"({k}, '{r}', '{f}', '{e}', {n}, '{b}')" for k, (r, f, e, n, b) in enumerate(vocabulary.DEADLINE_RULES))


@query(f"""WITH {MATTERS}, rules(position, rule_id, fam, trigger_event, days, statute) AS (VALUES {RULES}), m AS (SELECT docket_id, filed, CASE docket_id % 3 WHEN 0 THEN 'CON' WHEN 1 THEN 'DET' ELSE 'DET' END AS fam FROM matters)
 SELECT docket_id, rule_id, filed + days AS due_date, statute AS basis_statute FROM m JOIN rules USING (fam) WHERE trigger_event = 'Hearing officer appointed'""")
def deadlines_join(t):
    family = F.when(F.col("docket_id") % 3 == 0, "CON").when(F.col("docket_id") % 3 == 1, "DET").otherwise("DET-EQT")
    rules = F.broadcast(vocabulary.deadline_rules(t.spark).where("trigger_event = 'Hearing officer appointed'"))
    due = t.matters.withColumn("base", s.base_family(family)).join(rules, F.col("base") == F.col("docket_family"))
    return due.select("docket_id", "rule_id", F.date_add("filed", F.col("offset_days")).alias("due_date"), "basis_statute")


@query(f"WITH {MATTERS}, e AS (SELECT docket_id, date_diff('day', filed, DATE '2001-08-01') AS elapsed FROM matters) SELECT docket_id, elapsed, CASE WHEN elapsed < 120 THEN 1 WHEN elapsed < 150 THEN 2 WHEN elapsed < 240 THEN 3 ELSE 4 END AS stage FROM e")
def proceeding_stage_calc(t):
    rows = t.matters.select("docket_id", F.date_diff(F.lit("2001-08-01").cast("date"), "filed").cast("long").alias("elapsed"))
    return rows.withColumn("stage", s.elapsed_stage("elapsed"))


@query("""WITH RECURSIVE h(id, name, pos, v) AS (SELECT c_custkey, c_name, 1, CAST(0 AS BIGINT) FROM customer UNION ALL SELECT id, name, pos + 1, (v * 31 + ord(name[pos])) % 4294967296 FROM h WHERE pos <= length(name))
 SELECT id AS c_custkey, abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END) % 1000 / 1000 AS seed FROM h WHERE pos = length(name) + 1""")
def precedent_seed_bucket(t):
    return t.table("customer").select("c_custkey", s.seed_of("c_name").alias("seed"))


FAMILIES = {"CON": "CON", "DET": "DET", "LNR": "DET", "DET-EQT": "DET-EQT", "DET-ASC": "DET-ASC", "LNR-ASC": "LNR-ASC", "LNR-EQT": "LNR-EQT", "DETROIT": "CON", "GA": "CON", "LNREQT": "LNR-EQT", "DETASC": "DET-ASC"}
SEPARATORS = ["-", " ", "_", ".", "–", " - "]


def picked(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def literal(values) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in values) + "]"


@query(f"SELECT p_partkey, {literal(FAMILIES.values())}[p_partkey % {len(FAMILIES)} + 1] AS family FROM part")
def family_classify(t):
    """Each prefix with each separator, in either case, before a year and a number."""
    key = F.col("p_partkey")
    parted = F.replace(picked(list(FAMILIES), key), F.lit("-"), picked(SEPARATORS, F.floor(key / 11)))
    raw = F.concat(parted, picked(SEPARATORS, F.floor(key / 66)), F.lit("2024"), key.cast("string"))
    return t.table("part").select("p_partkey", s.classify_family(F.when(key % 2 == 0, raw).otherwise(F.lower(raw))).alias("family"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 10 WHEN 0 THEN o_orderkey * 1000000 + 500000 WHEN 1 THEN o_orderkey * 1000 + 0.25 WHEN 2 THEN o_orderkey WHEN 4 THEN o_orderkey * 1000 WHEN 5 THEN o_orderkey * 1000000 + 125000
 WHEN 6 THEN o_orderkey WHEN 7 THEN o_orderkey * 1000000 WHEN 8 THEN o_orderkey + 0.1 WHEN 9 THEN o_orderkey * 1000000000 + 500000000 END AS DECIMAL(18, 2)) AS amount FROM orders""")
def money_parse(t):
    """Scaled, after a dollar sign and bare amounts, halves to even, and texts that hold none."""
    shapes = ["about ${}.5 million", "${},000.25", "{}", None, "$ {} thousand", "{}.125M in all", "Cost: ${}.005", "$7 now, {} Million later", " {}.10 ", "{}.5B"]
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    none = F.when(key % 20 < 10, F.lit("n/a")).otherwise(F.concat(text, F.lit(" miles")))
    raw = F.coalesce(F.replace(picked(shapes, key), F.lit("{}"), text), none)
    return t.table("orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", s.money("raw").alias("amount"))


def spelt(value: str) -> list[str]:
    """Ways in which a code may be written, and one that is none."""
    wide = "  ".join(value.split(" "))
    return [value, f" {wide.upper()} ", wide.lower().replace("/", " / "), value.replace("—", "-").replace("–", "—"), value + "x"]


WAYS = 5


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % {WAYS} < 4 THEN {literal(vocabulary.SERVICE_TYPES)}[(o_orderkey // {WAYS}) % {len(vocabulary.SERVICE_TYPES)} + 1] END AS service,
 CASE WHEN o_orderkey % {WAYS} < 4 THEN {literal(vocabulary.COUNTIES)}[(o_orderkey // {WAYS}) % {len(vocabulary.COUNTIES)} + 1] END AS county FROM orders""")
def vocab_match(t):
    """Every service type and county, each in five spellings, one of them wrong."""
    key = F.col("o_orderkey")
    at, way = F.floor(key / WAYS), key % WAYS
    services = F.get(picked_list([spelt(x) for x in vocabulary.SERVICE_TYPES], at), way.cast("int"))
    name = picked(vocabulary.COUNTIES, at)
    county = F.when(way == 0, name).when(way == 1, F.concat(F.upper(name), F.lit(" COUNTY "))).when(way == 2, F.replace(F.lower(name), F.lit(" "), F.lit("-"))).when(way == 3, F.replace(name, F.lit(" "), F.lit(""))).otherwise(F.concat(name, F.lit("x")))
    raw = t.table("orders").select("o_orderkey", services.alias("s"), county.alias("c"))
    return raw.select("o_orderkey", s.match_vocabulary("s", vocabulary.SERVICE_TYPES).alias("service"), s.match_county("c").alias("county"))


def picked_list(values, at):
    return F.element_at(F.array(*[F.array(*map(F.lit, v)) for v in values]), (at % len(values) + 1).cast("int"))


@query("SELECT o_orderkey AS row_number, CASE WHEN o_orderkey % 5 = 0 THEN 'year_filed' ELSE 'bed_count' END AS field, CASE WHEN o_orderkey % 5 = 0 THEN 'not a year' ELSE 'not a number' END AS message, 'x' || o_orderkey AS raw_value FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def reject_first_error(t):
    key = F.col("o_orderkey")
    bad = F.concat(F.lit("x"), key.cast("string"))
    rows = t.table("orders").select(key.alias("row_number"), F.when(key % 5 == 0, bad).otherwise("1999").alias("year_filed"), F.when(key % 7 == 0, bad).otherwise("12").alias("bed_count"))
    checks = [(c, matching.unparsed(c, F.expr(f"try_cast({c} AS INT)")), said) for c, said in (("year_filed", "not a year"), ("bed_count", "not a number"))]
    return matching.first_error(rows, checks)[1]


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_name END, CASE WHEN p_size > 20 THEN p_brand END, p_type) AS title FROM part")
def title_fallback(t):
    return t.table("part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 40, F.col("p_name")), F.when(F.col("p_size") > 20, F.col("p_brand")), "p_type").alias("title"))


@query(f"WITH {MATTERS}, {FILINGS} SELECT f.entry_id, greatest(f.doc_date, CASE WHEN m.docket_id % 2 = 0 THEN m.filed END) AS updated FROM filings f LEFT JOIN matters m USING (docket_id)")
def greatest_updated_at(t):
    rows = t.filings.join(t.matters.select("docket_id", "filed"), "docket_id", "left")
    return rows.select("entry_id", F.greatest("doc_date", F.when(F.col("docket_id") % 2 == 0, F.col("filed"))).alias("updated"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def document_snippet(t):
    return t.table("documents").select("doc_id", s.snippet("text").alias("snippet"))


@query("""SELECT o_orderkey, CASE WHEN d // 365 <= 0 THEN m || CASE WHEN m = 1 THEN ' month' ELSE ' months' END ELSE (d // 365) || CASE WHEN d // 365 = 1 THEN ' yr' ELSE ' yrs' END || CASE WHEN m > 0 THEN ' ' || m || ' mo' ELSE '' END END AS age
 FROM (SELECT o_orderkey, d, CAST(round_even((d % 365) / 30, 0) AS INT) AS m FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS d FROM orders))""")
def duration_label(t):
    days = t.table("orders").select("o_orderkey", F.date_diff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate")).alias("d"))
    return days.select("o_orderkey", s.duration("d").alias("age"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, sha256(html) AS html_sha256 FROM pages")
def page_identity(t):
    return t.table("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.sha2("html", 256).alias("html_sha256"))


# Python functions: checked by row count here, by fixed facts and brute force in the tests


@query()
def html_text(t):
    return t.table("pages").select("page_id", texts.html_text("html").alias("text"))


@query(
    """SELECT o_orderkey, ['CON-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), 'DET-EQT-2024-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), 'FULTON-12'] AS dockets,
 ['CON', 'DET', 'COUNTY'] AS kinds, ['CON-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), 'CON' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')] AS variants, 'CON-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS docket FROM orders"""
)
def docket_extract(t):
    key = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    text = F.concat(F.lit("See CON"), key, F.lit(" and det-eqt2024-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(", also Fulton-12."))
    found = t.table("orders").select("o_orderkey", dockets.extract_dockets(text).alias("d"), dockets.normalize_docket(F.concat(F.lit("Docket No. con "), key)).alias("docket"))
    return found.select("o_orderkey", F.col("d.canonical").alias("dockets"), F.col("d.kind").alias("kinds"), F.col("d")[0]["variants"].alias("variants"), "docket")


@query()
def fuzzy_crosswalk(t):
    names = t.filings.join(t.table("part").select(F.col("p_partkey").alias("partkey"), "p_name"), "partkey")
    index = names.select("docket_id", "entry_id", F.col("p_name").alias("name"), "pages")
    files = names.select(F.col("entry_id").alias("file_id"), "docket_id", F.concat(F.col("docket_id").cast("string"), F.lit(" "), F.regexp_replace("p_name", "a", "e")).alias("stem"), "pages")
    return matching.resolve_files(files, index)


@query()
def axis_fold(t):
    axis = F.when(F.col("section") == "error", "Masterfile").when(F.col("section") == "signup", "Order")
    codes = F.when(F.col("section") == "purchase", F.array(F.lit("3.1"))).otherwise(F.array().cast("array<string>"))
    rows = t.events.select(F.col("docket_id").alias("entry_id"), F.col("event_id").alias("row_number"), axis.alias("axis2"), codes.alias("codes"))
    state = t.events.select(F.col("docket_id").alias("entry_id")).distinct().select("entry_id", (F.col("entry_id") % 5 == 0).alias("closed"), (F.col("entry_id") % 7 == 0).alias("coded"))
    return matching.fold_axes(rows, state)


@query(
    f"""WITH {MATTERS} SELECT docket_id AS report_id, CASE final_outcome WHEN 'Approved' THEN 'APPROVED' WHEN 'Denied' THEN 'DENIED' ELSE 'PENDING_APPLICATION' END AS section,
 'CON-2001' || lpad(CAST(docket_id % 1000 AS VARCHAR), 3, '0') AS docket, applicant, 'Fulton' AS county, 'Renovation.' AS project_description, CAST(docket_id * 1000 AS DECIMAL(18, 2)) AS cost, filed AS filing_date, filed + 5 AS decision_date FROM matters"""
)
def weekly_report_parse(t):
    """Each matter as one entry of a report."""
    sections = F.element_at(F.create_map(*[F.lit(x) for x in ("Approved", "Recently Approved Projects", "Denied", "Recently DeniedApplications", "Pending", "Pending Review Applications")]), F.col("final_outcome"))
    lead = F.concat(F.lit("2001-"), F.lpad((F.col("docket_id") % 1000).cast("string"), 3, "0"), F.lit(" "), F.col("applicant"), F.lit(" (Fulton County)"))
    body = F.concat(F.lit("Project Description: Renovation. Cost: $"), F.col("docket_id").cast("string"), F.lit(",000 DateFiled: "), F.date_format("filed", "M/d/yyyy"))
    judged = F.concat(F.lit("Determination: Approved, "), F.date_format(F.date_add("filed", 5), "MMMM d, yyyy"), F.lit(" 30thDay Deadline: none"))
    found = reports.report_events(t.matters.select(F.col("docket_id").alias("report_id"), F.concat_ws("\n", sections, lead, body, judged).alias("text")), "report_id", "text")
    return found.select("report_id", "section", F.col("docket_id").alias("docket"), "applicant", "county", "project_description", "cost", "filing_date", "decision_date")



from docketry.plans import indexes, intake, reading, windows  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "indexes", "intake", "reading", "windows"]
