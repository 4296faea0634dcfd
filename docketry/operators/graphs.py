"""Citations, cross-references, topics and nested roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.scalars import lookup
from docketry.operators.staging import settle
from docketry.sources.vocabulary import LEVELS, TREATMENT_LEVELS


def level_of(treatment: Column) -> Column:
    """Level of a treatment; null and unknown ones are neutral."""
    return F.coalesce(lookup(treatment, TREATMENT_LEVELS), F.lit("neutral"))


def citation_flags(citations: DataFrame, key: str) -> DataFrame:
    """(key, level, n): four rows for each cited record, levels without citations having 0."""
    counts = citations.withColumn("level", level_of(F.col("treatment"))).groupBy(key).pivot("level", LEVELS).agg(F.count(F.lit(1)))
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.coalesce(F.col(x), F.lit(0)).cast("long").alias("n")) for x in LEVELS]))
    return counts.select(key, rows.alias("r")).select(key, "r.level", "r.n")


def first_citation(citations: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The first value of each key by ``order``, of rows without nulls in the value or in what they are ordered by."""
    known = reduce(and_, [F.col(c).isNotNull() for c in (value, *order)])
    return citations.groupBy(key).agg(F.min_by(value, F.when(known, F.struct(*order))).alias(value))


# How a statute's kind is cited, and labels of the counts in front of a citator report.
STATUTE_CITES = {"OCGA": "Ga. Code Ann.", "RULE": "Ga. Comp. R. & Regs."}
FLAGS = [("Citing", None), ("Positive", "positive"), ("Cautionary", "caution"), ("Negative", "negative")]
REPORT = "entry_id part position label count kind target title cite pinpoint treatment level badge docket snippet key_number".split()


def citator_report(citations: DataFrame, documents: DataFrame, matters: DataFrame, opinions: DataFrame, topics: DataFrame, statutes: DataFrame, reporters: DataFrame) -> DataFrame:
    """The citator page of every document, as rows (``REPORT``): four ``flag`` rows with counts, one ``citing`` row for each citation
    of it, one ``authority`` row for each that it makes. Positions are flags' places and citations' ids. Rows instead of
    nested lists, since a document may be cited by any number of others; ``nested`` makes one page of few documents.

    citations: citation_id, citing_entry_id, cited_entry_id, cited_statute_id, cited_external, treatment, pinpoint, snippet, topic_id;
    documents: entry_id, docket_id, title; matters: docket_id, docket_family; opinions: entry_id, court_docket_no;
    topics: topic_id, key_number; statutes: statute_id, kind, citation_label, title; reporters: entry_id, cite_id, citation.
    """

    def report(df: DataFrame, part: str, **columns) -> DataFrame:
        kinds = {"position": "bigint", "count": "bigint"}
        return df.select(*[(F.lit(part) if c == "part" else columns.get(c, F.lit(None))).cast(kinds.get(c, "string")).alias(c) if c != "entry_id" else F.col("entry_id") for c in REPORT])

    first = first_citation(reporters, "entry_id", "citation", "cite_id")
    level = level_of(F.col("treatment"))
    counts = citations.groupBy(F.col("cited_entry_id").alias("entry_id")).agg(F.count("*").alias("citing"), *[F.count_if(level == x).alias(x) for _, x in FLAGS if x])
    flags = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(label).alias("label"), F.coalesce(F.col(x or "citing"), F.lit(0)).alias("n")) for k, (label, x) in enumerate(FLAGS)])
    flagged = documents.select("entry_id").join(counts, "entry_id", "left").select("entry_id", F.explode(flags).alias("f"))

    citing = documents.select(F.col("entry_id").alias("citing_entry_id"), "docket_id", F.col("title").alias("case_title"))
    named = citations.where("cited_entry_id IS NOT NULL").withColumn("entry_id", F.col("cited_entry_id")).join(documents.select("entry_id"), "entry_id", "left_semi").join(citing, "citing_entry_id")
    named = named.join(matters.select("docket_id", "docket_family"), "docket_id", "left").join(topics, "topic_id", "left")
    named = named.join(opinions.withColumnRenamed("entry_id", "citing_entry_id"), "citing_entry_id", "left").join(first.withColumnRenamed("entry_id", "citing_entry_id"), "citing_entry_id", "left")

    case = documents.select(F.col("entry_id").alias("cited_entry_id"), F.col("title").alias("case_title"))
    made = citations.withColumn("entry_id", F.col("citing_entry_id")).join(documents.select("entry_id"), "entry_id", "left_semi")
    is_case, is_statute = F.col("cited_entry_id").isNotNull(), F.coalesce(F.col("cited_statute_id") != "", F.lit(False))
    statute = statutes.select(F.col("statute_id").alias("cited_statute_id"), F.col("kind").alias("statute_kind"), "citation_label", F.col("title").alias("statute_title"))
    # each kind meets its own table alone: rows without a key would all go to one task of the join
    of_cases = made.where(is_case).join(case, "cited_entry_id", "left").join(first.withColumnRenamed("entry_id", "cited_entry_id"), "cited_entry_id", "left")
    of_statutes = made.where(~is_case & is_statute).join(statute, "cited_statute_id", "left")
    made = of_cases.unionByName(of_statutes, allowMissingColumns=True).unionByName(made.where(~is_case & ~is_statute), allowMissingColumns=True)
    either = lambda case, statute, other: F.when(is_case, case).when(is_statute, statute).otherwise(other)
    title = F.coalesce(F.concat("citation_label", F.lit(" — "), "statute_title"), "citation_label", "statute_title")
    authorities = {
        "position": F.col("citation_id"),
        "kind": either(F.lit("case"), F.lit("stat"), F.lit("external")),
        "target": either(F.col("cited_entry_id").cast("string"), F.col("cited_statute_id"), F.lit(None)),
        "title": either(F.col("case_title"), title, F.col("cited_external")),
        "cite": either(F.col("citation"), lookup(F.col("statute_kind"), STATUTE_CITES), F.lit(None)),
        "pinpoint": F.col("pinpoint"),
    }
    cases = {
        "position": F.col("citation_id"),
        "target": F.col("citing_entry_id"),
        "title": F.col("case_title"),
        "cite": F.col("citation"),
        "level": level,
        "badge": F.col("docket_family"),
        "docket": F.coalesce("court_docket_no", F.col("docket_id").cast("string")),
    } | {c: F.col(c) for c in ("pinpoint", "treatment", "snippet", "key_number")}
    return report(flagged, "flag", position=F.col("f.position"), label=F.col("f.label"), count=F.col("f.n")).unionByName(report(named, "citing", **cases)).unionByName(report(made, "authority", **authorities))


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(from, to) of edges read in either direction, each pair once."""
    return edges.select(F.col(a).alias("source"), F.col(b).alias("target")).union(edges.select(b, a)).distinct()


def nested(parents: DataFrame, key: str, **children: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Parents with each child table as a sorted array of structs; parents without children have empty arrays."""
    out = parents
    for name, (rows, columns) in children.items():
        lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def joined(rows: DataFrame, key: str, value: str, separator: str = ";") -> DataFrame:
    """Distinct values of each key in order, as one text."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(value))


def tree(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, level, path): every node under its root; nodes whose parent is missing are roots. Each round joins every
    node with what its ancestor knows, so depth doubles and a tree of any depth takes a few rounds. Nodes that lead into
    a circle have no root: their root, level and path are null."""
    known = nodes.select(F.col(key).alias("__p"))
    linked = nodes.select(key, F.col(parent).alias("__up")).join(known, F.col("__up") == F.col("__p"), "left")
    name = F.col(key).cast("string")
    state = settle(linked.select(key, F.coalesce("__p", key).alias("at"), F.when(F.col("__p").isNull(), 0).otherwise(1).alias("level"), F.when(F.col("__p").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), name)).alias("path"), F.col("__p").isNull().alias("done")))
    rounds, most = 0, max(1, state.count()).bit_length() + 1
    while rounds < most and not state.where("NOT done").isEmpty():
        above = state.select(F.col(key).alias("at"), F.col("at").alias("to"), F.col("level").alias("more"), F.col("path").alias("front"), F.col("done").alias("ends"))
        far = state.where("NOT done").join(above, "at")
        moved = far.select(key, F.col("to").alias("at"), (F.col("level") + F.col("more")).alias("level"), F.concat("front", "path").alias("path"), F.col("ends").alias("done"))
        state = settle(state.where("done").unionByName(moved))
        rounds += 1
    found = lambda c: F.when(F.col("done"), c)
    return state.select(key, found(F.col("at")).alias("root"), found(F.col("level")).alias("level"), found(F.concat(F.col("at").cast("string"), "path")).alias("path"))
