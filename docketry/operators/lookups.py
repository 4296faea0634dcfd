"""Looking records up: dockets in any form, document filters, scopes and operators of queries, watchlists and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import dockets
from docketry.operators import filters

# Parameters of the document list by (column, kind).
DOCUMENT_FILTERS = {
    "entry_id": ("entry_id", "eq"),
    "docket_id": ("docket_id", "eq"),
    "file_name": ("file_name", "like"),
    "source_path": ("source_path", "like"),
    "doc_type": ("doc_type", "eq"),
    "decision_level": ("decision_level", "eq"),
    "phase": ("phase", "eq"),
    "outcome": ("outcome", "eq"),
    "validation_status": ("validation_status", "eq"),
    "decision_maker": ("decision_maker", "like"),
    "doc_date_from": ("doc_date", "gte"),
    "doc_date_to": ("doc_date", "lte"),
    "page_count_min": ("page_count", "gte"),
    "page_count_max": ("page_count", "lte"),
    "repo_created_from": ("repo_date_created", "gte"),
    "repo_created_to": ("repo_date_created", "lte"),
    "repo_modified_from": ("repo_date_modified", "gte"),
    "repo_modified_to": ("repo_date_modified", "lte"),
    "ocr_confidence_min": ("ocr_confidence", "gte"),
    "ocr_confidence_max": ("ocr_confidence", "lte"),
    "validated_by": ("validated_by", "eq"),
    "validated_from": ("validated_date", "gte"),
    "validated_to": ("validated_date", "lte"),
    "party": ("parties", "like"),
    "template_name": ("template_name", "eq"),
    "ocr_status": ("ocr_status", "eq"),
    "duplicate_of": ("duplicate_of", "eq"),
}
# Parameters of the matter list by (column, kind), those that ask a child table by its column, and sorted columns.
MATTER_FILTERS = {
    "docket_id": ("docket_id", "eq"),
    "applicant": ("applicant", "like"),
    "facility": ("facility", "like"),
    "matter_type": ("matter_type", "eq"),
    "action_type": ("action_type", "eq"),
    "county": ("county", "eq"),
    "service_area": ("service_area", "like"),
    "bed_count_min": ("bed_count", "gte"),
    "bed_count_max": ("bed_count", "lte"),
    "year_filed": ("year_filed", "eq"),
    "final_outcome": ("final_outcome", "eq"),
    "final_decision_date_from": ("final_decision_date", "gte"),
    "final_decision_date_to": ("final_decision_date", "lte"),
    "highest_review_level": ("highest_review_level", "eq"),
}
MATTER_CHILDREN = {"service_type": "service_type", "phase": "phase", "docket_variant": "variant"}
MATTER_SORTS = ["docket_id", "applicant", "facility", "matter_type", "action_type", "county", "bed_count", "year_filed", "final_outcome", "final_decision_date", "highest_review_level", "created_at", "updated_at"]
MATTER_TEXTS = ["applicant", "facility", "service_area"]
DOCUMENT_TEXTS = ["title", "file_name", "decision_maker"]
# Docket types of a search scope; null is all.
SCOPES = {"all": None, "CON": ["CON"], "DET": ["DET", "DET-EQT", "DET-ASC"], "equipment": ["DET-EQT", "LNR-EQT"], "asc": ["DET-ASC", "LNR-ASC"]}
# Order of courts in a result list, others last.
COURTS = {"Ga. Ct. App.": 1, "Ga. Sup. Ct.": 2, "Superior Court": 3, "OSAH": 4}
# Events or watches of one folder that are paired at once, and pairs of it that one task unfolds.
BLOCK, PAIRS = 512, 1 << 23


def matters_wanted(matters: DataFrame, children: Mapping[str, DataFrame], wanted: Mapping[str, object]) -> DataFrame:
    """Matters for which all wanted parameters hold. ``children`` has the table (docket_id, column) of each parameter of
    ``MATTER_CHILDREN``; ``completeness_flag`` asks the JSON array ``completeness_flags``. Nulls ask nothing, unknown parameters
    raise ``KeyError``."""
    own = {k: v for k, v in wanted.items() if k not in MATTER_CHILDREN and k != "completeness_flag"}
    rows = filters.where_all(matters, MATTER_FILTERS, own)
    for name, column in MATTER_CHILDREN.items():
        if wanted.get(name) is not None:
            rows = filters.having_child(rows, children[name], "docket_id", column, wanted[name])
    flag = wanted.get("completeness_flag")
    return filters.with_flag(rows, "completeness_flags", flag) if flag is not None else rows


def matters_page(matters: DataFrame, children: Mapping[str, DataFrame], wanted: Mapping[str, object], q: str | None = None, ranks: DataFrame | None = None, sort: str | None = None, limit: int = filters.LIMIT, offset: int = 0) -> DataFrame:
    """One page of the matter list. A text query keeps the matters that ``ranks`` (docket_id, score) of a full-text search has, best
    first unless ``sort`` says otherwise; without ranks those whose texts contain it."""
    rows = matters_wanted(matters, children, wanted)
    if q and q.strip() and ranks is None:
        rows = filters.like_any(rows, [c for c in MATTER_TEXTS if c in matters.columns], q.strip())
    elif q and q.strip():
        rows = rows.join(ranks.select("docket_id", "score"), "docket_id")
        if not sort:
            return filters.page(rows.orderBy(F.desc("score"), "docket_id"), limit, offset)
    sorts = {c: c for c in MATTER_SORTS if c in matters.columns}
    return filters.page(filters.order(rows, sorts, sort or "docket_id", ["docket_id"]), limit, offset)


def documents_page(documents: DataFrame, wanted: Mapping[str, object], q: str | None = None, sort: str = "entry_id", limit: int = filters.LIMIT, offset: int = 0) -> DataFrame:
    """One page of the documents for which all wanted parameters hold and, with ``q``, one of the texts contains it."""
    rows = filters.where_all(documents, DOCUMENT_FILTERS, wanted)
    rows = filters.like_any(rows, [c for c in DOCUMENT_TEXTS if c in documents.columns], q.strip()) if q and q.strip() else rows
    sorts = {c: c for c in documents.columns}
    return filters.page(filters.order(rows, sorts, sort, ["entry_id"]), limit, offset)


def resolve_dockets(asked: DataFrame, matters: DataFrame, variants: DataFrame, raw: str = "raw") -> DataFrame:
    """``asked`` with docket_id, the matter that a text names in any form: by canonical form or as it is among the matters,
    else among variants (docket_id, variant), of several the smallest; null where none is."""
    own = asked.withColumn("__names", F.array_distinct(F.array_compact(F.array(dockets.normalize_docket(raw), F.trim(raw)))))
    named = own.select(raw, F.explode("__names").alias("__name")).distinct()
    exact = named.join(matters.select(F.col("docket_id").alias("__name"), F.col("docket_id").alias("__a")), "__name").groupBy(raw).agg(F.min("__a").alias("__a"))
    among = named.join(variants.select(F.col("variant").alias("__name"), F.col("docket_id").alias("__b")), "__name").groupBy(raw).agg(F.min("__b").alias("__b"))
    both = asked.join(exact, raw, "left").join(among, raw, "left")
    return both.withColumn("docket_id", F.coalesce("__a", "__b")).drop("__a", "__b")


def in_scope(df: DataFrame, scope: str, column: str) -> DataFrame:
    """Rows of a scope's docket types; unknown scopes raise ``KeyError``."""
    types = SCOPES[scope]
    return df if types is None else df.where(F.col(column).isin(types))


def advanced(words: str = "", phrase: str = "", any_words: str = "", county: str = "", facets: Mapping[str, str] | None = None) -> tuple[str, dict[str, list[str]]]:
    """(query text, facets): all words, the phrase in quotes, any words and the county, blanks left out."""
    parts = [words.strip(), f'"{phrase.strip()}"' if phrase.strip() else "", any_words.strip(), county.strip()]
    return " ".join(p for p in parts if p), {name: [value] for name, value in (facets or {}).items() if value}


def typed_query(df: DataFrame, query: str, column: str, text: str, key: str, k: int = 100) -> DataFrame:
    """(key, score): ``docket-type:X`` takes the rows of that type, anything else searches words of the text."""
    from docketry.operators.search import token_search

    if query.strip().lower().startswith("docket-type:"):
        wanted = query.strip().split(":")[1].strip().upper()
        return df.where(F.col(column) == wanted).select(key, F.lit(0).alias("score")).orderBy(key).limit(k)
    return token_search(df, key, text, query, k)


def ranked(df: DataFrame, how: str, score: str, day: str, court: str, key: str, k: int = 100) -> DataFrame:
    """The first ``k`` rows with ``rank`` from 1: by relevance, date-desc, date-asc or court level."""
    from docketry.functions.scalars import lookup

    level = F.coalesce(lookup(F.col(court), COURTS), F.lit(9))
    order = {"relevance": [F.desc_nulls_last(score)], "date-desc": [F.desc_nulls_last(day)], "date-asc": [F.asc_nulls_last(day)], "court": [level.asc()]}[how]
    top = df.orderBy(*order, key).limit(k)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order, key)))


def active_only(df: DataFrame, every: bool = False, active: str = "active") -> DataFrame:
    return df if every else df.where(F.coalesce(F.col(active).cast("boolean"), F.lit(False)))


def changes(log: DataFrame, since: object = None, change: str | None = None, scoped: bool | None = None) -> DataFrame:
    """Entries of the change log at or after a time, of one type, within scope or not; null asks nothing."""
    terms = [F.col("detected_at") >= since] if since is not None else []
    terms += [F.col("change_type") == change] if change is not None else []
    terms += [F.col("in_scope") == scoped] if scoped is not None else []
    return log.where(reduce(and_, terms)) if terms else log


def meetings(events: DataFrame, watchlist: DataFrame, first: bool = False) -> DataFrame:
    """Events joined with the active watches (watch_id, docket_id, entry_id, path_prefix, active) that they meet: same docket,
    same entry, or a path that begins with the prefix; once for each way they meet, or the ``first`` way alone. The watchlist
    is the static side of a stream."""
    live = active_only(watchlist).select("watch_id", "path_prefix", *[F.col(c).alias(f"__{c}") for c in ("docket_id", "entry_id")])
    equal = lambda c: F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))

    def told(met: DataFrame, *before: str) -> DataFrame:
        new = met.where(~reduce(or_, map(equal, before))) if first and before else met
        return new.select(*events.columns, "watch_id")

    one = lambda c, *before: told(events.join(live.where(F.col(f"__{c}").isNotNull()), F.col(c) == F.col(f"__{c}")), *before)
    out = one("docket_id").unionByName(one("entry_id", "docket_id"))
    # prefixes are whole folders: an event's path meets them among its own ancestors, so this is an equi-join too
    if "path" in events.columns:
        parts = F.split("path", "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        named = events.withColumn("__prefix", F.explode(F.array_distinct(prefixes)))
        own = live.where(F.col("path_prefix").isNotNull()).select("watch_id", "__docket_id", "__entry_id", F.rtrim(F.col("path_prefix"), F.lit("/")).alias("__prefix"))
        if first:  # watches of a folder alone meet in no other way, and by far the most pairs are theirs
            alone = F.col("__docket_id").isNull() & F.col("__entry_id").isNull()
            out = out.unionByName(in_blocks(named, own.where(alone).select("__prefix", "watch_id")).select(*events.columns, "watch_id"))
            own = own.where(~alone)
        out = out.unionByName(told(named.join(own, "__prefix"), "docket_id", "entry_id"))
    return out


def in_blocks(events: DataFrame, watches: DataFrame) -> DataFrame:
    """Events joined with ``watches`` (__prefix, watch_id) by ``__prefix``. A prefix is dealt in parts of about ``PAIRS`` pairs, by
    events, and there either side's rows are put in blocks of ``BLOCK`` or so (watches of just that, so that their numbers come again at the same bit). Blocks are joined, and each pair of them is unfolded where it
    lies: event after event with the same few watches. What is joined is small, and pairs in this order take a small part of a byte
    each where they are stored in columns."""
    conf = events.sparkSession
    tasks = max(int(conf.conf.get("spark.sql.shuffle.partitions")), conf.sparkContext.defaultParallelism)
    of = events.groupBy("__prefix").agg(F.count("*").alias("__many"))
    shares = watches.groupBy("__prefix").agg(F.count("*").alias("__live")).join(of, "__prefix").withColumn("__parts", F.ceil(F.col("__many") * F.col("__live") / PAIRS))

    def blocks(df: DataFrame, key: str, size: int, many: Column, value: Column, name: str) -> DataFrame:
        numbered = df.withColumn("__block", F.pmod(F.xxhash64(key, F.lit(BLOCK)), F.ceil(many / size)))
        dealt = numbered.repartition(tasks, "__prefix", "__part")
        return dealt.groupBy("__prefix", "__part", "__block").agg(F.collect_list(value).alias(name)).drop("__block")

    of_events = events.join(shares, "__prefix").withColumn("__part", F.pmod(F.xxhash64("event_id"), "__parts"))
    of_watches = watches.join(shares, "__prefix").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    own = F.struct(*[c for c in events.columns if c != "__prefix"])
    lists = blocks(of_watches, "watch_id", 16 * BLOCK, F.col("__live"), F.col("watch_id"), "__all")
    starts = F.sequence(F.lit(1), F.size("__all"), F.lit(BLOCK))
    few = lists.select("__prefix", "__part", F.explode(F.transform(starts, lambda k: F.slice("__all", k, BLOCK))).alias("__watches"))
    pairs = blocks(of_events, "event_id", BLOCK, F.col("__many") / F.col("__parts"), own, "__events").join(few, ["__prefix", "__part"])
    unfolded = pairs.select("__watches", F.explode("__events").alias("__e")).select("__e", F.explode("__watches").alias("watch_id"))
    return unfolded.select("__e.*", "watch_id")


def watched(events: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Events with each of the watches that they meet, once. For a stream there is ``streaming.incremental.alerts``.
    Each pair is told by the first way it meets, so pairs, which may be far more than events, are not shuffled; those of
    ids that repeat are, since several rows may tell them."""
    if "event_id" not in events.columns:
        return meetings(events, watchlist).dropDuplicates(["watch_id"])
    conf = events.sparkSession
    tasks = max(int(conf.conf.get("spark.sql.shuffle.partitions")), conf.sparkContext.defaultParallelism)

    def parted(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        rows = df.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
        return rows.where("__n = 1").drop("__n"), rows.where("__n > 1").drop("__n")

    (single, repeated), (watches, doubled) = parted(events.repartition(tasks, "event_id"), "event_id"), parted(active_only(watchlist), "watch_id")
    often = meetings(repeated, watchlist).unionByName(meetings(single, doubled)).dropDuplicates(["event_id", "watch_id"])
    return meetings(single, watches, True).unionByName(often)


def matching_topics(topics: DataFrame, text: str, key: str = "topic_key", title: str = "title", children: str = "children") -> DataFrame:
    """Topics whose title or key, or a child's, contains the text."""
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return topics.where(has(F.col(title)) | has(F.col(key)) | F.coalesce(F.exists(children, lambda x: has(x["title"]) | has(x["key"])), F.lit(False)))


def status_bucket(found: Column) -> Column:
    """granted, denied, pending or other."""
    return F.when(found.isin("Approved", "Issued"), "granted").when(found == "Denied", "denied").when(found == "Pending", "pending").otherwise("other")


def in_tab(df: DataFrame, column: str, tab: str, tabs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of a tab: ``all`` is everything; unknown tabs raise ``KeyError``."""
    return df if tab == "all" else df.where(F.col(column).isin(list(tabs[tab])))


def one_of(value: str, allowed: Sequence[str]) -> str:
    """The value, if it is allowed; else ``ValueError``, before any plan is made."""
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {', '.join(allowed)}")
    return value
