"""Rules for incoming rows: typed records or one reject each, tags on four axes, links to what exists, run statistics,
and what is to be done with a file. Rejects have row_number, field, message and raw_value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import dockets
from docketry.functions import scalars as s
from docketry.operators.matching import first_error, unparsed
from docketry.sources import vocabulary as v

# Columns of a tag export by kind, in the order in which their errors count.
TEXTS = ["applicant", "facility", "service_area", "contact_officer", "project_description", "batching_cycle", "title", "file_name", "docview_url", "decision_maker", "source_path", "template_name", "ocr_status", "validated_by"]
LISTS = ["docket_variants", "parties", "completeness_flags"]
TEXT_SOURCES = ["ocr", "native", "tag"]
CHECKED = [
    ("entry_id", "key"),
    ("docket_id", "docket"),
    ("service_type", "services"),
    ("phases_present", "phases"),
    ("county", "county"),
    ("highest_review_level", "level"),
    ("decision_level", "level"),
    ("primary_service_area", "counties"),
    ("competing_docket_ids", "dockets"),
    ("docket_family", "family"),
    ("matter_type", v.MATTER_TYPES),
    ("action_type", v.ACTION_TYPES),
    ("bed_count", "int"),
    ("year_filed", "int"),
    ("final_outcome", v.OUTCOMES),
    ("final_decision_date", "date"),
    ("estimated_cost", "money"),
    ("letter_of_intent_date", "date"),
    ("deemed_complete_date", "date"),
    ("decision_deadline", "date"),
    ("doc_type", v.DOC_TYPES),
    ("phase", v.PHASES),
    ("page_count", "int"),
    ("repo_date_created", "timestamp"),
    ("repo_date_modified", "timestamp"),
    ("doc_date", "date"),
    ("outcome", v.OUTCOMES),
    ("ocr_confidence", "double"),
    ("validated_date", "timestamp"),
    ("duplicate_of", "int"),
    ("text_source", TEXT_SOURCES),
]
MESSAGES = {"key": "missing or non-integer", "docket": "missing or not a docket", "int": "not a whole number", "double": "not a number", "money": "not an amount", "date": "not a date", "timestamp": "not a time", "level": "not a level from 1 to 5", "county": "not a county", "counties": "holds what is no county", "services": "holds what is no service type", "phases": "holds what is no phase", "dockets": "holds what is no docket", "family": "not a docket family"}


def whole(c: str) -> Column:
    return F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")


def typed(name: str, kind: str | Sequence[str]) -> Column:
    """Value of a text column by its kind, null where it is blank or wrong."""
    many = lambda values: F.transform(s.multi(name), lambda x: s.match_vocabulary(x, values))
    if not isinstance(kind, str):
        return s.match_vocabulary(name, kind)
    return {
        "key": lambda: whole(name),
        "int": lambda: whole(name).cast("int"),
        "double": lambda: F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)"),
        "money": lambda: s.money(name),
        "date": lambda: s.parse_date(F.trim(name)),
        "timestamp": lambda: s.parse_timestamp(F.trim(name)),
        "level": lambda: s.decision_level(name),
        "county": lambda: s.match_county(name),
        "docket": lambda: dockets.normalize_docket(name),
        "family": lambda: s.match_vocabulary(name, v.DOCKET_FAMILIES),
        "services": lambda: many(v.SERVICE_TYPES),
        "phases": lambda: many(v.PHASES),
        "counties": lambda: F.transform(s.multi(name), lambda x: s.match_county(x)),
        "dockets": lambda: F.transform(s.multi(name), dockets.normalize_docket),
    }[kind]()


def shape_rows(df: DataFrame, row_number: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects) of a tag export of texts. The first wrong column in the fixed order rejects a row; blanks
    are null but for entry_id and docket_id; a bad validation status becomes Unvalidated and is told as a warning in
    ``warnings``; the docket's family follows from the docket where none is given. Missing columns are null."""
    given = df.withColumns({c: F.lit(None).cast("string") for c in [*TEXTS, *LISTS, *(c for c, _ in CHECKED), "validation_status"] if c not in df.columns})
    held = given.withColumns({f"__{c}": typed(c, kind) for c, kind in CHECKED})
    holes = ("services", "phases", "counties", "dockets")

    def wrong(c: str, kind) -> Column:
        if kind in holes:
            return F.exists(f"__{c}", lambda x: x.isNull())
        return F.col(f"__{c}").isNull() if kind in ("key", "docket") else unparsed(c, F.col(f"__{c}"))

    checks = [(c, wrong(c, kind), MESSAGES[kind] if isinstance(kind, str) else "not in the vocabulary") for c, kind in CHECKED]
    good, rejects = first_error(held, checks, row_number)
    kept = [F.col(f"__{c}").alias(c) for c, _ in CHECKED if c != "docket_family"]
    family = F.coalesce("__docket_family", s.classify_family("__docket_id")).alias("docket_family")
    status, warning = validation_status("validation_status")
    variants = F.array_sort(F.array_distinct(F.concat(F.coalesce(s.multi("docket_variants"), F.array().cast("array<string>")), F.array(F.col("__docket_id")))))
    lists = [variants.alias("docket_variants"), *[s.multi(c).alias(c) for c in LISTS[1:]]]
    return good.select(row_number, *kept, family, *lists, *[s.clean(c).alias(c) for c in TEXTS], status.alias("validation_status"), warning.alias("warnings")), rejects


def validation_status(c: str) -> tuple[Column, Column]:
    """(status, warning): blank and unknown values become the default, unknown ones with a warning."""
    known = s.match_vocabulary(c, v.VALIDATION_STATUSES)
    warned = F.when(known.isNull() & (F.trim(c) != ""), F.concat(F.lit("validation_status: "), F.trim(c)))
    return F.coalesce(known, F.lit(v.VALIDATION_STATUSES[0])), warned


RECORD = "entry_id string, full_text string, text_source string, di_model string, di_confidence string, paragraphs string"
PARAGRAPHS = "array<struct<num:string,text:string>>"


def shape_texts(lines: DataFrame, line: str = "line", row_number: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """(text records, rejects) of JSON lines: entry_id, full_text, char_count, text_source, di_model, di_confidence and
    paragraphs (null where missing, which differs from none)."""
    read = lines.select(row_number, F.col(line).alias("record"), F.from_json(line, RECORD).alias("r")).select(row_number, "record", "r.*")
    held = read.withColumns({"__id": whole("entry_id"), "__source": s.match_vocabulary("text_source", TEXT_SOURCES), "__sure": F.expr("try_cast(di_confidence AS DOUBLE)"), "__parts": F.from_json("paragraphs", PARAGRAPHS)})
    parts = F.col("paragraphs").isNotNull()
    checks = [
        ("record", ~F.coalesce(F.trim("record").startswith("{") & F.get_json_object("record", "$").isNotNull(), F.lit(False)), "not a JSON object"),
        ("entry_id", F.col("__id").isNull(), "missing or non-integer"),
        ("full_text", F.coalesce(F.trim("full_text"), F.lit("")) == "", "missing or empty"),
        ("text_source", F.col("__source").isNull(), "not a text source"),
        ("di_confidence", unparsed("di_confidence", F.col("__sure")), "not a number"),
        ("paragraphs", parts & ~F.startswith("paragraphs", F.lit("[")), "not a list"),
        ("paragraphs", parts & (F.col("__parts").isNull() | F.exists("__parts", lambda p: p.isNull() | (F.coalesce(F.trim(p["text"]), F.lit("")) == ""))), "an item has no text"),
    ]
    good, rejects = first_error(held, checks, row_number)
    columns = [F.col("__id").alias("entry_id"), "full_text", F.length("full_text").cast("long").alias("char_count"), F.col("__source").alias("text_source"), s.clean("di_model").alias("di_model"), F.col("__sure").alias("di_confidence"), F.transform("__parts", lambda p: F.struct(s.clean(p["num"]).alias("num"), p["text"].alias("text"))).alias("paragraphs")]
    return good.select(row_number, *columns), rejects


def tag_errors(axes: Mapping[str, Sequence[str]], closed: str = "Masterfile") -> Column:
    """Messages on one tag row (axis1, axis2, axis3 and axis4 arrays): unknown values of each axis, codes given twice, and
    codes beside the closing value of axis 2. Null values are not tagged; no message means valid."""
    def single(axis: str) -> Column:
        return F.array_compact(F.array(F.when(F.col(axis).isNotNull() & ~F.col(axis).isin(list(axes[axis])), F.concat(F.lit(f"{axis}: unknown "), F.col(axis)))))

    def codes(axis: str) -> Column:
        own = F.coalesce(F.col(axis), F.array().cast("array<string>"))
        said = F.transform(own, lambda x, k: F.when(~x.isin(list(axes[axis])), F.concat(F.lit(f"{axis}: unknown "), x)).when(F.array_position(own, x) <= k, F.concat(F.lit(f"{axis}: duplicate "), x)))
        return F.array_compact(said)

    held = (F.coalesce(F.size("axis3"), F.lit(0)) > 0) | (F.coalesce(F.size("axis4"), F.lit(0)) > 0)
    shut = F.array_compact(F.array(F.when((F.col("axis2") == closed) & held, f"{closed}: no codes may stand beside it")))
    return F.concat(single("axis1"), single("axis2"), codes("axis3"), codes("axis4"), shut)


def known_only(rows: DataFrame, known: DataFrame, key: str, row_number: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is known, rejects of the others)."""
    there = known.select(F.col(key).alias("__k")).distinct()
    rejects = rows.join(there, F.col(key) == F.col("__k"), "left_anti")
    return rows.join(there, F.col(key) == F.col("__k"), "left_semi"), rejects.select(row_number, F.lit(key).alias("field"), F.lit("not in the documents").alias("message"), F.col(key).cast("string").alias("raw_value"))


def run_statistics(good: DataFrame, rejects: DataFrame, key: str, batch: int = 500) -> DataFrame:
    """One row, as a dry run tells it before anything is written: rows read, rows that would be written, distinct keys,
    rejects and commits of ``batch`` rows."""
    counts = good.agg(F.count("*").alias("upserted"), F.countDistinct(key).alias("keys")).crossJoin(rejects.agg(F.count("*").alias("rejected")))
    return counts.select((F.col("upserted") + F.col("rejected")).alias("read"), "upserted", "keys", "rejected", F.ceil(F.col("upserted") / batch).alias("commits"))


def write_judged(good: DataFrame, rejects: DataFrame, path: str) -> dict[str, int]:
    """Writes rows as ``status=good`` and ``status=rejected`` below a path, in one job that counts them on the way (``upserted``,
    ``rejected``)."""
    from docketry.sources.tables import write_counted

    both = good.withColumn("status", F.lit("good")).unionByName(rejects.withColumn("status", F.lit("rejected")), allowMissingColumns=True)
    return write_counted(both, path, "status", upserted=F.count_if(F.col("status") == "good"), rejected=F.count_if(F.col("status") == "rejected"))


def sweep_counts(entries: DataFrame, status: str = "status") -> DataFrame:
    """One row: files processed, failed and skipped."""
    return entries.agg(*[F.count_if(F.col(status) == x).alias(x) for x in ("processed", "failed", "skipped")])


def merge_texts(held: DataFrame, coming: DataFrame) -> DataFrame:
    """Next version of the text records: text and count as they come, source, model and confidence where they come."""
    from docketry.operators.records import merge

    return merge(held, coming.select(*held.columns), ["entry_id"], direct=["full_text", "char_count"])


def set_axes(held: DataFrame, rows: DataFrame, position: str = "row_number") -> DataFrame:
    """Next version of (entry_id, axis1, axis2, codes): of each entry the last row's axes overwrite, its codes of all
    rows join those that are there, in order. Rows at one position count in order of their axes, so the last is always the same."""
    last = rows.groupBy("entry_id").agg(F.max(F.struct(position, "axis1", "axis2")).alias("last"))
    more = rows.select("entry_id", F.explode("codes").alias("code")).distinct().groupBy("entry_id").agg(F.collect_list("code").alias("more"))
    both = held.join(last, "entry_id", "full_outer").join(more, "entry_id", "left")
    none = F.array().cast("array<string>")
    there = F.col("last").isNotNull()
    pick = lambda c: F.when(there, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("entry_id", pick("axis1"), pick("axis2"), F.array_sort(F.array_union(F.coalesce("codes", none), F.coalesce("more", none))).alias("codes"))


def route(kind: Column, doc_type: Column, text: Column, pages: Column, ocr_types: Sequence[str]) -> Column:
    """What is to be done with a file: its own text where it has enough a page, ``ocr`` for images and scans of types
    that deserve it, ``text`` or ``html`` as they are, else ``skip``."""
    deserves = doc_type.isin(list(ocr_types))
    return F.when((kind == "pdf") & s.native_enough(text, pages), "native").when(kind.isin("pdf", "image"), F.when(deserves, "ocr").otherwise("skip")).when(kind.isin("text", "html"), kind).otherwise("skip")


def one_record(files: DataFrame, index: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document rows, text rows) of processed files (file_id, entry_id, stem, doc_type, phase, text, source, confidence):
    each with its index row's docket and applicant; the confidence is a percentage in the document and a share in the text.
    Files without an index row give nothing; a document that is there keeps what the file doesn't tell."""
    named = files.join(index.select("entry_id", "docket_id", "path"), "entry_id")
    applicant = s.applicant_in_path("path", F.array(F.col("docket_id").cast("string")))
    rows = named.select("entry_id", "docket_id", applicant.alias("applicant"), "doc_type", "phase", F.col("stem").alias("title"), s.as_percent("confidence").alias("ocr_confidence"), F.lit("Unvalidated").alias("validation_status"))
    texts = named.where(F.trim("text") != "").select("entry_id", F.col("text").alias("full_text"), F.length("text").cast("long").alias("char_count"), F.col("source").alias("text_source"), F.col("confidence").alias("di_confidence"))
    from docketry.operators.records import merge

    return merge(documents, rows.select(*documents.columns), ["entry_id"]), texts


def prior_sources(ledger: DataFrame) -> DataFrame:
    """(entry_id, files) of entries that succeeded from several files, the later of which overwrote the others."""
    done = ledger.where("status = 'succeeded'").groupBy("entry_id").agg(F.countDistinct("file_hash").alias("files"))
    return done.where("files > 1")
