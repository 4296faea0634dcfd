"""Column functions for records: text, money, dates, vocabularies, digests. All stay in whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.sources import vocabulary as v

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Text) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def multi(c: Text, separator: str = ";") -> Column:
    """Parts of a separated list: trimmed, blanks dropped, distinct in order of appearance."""
    parts = F.transform(F.split(col(c), re.escape(separator)), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def lookup(key: Column, mapping: Mapping[str, object]) -> Column:
    """Value of ``key`` in a small fixed mapping, else null."""
    pairs = [x if isinstance(x, Column) else F.lit(x) for k, value in mapping.items() for x in (k, value)]
    return F.try_element_at(F.create_map(*pairs), key)


def county_key(c: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(col(c))), " COUNTY$", ""), "[ -]", "")


def match_county(c: Text) -> Column:
    """County name as conventionally written, else null; case, blanks, hyphens and a final "County" don't matter."""
    return lookup(county_key(c), {name.upper().replace(" ", ""): name for name in v.COUNTIES})


def vocabulary_key(c: Text) -> Column:
    spaced = F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))
    return F.regexp_replace(F.regexp_replace(spaced, "[—–]", "-"), r"\s*/\s*", "/")


def match_vocabulary(c: Text, allowed: Sequence[str]) -> Column:
    """The allowed code that equals the value but for case, blanks, kinds of dash and blanks at slashes, else null."""
    key = lambda s: re.sub(r"\s*/\s*", "/", " ".join(s.split()).lower().replace("—", "-").replace("–", "-"))
    return lookup(vocabulary_key(c), {key(a): a for a in allowed})


def decision_level(c: Text) -> Column:
    """``3`` or ``3 Superior Court Decision`` to 3; null where the number or its label is wrong."""
    level = F.expr("try_cast(nullif(regexp_extract({0}, '^\\\\s*([1-5])(?:\\\\s|$)', 1), '') AS INT)".format(_sql(c)))
    label = F.regexp_replace(F.trim(col(c)), r"^[1-5]\s*", "")
    right = lookup(level.cast("string"), {str(k): x for k, x in v.DECISION_LEVELS.items()})
    return F.when((label == "") | (F.lower(label) == F.lower(right)), level)


def _sql(c: Text) -> str:
    if not isinstance(c, str):
        raise TypeError("a column name is needed")
    return f"`{c}`"


# What unit words of an amount stand for.
UNITS = {"K": 1_000, "THOUSAND": 1_000, "M": 1_000_000, "MILLION": 1_000_000, "B": 1_000_000_000, "BILLION": 1_000_000_000}


def money(c: Text) -> Column:
    """First amount as decimal(18,2), halves to even: a number with a unit word, else one after a dollar sign, else a
    text that is a number alone. Words and numbers of the text are looked at one by one."""
    tokens = F.regexp_extract_all(F.upper(col(c)), F.lit("([0-9][0-9,]*[.][0-9]+|[0-9][0-9,]*|[A-Z]+|[^A-Z0-9 ])"), 1)

    def amount(t: Column) -> Column:
        number = lambda k: F.try_to_number(F.replace(F.get(t, k), F.lit(","), F.lit("")), F.lit("9" * 20 + "D" + "9" * 6)).cast("decimal(26,6)")
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: F.get(t, k).rlike("^[0-9]"))
        unit = lambda k: lookup(F.get(t, k + 1), UNITS)
        scaled = F.get(F.filter(at, lambda k: unit(k).isNotNull()), F.lit(0))
        paid = F.get(F.filter(at, lambda k: F.get(t, k - 1) == "$"), F.lit(0))
        return F.when(F.size(t) > 0, F.coalesce(number(scaled) * unit(scaled).cast("decimal(10,0)"), number(paid), F.when(F.size(t) == 1, number(F.get(at, F.lit(0))))))

    return F.bround(F.transform(F.array(tokens), amount)[0], 2).cast("decimal(18,2)")


def parse_date(c: Text) -> Column:
    """ISO date, else month/day/year; null where neither parses."""
    return F.coalesce(F.try_to_date(col(c), "yyyy-MM-dd"), F.try_to_date(col(c), "M/d/yyyy"))


def parse_timestamp(c: Text) -> Column:
    """ISO timestamp or date, else month/day/year with an optional time of day."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy HH:mm", "M/d/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(form)) for form in forms])


def name_date(c: Text) -> Column:
    """Date in a file name as ``2024-05-31``, ``2024_05_31`` or ``2024.05.31``; null where there is none such day."""
    found = F.regexp_extract(col(c), r"(20\d{2}[-_.]\d{2}[-_.]\d{2})", 1)
    return F.try_to_date(F.regexp_replace(found, "[_.]", "-"), "yyyy-MM-dd")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, halves to even; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(100.0 * part / whole, 1))


def digest(*columns: Text) -> Column:
    """SHA-256 of the values joined by ``|``, nulls being empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]), 256)


def seed_of(c: Text) -> Column:
    """Fraction in thousandths from a 32-bit rolling hash (h * 31 + code) of a text of BMP characters."""
    codes = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(0xFFFFFFFF))
    signed = F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
    return (F.abs(signed) % 1000) / 1000.0


def classify_family(c: Text) -> Column:
    """Docket family by prefix after separators are unified; anything else is CON."""
    key = F.regexp_replace(F.upper(F.trim(col(c))), r"[\s_.–-]+", "-")
    tagged = F.regexp_replace(key, "^(DET|LNR)-?(ASC|EQT)", "$1-$2")
    named = reduce(lambda chain, p: chain.when(tagged.startswith(p), p), ["LNR-ASC", "LNR-EQT", "DET-ASC", "DET-EQT"], F)
    return named.when(key.rlike(r"^(DET|LNR)(-|\d|$)"), "DET").otherwise("CON")


def base_family(c: Text) -> Column:
    """Family that owns the deadline rules, else null."""
    return F.when(col(c) == "CON", "CON").when(col(c).isin("DET", "DET-EQT", "DET-ASC", "LNR-ASC", "LNR-EQT"), "DET")


def bare_docket(c: Text) -> Column:
    """``2026-002`` or ``2023013`` at the start of a line to ``CON-2026002``; null elsewhere."""
    year = F.regexp_extract(col(c), r"^\s*(20\d{2})(?:\s*-\s*\d{1,4}|\d{3})(?!\d)", 1)
    number = F.coalesce(F.nullif(F.regexp_extract(col(c), r"^\s*20\d{2}\s*-\s*(\d{1,4})(?!\d)", 1), F.lit("")), F.nullif(F.regexp_extract(col(c), r"^\s*20\d{2}(\d{3})(?!\d)", 1), F.lit("")))
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.when(year != "", F.concat(F.lit("CON-"), year, padded))


def title(*parts: Text) -> Column:
    """Non-empty parts joined by a dash."""
    return F.concat_ws(" — ", *[F.nullif(col(p), F.lit("")) for p in parts])


def labelled(**parts: Text) -> Column:
    """Lines ``Label: value`` of the parts that aren't empty."""
    line = lambda name, c: F.when(F.coalesce(col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(name.replace("_", " ").capitalize() + ": "), col(c).cast("string")))
    return F.concat_ws("\n", *[line(name, c) for name, c in parts.items()])


def snippet(c: Text, size: int = 300) -> Column:
    """Text on one line, cut with an ellipsis beyond ``size`` characters."""
    flat = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def iso_time(c: Text) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def folder_of(path: Text) -> Column:
    """Name of a file's folder without its ordering prefix, in lower case."""
    parts = F.split(F.regexp_replace(col(path), r"\\", "/"), "/")
    return F.lower(F.trim(F.regexp_replace(F.try_element_at(parts, F.lit(-2)), r"^[0-9A-Za-z](?:\.\d+)*\s+", "")))


def folder_type(path: Text) -> Column:
    return lookup(folder_of(path), {k: t for k, (t, _) in v.FOLDERS.items()})


def folder_phase(path: Text) -> Column:
    return lookup(folder_of(path), {k: p for k, (_, p) in v.FOLDERS.items()})


# In these folders a file deserves OCR if its name holds one of the first words and none of the second.
APPEAL_WORDS = (["order", "decision", "findings of fact", "opinion", "certificate"], ["duplicate", "proposed", "draft"])
OCR_WORDS = {
    "main application": (["main application"], ["master file", "bates"]),
    "appendices": ([], []),
    "decision": (["decision", "letter"], ["certificate"]),
    "evaluation": (["request", "response", "additional info"], []),
    "initial hearing officer appeal": APPEAL_WORDS,
    "apa appeal": APPEAL_WORDS,
    "commissioner review": APPEAL_WORDS,
    "judicial review": APPEAL_WORDS,
    "review board": APPEAL_WORDS,
}


def worth_ocr(path: Text) -> Column:
    """Whether a file's name deserves OCR in its folder; folders without words in ``OCR_WORDS`` always do."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), -1))
    text_lists = lambda k: lookup(folder_of(path), {folder: F.array(*map(F.lit, words[k])).cast("array<string>") for folder, words in OCR_WORDS.items()})
    held = lambda words: F.exists(words, lambda w: F.contains(name, w))
    return F.coalesce(held(text_lists(0)) & ~held(text_lists(1)), F.lit(True))


def slug(name: Text) -> Column:
    """Lower-case words joined by hyphens, at most 48 characters (``item`` if none), and six digits of a digest."""
    own = F.substring(F.trim(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "-"), F.lit("-")), 1, 48)
    return F.concat(F.coalesce(F.nullif(own, F.lit("")), F.lit("item")), F.lit("-"), F.substring(F.sha2(col(name), 256), 1, 6))


def rule_label(c: Text) -> Column:
    """``con-ho-appointment`` to ``HO Appointment``."""
    words = F.split(F.regexp_replace(col(c), "^(con|det)-", ""), "-")
    named = F.transform(words, lambda w: F.when(w.isin("ho", "dch", "con", "det", "lnr"), F.upper(w)).otherwise(F.initcap(w)))
    return F.array_join(named, " ")


def event_kind(tag: Text) -> Column:
    """Event type of a chronology tag by its first word, else Notice."""
    low = F.lower(col(tag))
    kinds = {"order": "Order", "opinion": "Opinion", "filing": "Filing", "brief": "Brief", "hearing": "Hearing"}
    return reduce(lambda chain, k: chain.when(low.startswith(k), kinds[k]), kinds, F).otherwise("Notice")


def sniff_type(content: Text, name: Text) -> Column:
    """pdf, image, html, text or unknown from the first bytes, else from the extension."""
    head = F.hex(F.substring(col(content), 1, 8))
    low = F.lower(F.decode(F.substring(col(content), 1, 512), "ISO-8859-1"))
    extension = F.lower(F.regexp_extract(col(name), r"\.([A-Za-z0-9]+)$", 1))
    image = head.startswith("FFD8FF") | head.startswith("89504E47") | head.startswith("47494638") | head.startswith("49492A00") | head.startswith("4D4D002A") | head.startswith("424D")
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(image, "image")
        .when(F.ltrim(low).startswith("<!doctype html") | F.ltrim(low).startswith("<html"), "html")
        .when(extension.isin("htm", "html"), "html")
        .when(extension.isin("txt", "csv", "md", "log"), "text")
        .when(F.is_valid_utf8(col(content).cast("string")) & (F.octet_length(col(content)) > 0), "text")
        .otherwise("unknown")
    )


def elapsed_stage(days: Text, determination: Column | bool = False) -> Column:
    """Stage number that the days since filing have reached: 120/150/240 for applications, 45/60/100 else."""
    step = lambda a, b, c: F.when(col(days) < a, 1).when(col(days) < b, 2).when(col(days) < c, 3).otherwise(4)
    return F.when(F.lit(determination) if isinstance(determination, bool) else determination, step(45, 60, 100)).otherwise(step(120, 150, 240))


def duration(days: Text) -> Column:
    """``1 month``, ``3 months``, ``1 yr`` or ``2 yrs 4 mo``: years of 365 days, months of 30 days rounded half to even."""
    years = F.floor(col(days) / 365).cast("int")
    months = F.bround(F.pmod(col(days), F.lit(365)) / 30.0, 0).cast("int")
    short = F.concat(months.cast("string"), F.when(months == 1, " month").otherwise(" months"))
    head = F.concat(years.cast("string"), F.when(years == 1, " yr").otherwise(" yrs"))
    return F.when(years <= 0, short).otherwise(F.concat(head, F.when(months > 0, F.concat(F.lit(" "), months.cast("string"), F.lit(" mo"))).otherwise("")))


def json_or_null(c: Text, schema: str) -> Column:
    """A JSON text as what ``schema`` says; bad JSON is null."""
    return F.from_json(col(c), schema)


def flat_text(segments: Text) -> Column:
    """Rich text, an array of (style, text), as one plain text; null is empty."""
    return F.coalesce(F.array_join(F.transform(col(segments), lambda x: F.coalesce(x["text"], F.lit(""))), ""), F.lit(""))


def has_flags(flags: Text) -> Column:
    return F.coalesce(F.size(col(flags)) > 0, F.lit(False))


def is_stub(flags: Text) -> Column:
    """Whether a flag tells that the record was made for an event alone."""
    return F.coalesce(F.exists(col(flags), lambda x: x.startswith("stub")), F.lit(False))


def time_ago(c: Text, now: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago`` or ``2d ago``; null is empty."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(col(c).cast("timestamp"))) / 60_000_000)
    said = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    label = F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(minutes < 1440, said(minutes / 60, "h")).otherwise(said(minutes / 1440, "d"))
    return F.when(col(c).isNull(), "").otherwise(label)


def year_anchor(day: Text, year: Text) -> Column:
    """The day, else the first of January of the year."""
    return F.coalesce(col(day), F.make_date(F.nullif(col(year), F.lit(0)), F.lit(1), F.lit(1)))


def stage_date(c: Text) -> Column:
    """First date as ``Jan 5, 2026`` in a text."""
    months = {m: k + 1 for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
    words = F.filter(F.split(F.replace(col(c), F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")

    def first(w: Column) -> Column:
        day = lambda k: F.try_to_date(F.concat_ws("-", F.get(w, k + 2), lookup(F.get(w, k), months).cast("string"), F.get(w, k + 1)), "yyyy-M-d")
        fits = lambda k: lookup(F.get(w, k), months).isNotNull() & F.get(w, k + 1).rlike("^[0-9]+$") & F.get(w, k + 2).rlike("^[0-9]{4}$")
        return F.get(F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda k: F.when(fits(k), day(k)))), F.lit(0))

    return F.transform(F.array(words), first)[0]


def as_percent(c: Text) -> Column:
    """A share of 1 as percentage of two decimals, halves to even."""
    return F.bround(col(c) * 100, 2)


def ratio_shade(c: Text) -> Column:
    """Shade 0 to 4 of a ratio: over 0.14, 0.32, 0.55 and 0.8."""
    return reduce(lambda out, b: out + F.coalesce((col(c) > b).cast("int"), F.lit(0)), (0.14, 0.32, 0.55, 0.8), F.lit(0))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def applicant_in_path(path: Text, variants: Column) -> Column:
    """What follows a docket in the first part of a path that begins with it, whatever its form; blank is null."""
    parts = F.split(F.translate(col(path), "\\", "/"), "/")
    starts = lambda part, x: F.startswith(F.upper(part), F.upper(x))
    rest = lambda part: F.get(F.transform(F.filter(variants, lambda x: starts(part, x)), lambda x: F.trim(F.substr(part, F.length(x) + 1))), F.lit(0))
    return clean(F.get(F.transform(F.filter(parts, lambda part: F.exists(variants, lambda x: starts(part, x))), rest), F.lit(0)))


def blob_parts(path: Text) -> Column:
    """(container, name, key) of a path in a store: the first part, the rest, and both joined as the ledger holds them."""
    tidy = F.ltrim(col(path), F.lit("/"))
    box, name = F.substring_index(tidy, "/", 1), F.regexp_replace(tidy, "^[^/]*/?", "")
    return F.struct(box.alias("container"), name.alias("name"), F.concat(box, F.lit("/"), name).alias("key"))


def native_enough(text: Text, pages: Text, least: int = 20) -> Column:
    """Whether a file's own text has at least ``least`` characters a page."""
    return F.coalesce(F.try_divide(F.length(F.trim(col(text))), col(pages)) >= least, F.lit(False))


#: Keys are compared without regard to case and to blanks at the end, as the records' own database does.
KEY_COLLATION = "UTF8_LCASE_RTRIM"


def collated(df, *keys: str):
    """A DataFrame whose key columns compare so in whatever follows: joins, groups, distinct rows, merges."""
    return df.withColumns({k: F.collate(F.col(k).cast("string"), KEY_COLLATION) for k in keys})
