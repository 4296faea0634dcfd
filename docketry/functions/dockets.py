"""Docket references in free text, by column functions alone.

A text is parted into words, numbers and what stands between them. A docket is a head (a kind of docket, with a subtype
perhaps, or a county) and the numbers that follow it; all are told by looking tokens up, so no pattern spans a docket.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.sources.vocabulary import COUNTIES

# Heads and subtypes, and how numbers group.
KINDS = {"CON": "CON", "DET": "DET", "LNR": "LNR", "GA": "CON"}
SUBTYPES = ["ASC", "EQT"]
LEAST_DIGITS = {"CON": 4, "DET": 3, "LNR": 3}  # of a number that stands alone
JOINTS = " -_.–"
LABEL_WORDS = ["DOCKET", "PROJECT", "FILE", "MATTER", "CASE", "NO", "NUMBER", "NUM", "ID"]

ONE_WORD = [c.upper() for c in COUNTIES if " " not in c]
TWO_WORDS = [c.upper() for c in COUNTIES if " " in c]
HEADS = [*KINDS, *(k + sub for k in ("DET", "LNR") for sub in SUBTYPES)]
FIRST_WORDS = [*HEADS, *ONE_WORD, *(c.split(" ")[0] for c in TWO_WORDS)]


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def tokens_of(text: Column) -> Column:
    """Words, numbers and what is between them, in order; whatever kind of blank is a blank."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\s", " "), F.lit("([A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)"), 1)


def is_joint(token: Column, joints: str = JOINTS) -> Column:
    return F.coalesce((F.length(token) == 1) & F.instr(F.lit(joints), token).cast("boolean"), F.lit(False))


def is_number(token: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(token).between(least, most) & token.rlike("^[0-9]+$"), F.lit(False))


def only(token: Column, characters: str) -> Column:
    """Whether a token is there and made of ``characters`` alone."""
    return F.coalesce((F.length(token) > 0) & (F.translate(token, characters, "") == ""), F.lit(False))


def joined(tokens: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(tokens, start + 1, F.greatest(stop - start, F.lit(0))), "")


def coded(tokens: Column, at: Column) -> Column:
    """Docket with a kind at token ``at``, or null: (canonical, kind, variants, raw, start, stop)."""
    get = lambda k: F.get(tokens, k)

    def head(word: Column) -> Column:
        kind, glued = F.substring(word, 1, 3), F.length(word) == 6
        apart = word.isin("DET", "LNR") & is_joint(get(at + 1)) & F.coalesce(F.upper(get(at + 2)).isin(SUBTYPES), F.lit(False))
        sub = F.when(glued, F.substring(word, 4, 3)).when(apart, F.upper(get(at + 2)))
        after = at + F.when(apart, 3).otherwise(1)
        return F.struct(F.when(word == "GA", "CON").otherwise(kind).alias("kind"), sub.alias("sub"), (word == "GA").alias("old"), after.alias("after"))

    def numbers(h: Column) -> Column:
        gap = F.when(h["old"], is_joint(get(h["after"]), "-_.")).otherwise(is_joint(get(h["after"])))
        return bound(
            h["after"] + gap.cast("int"),
            lambda first: F.struct(
                first.alias("first"),
                F.when(h["old"], is_number(get(first), 6, 8)).otherwise(is_number(get(first), 2, 8)).alias("fits"),
                (~h["old"] & is_joint(get(first + 1)) & is_number(get(first + 2), 1, 6)).alias("second"),
                (is_joint(get(first + 3)) & is_number(get(first + 4), 1, 6)).alias("third"),
            ),
        )

    def docket(h: Column, n: Column) -> Column:
        first, two, three = n["first"], n["second"], n["second"] & n["third"]
        number = F.concat_ws("-", get(first), F.when(two, get(first + 2)), F.when(three, get(first + 4)))
        enough = two | (F.length(get(first)) >= F.when(h["kind"] == "CON", LEAST_DIGITS["CON"]).otherwise(LEAST_DIGITS["DET"]))
        stop = first + 1 + F.when(three, 4).when(two, 2).otherwise(0)
        front, raw = F.concat_ws("-", h["kind"], h["sub"]), joined(tokens, at, stop)
        legacy = F.when(h["old"], F.array(F.concat(F.lit("GA-"), number), F.concat(F.lit("GA"), number))).otherwise(F.array().cast("array<string>"))
        named = F.array_union(F.array(raw, F.concat(front, F.lit("-"), number), F.concat(front, number)), legacy)
        return F.when(n["fits"] & enough, F.struct(F.concat(front, F.lit("-"), number).alias("canonical"), h["kind"].alias("kind"), named.alias("variants"), raw.alias("raw"), at.alias("start"), stop.alias("stop")))

    return bound(bound(F.upper(get(at)), head), lambda h: bound(numbers(h), lambda n: docket(h, n)))


def of_county(tokens: Column, at: Column, gaps: str) -> Column:
    """Docket of a county at token ``at``, or null; ``gaps`` may stand before its number."""
    get = lambda k: F.get(tokens, k)
    word = F.upper(get(at))
    long = F.when(only(get(at + 1), " -_") & (F.length(get(at + 1)) == 1), F.concat(word, F.lit(" "), F.upper(get(at + 2))))
    two = F.coalesce(long.isin(TWO_WORDS), F.lit(False)) if TWO_WORDS else F.lit(False)

    def docket(name: Column, gap: Column) -> Column:
        number, place = get(gap + 1), F.replace(name, F.lit(" "), F.lit("-"))
        raw = joined(tokens, at, gap + 2)
        fits = only(get(gap), gaps) & is_number(number, 1, 4)
        named = F.array_distinct(F.array(raw, F.concat(place, F.lit("-"), number), F.concat(name, F.lit("-"), number)))
        return F.when(fits, F.struct(F.concat(place, F.lit("-"), number).alias("canonical"), F.lit("COUNTY").alias("kind"), named.alias("variants"), raw.alias("raw"), at.alias("start"), (gap + 2).alias("stop")))

    chosen = F.when(two, F.struct(long.alias("name"), (at + 3).alias("gap"))).when(word.isin(ONE_WORD), F.struct(word.alias("name"), (at + 1).alias("gap")))
    return bound(chosen, lambda c: docket(c["name"], c["gap"]))


def hits(tokens: Column, blank_in_county: bool = False) -> Column:
    """Every docket in ``tokens`` by place; a head that follows a number at once doesn't count."""
    free = lambda k: ~F.coalesce(F.get(tokens, k - 1).rlike("^[0-9]"), F.lit(False))
    at = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda k: F.upper(F.get(tokens, k)).isin(FIRST_WORDS) & free(k))
    judge = lambda k: F.when(F.upper(F.get(tokens, k)).isin(HEADS), coded(tokens, k)).otherwise(of_county(tokens, k, "-_. " if blank_in_county else "-_."))
    return F.when(F.size(tokens) > 0, F.filter(F.transform(at, judge), lambda d: d.isNotNull()))


def extract_dockets(text: Column | str) -> Column:
    """Array of the dockets in a text by first appearance (canonical, kind, variants, raw), one for each canonical form
    with the variants of all its appearances; null and empty texts give an empty array."""
    text = F.col(text) if isinstance(text, str) else text

    def one_each(found: Column) -> Column:
        named = F.array_distinct(F.transform(found, lambda d: d["canonical"]))

        def merged(name: Column) -> Column:
            own = F.filter(found, lambda d: d["canonical"] == name)
            variants = F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda d: d["variants"]))))
            return F.struct(name.alias("canonical"), own[0]["kind"].alias("kind"), variants.alias("variants"), own[0]["raw"].alias("raw"))

        return F.transform(named, merged)

    none = F.array().cast("array<struct<canonical:string,kind:string,variants:array<string>,raw:string>>")
    return F.coalesce(bound(tokens_of(text), lambda t: bound(hits(t), one_each)), none)


def normalize_docket(text: Column | str) -> Column:
    """Canonical docket of a text that is meant to be one, else null: the docket that it is but for labels in front
    (``Docket No. ``) and punctuation around, else the only one that it holds."""
    text = F.col(text) if isinstance(text, str) else text

    def cleaned(tokens: Column) -> Column:
        """Tokens from the first that is no label and not just punctuation, to the last word or number."""
        said = lambda t: t.rlike("^[A-Za-z0-9]")
        places = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))
        own = F.filter(places, lambda k: F.coalesce(said(F.get(tokens, k - 1)), F.lit(False)))
        kept = F.filter(own, lambda k: ~F.upper(F.get(tokens, k - 1)).isin(LABEL_WORDS))
        return F.slice(tokens, F.coalesce(F.get(kept, F.lit(0)), F.lit(1)), F.greatest(F.coalesce(F.array_max(own) - F.get(kept, F.lit(0)) + 1, F.lit(0)), F.lit(0)))

    def judged(tokens: Column) -> Column:
        whole = F.filter(hits(tokens, True), lambda d: (d["start"] == 0) & (d["stop"] == F.size(tokens)))
        inside = F.array_distinct(F.transform(hits(tokens), lambda d: d["canonical"]))
        return F.coalesce(F.get(whole, F.lit(0))["canonical"], F.when(F.size(inside) == 1, F.get(inside, F.lit(0))))

    return bound(bound(tokens_of(text), cleaned), judged)
