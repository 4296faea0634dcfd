"""Proceedings: the stages that a matter has gone through, as stored or as its dates and outcome tell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import scalars as s

# What an outcome means for the proceeding; others are approvals, none is pending.
FINDINGS = {"Denied": "Denied", "Withdrawn": "Withdrawn", "Dismissed": "Withdrawn", "Pending": "Pending", "Unknown": "Pending"}
# Days after filing at which an open proceeding reaches its next stage, first stages from 1.
CLOCKS = {"CON": [120, 150, 240], "DET": [45, 60, 100]}
# Titles, and what is said of the date while the stage is open and once the proceeding is closed.
STAGES = {
    "CON": [
        (0, "Letter of Intent", "Filed {filed}", "Filed {filed}"),
        (1, "Initial Filing Review", "Submitted {filed} · 120-day review clock", "Submitted {filed} · Decision {desk}"),
        (2, "Initial Decision Challenge", "Opens on desk decision · 30-day window", "Challenge window closed"),
        (3, "Administrative Appeal", "Appointed {appointed}", "Hearing {hearing} · Decision {ruling}"),
        (4, "Final Agency Decision", "Triggered upon Stage 3 conclusion", "Effective {ruling}"),
        (5, "Judicial Review", "Petition within 30 days of final agency decision", "Petition within 30 days of final agency decision"),
        (6, "Appellate Review", "Upon Superior Court disposition", "Upon Superior Court disposition"),
        (7, "Terminal Outcomes", "", "Record closed {decided}"),
    ],
    "DET": [
        (1, "Request Submission", "Filed {filed}", "Filed {filed}"),
        (2, "DCH Review & Letter Issued", "Due ~60 days from filing", "Letter issued {desk}"),
        (3, "Finality or Challenge", "Opens on letter issuance · 30-day window", "Challenge window closed"),
        (4, "Administrative Appeal", "Identical mechanics to CON administrative appeal", "Identical mechanics to CON administrative appeal"),
        (5, "Judicial & Appellate", "Upon final agency decision", "Upon final agency decision"),
    ],
}
# Days from filing to the first decision while there is none, and from appointment to the hearing.
FIRST_DECISION, HEARING = {"CON": 120, "DET": 45}, {"CON": 99, "DET": 69}


def finding(outcome: Column) -> Column:
    return F.when(F.coalesce(outcome, F.lit("")) == "", "Pending").otherwise(F.coalesce(s.lookup(outcome, FINDINGS), F.lit("Approved")))


def said(text: str, days: dict[str, Column]) -> Column:
    """A text with dates, as ``Jan 5, 2026``, in place of their names."""
    return reduce(lambda out, d: F.replace(out, F.lit(f"{{{d}}}"), F.date_format(days[d], "MMM d, yyyy")), [d for d in days if f"{{{d}}}" in text], F.lit(text))


def synthesized(matters: DataFrame, now: Column) -> DataFrame:
    """(docket_id, source, is_closed, stages): matters (docket_id, family, received, year_filed, decided, final_outcome)
    by their family's clock; without a filing date the year's first day starts it, without either ``now`` does."""
    own = matters.withColumns({"__base": F.when(F.col("family") == "CON", "CON").otherwise("DET"), "__filed": F.coalesce(s.year_anchor("received", "year_filed"), now), "__finding": finding(F.col("final_outcome"))})
    own = own.withColumns({"__closed": F.col("__finding") != "Pending", "__decided": F.coalesce("decided", "__filed")})

    def stages(base: str) -> Column:
        desk = F.when(F.col("__closed"), F.col("__decided")).otherwise(F.date_add("__filed", FIRST_DECISION[base]))
        days = {"filed": F.col("__filed"), "decided": F.col("__decided"), "desk": desk, "appointed": F.date_add(desk, 44), "hearing": F.date_add(desk, 44 + HEARING[base]), "ruling": F.date_add(desk, 72 + HEARING[base])}
        at = reduce(lambda n, d: n + (F.date_diff(now, "__filed") >= d).cast("int"), CLOCKS[base], F.lit(1))

        def one(n: int, title: str, opened: str, closed: str) -> Column:
            status = F.when(F.col("__closed") | (F.lit(n) < at), "complete").when(F.lit(n) == at, "active").otherwise("pending")
            return F.struct(F.lit(n).alias("n"), status.alias("status"), F.lit(title).alias("title"), F.when(F.col("__closed"), said(closed, days)).otherwise(said(opened, days)).alias("date_line"))

        return F.array(*[one(*stage) for stage in STAGES[base]])

    return own.select("docket_id", F.lit("synthesized").alias("source"), F.col("__closed").alias("is_closed"), F.when(F.col("__base") == "CON", stages("CON")).otherwise(stages("DET")).alias("stages"))


def proceedings(matters: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """As ``synthesized``, but matters with stored stages (docket_id, sort_order, stage_num, is_current, title,
    stage_label, summary) have those instead, none of them pending."""
    one = F.struct("sort_order", F.col("stage_num").cast("int").alias("n"), F.when(F.col("is_current"), "active").otherwise("complete").alias("status"), F.coalesce("title", "stage_label").alias("title"), F.col("summary").alias("date_line"))
    held = stored.groupBy("docket_id").agg(F.array_sort(F.collect_list(one)).alias("own"))
    made = synthesized(matters, now).join(held, "docket_id", "left")
    own = F.transform("own", lambda x: F.struct(x["n"].alias("n"), x["status"].alias("status"), x["title"].alias("title"), x["date_line"].alias("date_line")))
    return made.select("docket_id", F.when(F.col("own").isNotNull(), "stored").otherwise(F.col("source")).alias("source"), "is_closed", F.coalesce(own, "stages").alias("stages"))


def stage_rows(made: DataFrame) -> DataFrame:
    """Stages as rows to store: number, label (80 characters), title, first date of the date line, summary, order."""
    rows = made.select("docket_id", F.posexplode("stages").alias("sort_order", "x"))
    return rows.select("docket_id", F.col("x.n").alias("stage_num"), F.substring("x.title", 1, 80).alias("stage_label"), F.col("x.title").alias("title"), s.stage_date("x.date_line").alias("stage_date"), F.col("x.date_line").alias("summary"), (F.col("x.status") == "active").alias("is_current"), F.lit(False).alias("has_opinion"), "sort_order")


def last_decided(made: DataFrame, stages: str = "stages") -> DataFrame:
    """(docket_id, outcome) of the last stage that has one that counts (not gray), else of the last that has any."""
    held = F.filter(stages, lambda x: F.coalesce(x["outcome"], F.lit("")) != "")
    counts = F.filter(held, lambda x: x["color"].isNotNull() & (x["color"] != "gray"))
    last = lambda a: F.try_element_at(a, F.lit(-1))["outcome"]
    return made.select("docket_id", F.coalesce(last(counts), last(held), F.lit("—")).alias("outcome"))
