"""Outcome statistics, completeness audits and change activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.scalars import half_up, percent

UNDECIDED = ("Pending", "Unknown", "Withdrawn")


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def since_year(df: DataFrame, this_year: int, years: int | None) -> DataFrame:
    """Matters filed in ``this_year - years`` or later; all where ``years`` is null."""
    return df if years is None else df.where(F.col("year_filed") >= this_year - years)


def outcome_counts(matters: DataFrame) -> DataFrame:
    """Matters by outcome; null is a group."""
    return matters.groupBy("final_outcome").agg(F.count("*").alias("n"))


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Total, approved and denied matters with the approval rate among these two."""
    approved, denied = count_where(F.col("final_outcome") == "Approved"), count_where(F.col("final_outcome") == "Denied")
    sums = df.groupBy(*keys).agg(F.count("*").alias("total"), approved.alias("approved"), denied.alias("denied"))
    return sums.withColumn("approval_pct", percent(F.col("approved"), F.col("approved") + F.col("denied")))


def by_service(matters: DataFrame, services: DataFrame) -> DataFrame:
    """A matter counts once for each of its services."""
    return by_group(services.join(matters, "docket_id"), "service_type")


def key_figures(matters: DataFrame) -> DataFrame:
    """One row: total, appealed (review level 2 or more, so level 5 counts too), reversed, affirmed and their rates."""
    level, outcome = F.col("highest_review_level"), F.col("final_outcome")
    row = matters.agg(
        F.count("*").alias("total"),
        count_where(level >= 2).alias("appealed"),
        count_where(outcome == "Denied").alias("reversed"),
        count_where(outcome == "Approved").alias("affirmed"),
    )
    return row.withColumns({"appeal_pct": percent(F.col("appealed"), F.col("total")), "reversal_pct": percent(F.col("reversed"), F.col("appealed"))})


def approval_rate(matters: DataFrame, *keys: str) -> DataFrame:
    """Approved among decided matters (an outcome that isn't pending, unknown or withdrawn); null where none is."""
    decided = F.col("final_outcome").isNotNull() & ~F.col("final_outcome").isin(*UNDECIDED)
    sums = matters.groupBy(*keys).agg(F.count("*").alias("total"), count_where(F.col("final_outcome") == "Approved").alias("approved"), count_where(decided).alias("decided"))
    return sums.withColumn("approval_rate", F.try_divide("approved", "decided"))


def median_days(starts: DataFrame, ends: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row: median days from a key's first start to its first end, with the number of keys that have both in
    order."""
    first, last = starts.groupBy(key).agg(F.min(start).alias("s")), ends.groupBy(key).agg(F.min(end).alias("e"))
    days = first.join(last, key).where(F.col("e") >= F.col("s")).select(F.date_diff("e", "s").alias("d"))
    return days.agg(F.median("d").alias("median_days"), F.count("*").alias("sample_size"))


def median_by(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, median, sample_size) of a value, as of the days that stages of a proceeding take; null values don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.median(value).alias("median"), F.count("*").alias("sample_size"))


def change_activity(log: DataFrame, by: str = "detected_at") -> DataFrame:
    """By day of the change log: changes, those of documents in scope, and those that put a document back to Unvalidated."""
    flags = {"in_scope_changes": "in_scope", "revalidations": "revalidation_flagged"}
    return log.groupBy(F.to_date(by).alias("day")).agg(F.count("*").alias("changes"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(n) for n, c in flags.items()])


def audit(df: DataFrame, status: str, required: Sequence[str]) -> DataFrame:
    """One row: rows by validation status, and rows that lack a required column."""
    total = F.count("*").cast("long")
    values = ["Validated", "Unvalidated", "Rejected", "Corrected"]
    sums = df.agg(total.alias("total"), *[count_where(F.col(status) == v).alias(v.lower()) for v in values], *[count_where(F.col(c).isNull()).alias(f"missing_{c}") for c in required])
    return sums.withColumn("validated_pct", percent(F.col("validated"), F.col("total")))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, each with its share of the largest."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select(column, "n", F.bround(F.col("n") / F.col("top"), 4).alias("share_of_largest"))


def digest(events: DataFrame, day: str, section: str, filed: Sequence[str], issued: Sequence[str]) -> DataFrame:
    """(day, filed, issued): events of a report day by what their sections stand for."""
    return events.groupBy(day).agg(count_where(F.col(section).isin(list(filed))).alias("filed"), count_where(F.col(section).isin(list(issued))).alias("issued"))


def breakdown(groups: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` largest groups (total, approved, denied) in whole percents, halves up; the rest of 100 is withdrawn."""
    share = lambda c: half_up(100.0 * F.col(c) / F.col("total"))
    shares = groups.select(key, "total", share("approved").alias("grant_pct"), share("denied").alias("deny_pct"))
    rest = F.greatest(F.lit(0).cast("long"), 100 - F.col("grant_pct") - F.col("deny_pct"))
    return shares.withColumn("withdrawn_pct", rest).orderBy(F.desc("total"), key).limit(k)
