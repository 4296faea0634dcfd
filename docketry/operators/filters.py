"""Whitelisted filters, sorts and pages over one table of records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, MOST = 50, 500


def condition(column: Column, kind: str, value: object) -> Column:
    """``eq`` (case doesn't matter for text), ``like`` (anywhere; ``%`` and ``_`` are wildcards), ``gte`` or ``lte``."""
    if kind == "eq":
        return F.lower(column) == value.lower() if isinstance(value, str) else column == value
    if kind == "like":
        return F.lower(column.cast("string")).like("%" + str(value).lower().replace("\\", "\\\\") + "%")
    return column >= value if kind == "gte" else column <= value


def where_all(df: DataFrame, allowed: Mapping[str, tuple[str, str]], wanted: Mapping[str, object]) -> DataFrame:
    """Rows for which all wanted parameters hold. ``allowed`` maps a parameter to (column, kind); null values ask
    nothing; unknown parameters raise ``KeyError``. Null columns never match."""
    terms = [condition(F.col(allowed[name][0]), allowed[name][1], value) for name, value in wanted.items() if value is not None]
    return df.where(reduce(and_, terms)) if terms else df


def having_child(df: DataFrame, children: DataFrame, key: str, column: str, value: object) -> DataFrame:
    """Rows that have at least one child row with ``column`` = ``value``; rows aren't repeated."""
    return df.join(children.where(condition(F.col(column), "eq", value)).select(key), key, "left_semi")


def without_child(df: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return df.join(children.select(key), key, "left_anti")


def like_any(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows in which any of the columns contains the text."""
    return df.where(reduce(or_, [condition(F.col(c), "like", text) for c in columns]))


def with_flag(df: DataFrame, column: str, flag: str) -> DataFrame:
    """Rows whose JSON array in ``column`` holds ``flag``; bad JSON holds nothing."""
    return df.where(F.coalesce(F.array_contains(F.from_json(column, "array<string>"), flag), F.lit(False)))


def order(df: DataFrame, allowed: Mapping[str, str], spec: str, tie: Sequence[str]) -> DataFrame:
    """Sorted by one allowed key, ``-`` in front for descending, nulls first on ascending and last on descending;
    ties by ``tie``. Unknown keys raise ``KeyError``."""
    column = F.col(allowed[spec.removeprefix("-")])
    return df.orderBy(column.desc_nulls_last() if spec.startswith("-") else column.asc_nulls_first(), *[F.col(t) for t in tie])


def page(df: DataFrame, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    """One page of a sorted table; the limit is held within 1 to 500."""
    return df.offset(max(0, offset)).limit(min(MOST, max(1, limit)))


def envelope(df: DataFrame, allowed: Mapping[str, str], spec: str, tie: Sequence[str], limit: int = LIMIT, offset: int = 0) -> dict:
    """Items of a page with the total of all rows."""
    rows = page(order(df, allowed, spec, tie), limit, offset).collect()
    return {"items": [r.asDict(recursive=True) for r in rows], "total": df.count(), "limit": min(MOST, max(1, limit)), "offset": max(0, offset)}


def facet_filter(df: DataFrame, chosen: Mapping[str, Sequence[object]]) -> DataFrame:
    """Any of the chosen values within a facet, all facets together; facets without a choice ask nothing."""
    terms = [F.col(name).isin(*values) for name, values in chosen.items() if values]
    return df.where(reduce(and_, terms)) if terms else df


def facet_counts(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, value, rows) of each facet's values, from one pass over the table."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return df.select(named.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
