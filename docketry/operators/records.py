"""Versioned writes: merges, child replacement, snapshot diffs, change logs, ledgers. Each gives the table's next
version as a DataFrame, since Parquet tables take no updates; ``sources.tables`` swaps versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], direct: Sequence[str] = ()) -> DataFrame:
    """Next version of ``target``: a source row's value wins where it isn't null; in ``direct`` columns it wins
    always. Source keys must be unique (see ``fold``); rows of either side alone are kept."""
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("__hit"))
    on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    both = target.withColumn("__own", F.lit(True)).join(s, on, "full_outer")

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(c)
        if c in direct:
            return F.when(F.col("__hit"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.col(f"s_{c}"), F.col(c)).alias(c)

    return both.select(*[value(c) for c in target.columns])


def fold(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row for each key: of every column the last value that isn't null, by ``position``."""
    others = [c for c in rows.columns if c not in (*keys, position)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in others]
    return rows.groupBy(*keys).agg(*last)


def insert_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with those distinct rows whose key it lacks; nothing is deleted."""
    fresh = rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def replace_children(children: DataFrame, incoming: DataFrame, key: str, items: str) -> DataFrame:
    """Children anew for every key whose ``items`` array is there (even empty); a null array touches nothing.
    Children have columns key, sort_order and the items' fields."""
    named = incoming.where(F.col(items).isNotNull())
    kept = children.join(named.select(key), key, "left_anti")
    fresh = named.select(key, F.posexplode(items).alias("sort_order", "__item")).select(key, "sort_order", "__item.*")
    return kept.unionByName(fresh.select(*children.columns))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, old, new): rows of either snapshot that were added, deleted or modified, with whole records. A
    key must be unique in each (``snapshot`` sees to it)."""
    columns = [c for c in new.columns if c != key]
    o = old.select(F.col(key).alias("__k"), F.struct(*columns).alias("old"))
    n = new.select(F.col(key), F.struct(*columns).alias("new"))
    both = n.join(o, F.col(key) == F.col("__k"), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return both.select(F.coalesce(key, "__k").alias(key), change.alias("change"), "old", "new")


def picked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """The first or last row of each key by ``order``, by partial aggregation."""
    choose = F.max_by if last else F.min_by
    whole = choose(F.struct(*rows.columns), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(whole).select("__row.*")


def snapshot(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key by ``position``."""
    return picked(rows, [key], [position], True)


def change_details(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key columns, change, details): JSON of the whole record for added and deleted rows, and of old and new values
    of changed fields alone for modified ones."""
    field = lambda c: F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.struct(F.col(f"old.{c}").alias("old"), F.col(f"new.{c}").alias("new"))).alias(c)
    whole = F.to_json(F.coalesce("new", "old"))
    details = F.when(F.col("change") == "modified", F.to_json(F.struct(*[field(c) for c in columns]))).otherwise(whole)
    return changes.select(*[c for c in changes.columns if c not in ("old", "new")], details.alias("details"))


def revalidate(documents: DataFrame, changes: DataFrame, key: str, status: str = "validation_status") -> DataFrame:
    """Documents that were modified fall back to Unvalidated."""
    hit = changes.where("change = 'modified'").select(key).distinct().withColumn("__hit", F.lit(True))
    return documents.join(hit, key, "left").withColumn(status, F.when(F.col("__hit"), "Unvalidated").otherwise(F.col(status))).drop("__hit")


def first_by_digest(rows: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """The first row of each digest."""
    return picked(rows, [digest], order, False)


def stubs(events: DataFrame, matters: DataFrame, key: str = "docket_id") -> DataFrame:
    """Keys of events that no matter has yet."""
    return events.where(F.col(key).isNotNull()).select(key).distinct().join(matters.select(key), key, "left_anti")


def unprocessed(files: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files without a succeeded entry in the ledger; failed ones come again."""
    return files.join(ledger.where("status = 'succeeded'").select(*keys), list(keys), "left_anti")


def latest(entries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last entry of each key."""
    return picked(entries, keys, order, True)
