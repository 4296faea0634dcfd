"""Versions, folds, matching, readers and streams against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import filters, matching, records
from docketry.sources import readers, tables
from docketry.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_keeps_known_values(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, d string")
    source = spark.createDataFrame([(2, None, None), (3, "c", "z")], "k int, v string, d string")
    merged = records.merge(target, source, ["k"], direct=["d"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", "x"), (2, "b", None), (3, "c", "z")]
    assert sorted(records.merge(merged, source, ["k"], direct=["d"]).collect()) == sorted(merged.collect())


def test_fold_takes_last_known(spark):
    given = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (1, 3, "b", None)], "k int, n int, v string, w string")
    assert rows(records.fold(given, ["k"], "n")) == [(1, "b", "x")]


def test_diff_of_equal_tables_is_empty(spark):
    a = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert records.diff(a, a, "id").isEmpty()
    changes = records.diff(a, spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string"), "id")
    assert rows(changes.select("id", "change")) == [(1, "deleted"), (2, "modified"), (3, "added")]
    details = {r.id: json.loads(r.details) for r in records.change_details(changes, ["v"]).collect()}
    assert details[2] == {"v": {"new": "b"}} and details[3] == {"v": "c"}


def test_children_are_replaced_where_given(spark):
    children = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "k int, sort_order int, text string")
    coming = spark.createDataFrame([(1, [("x",), ("y",)]), (2, []), (3, None)], "k int, items array<struct<text:string>>")
    assert rows(records.replace_children(children, coming, "k", "items")) == [(1, 0, "x"), (1, 1, "y"), (3, 0, "c")]


def judge(own, shut, coded):
    out = []
    for n, axis, codes in sorted(own):
        opens = axis is not None and axis != "Masterfile"
        bad = (axis == "Masterfile" and coded) or (bool(codes) and shut and not opens)
        if not bad:
            shut = axis == "Masterfile" or (shut and not opens)
            coded = coded or bool(codes)
        out.append((n, not bad))
    return out


def test_axis_fold_in_order(spark):
    given = [(e, n, [None, "Masterfile", "Order"][(e * n) % 3], ["c"] if (e + n) % 2 else []) for e in range(1, 6) for n in range(1, 8)]
    state = [(e, e % 2 == 0, e % 3 == 0) for e in range(1, 5)]
    found = matching.fold_axes(spark.createDataFrame(given, "entry_id long, row_number long, axis2 string, codes array<string>"), spark.createDataFrame(state, "entry_id long, closed boolean, coded boolean"))
    known = {e: (c, d) for e, c, d in state}
    expected = [(e, n, ok) for e in range(1, 6) for n, ok in judge([(n, a, c) for x, n, a, c in given if x == e], *known.get(e, (False, False)))]
    assert rows(found.select("entry_id", "row_number", "accepted")) == sorted(expected)


def test_files_resolve_within_their_docket(spark):
    files = spark.createDataFrame([(1, "D1", "d1 site plan", 3), (2, "D1", "d1 letter", None), (3, "D9", "x", 1)], "file_id int, docket_id string, stem string, pages int")
    index = spark.createDataFrame([(10, "D1", "D1 Site Plan", 3), (11, "D1", "D1 Letter A", 1), (12, "D1", "D1 Letter B", 1)], "entry_id int, docket_id string, name string, pages int")
    found = {r.file_id: r.entry_id for r in matching.resolve_files(files, index).collect()}
    assert found == {1: 10, 2: None, 3: None}


def test_filters_ignore_case_and_missing(spark):
    df = spark.createDataFrame([(1, "Ab%c", 5), (2, None, 7), (3, "xAB", None)], "k int, t string, n int")
    allowed = {"t": ("t", "like"), "n": ("n", "gte")}
    assert rows(filters.where_all(df, allowed, {"t": "ab", "n": None}).select("k")) == [(1,), (3,)]
    assert rows(filters.where_all(df, allowed, {"t": "b%", "n": 1}).select("k")) == [(1,)]
    with pytest.raises(KeyError):
        filters.where_all(df, allowed, {"x": 1})


def test_snapshot_reader_parts_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "a"}\n\nnot json\n{"id": true}\n{"id": "7"}\n[1]\n{"id": 2, "pages": 3}\n')
    good, bad = readers.read_snapshot(spark, str(tmp_path))
    assert rows(good.select("id", F.coalesce("pages", F.lit(0)))) [0] == (1, 0)
    assert bad.where(F.col("line").contains("not json")).count() == 1 and bad.where(F.col("line").contains("true")).count() == 1


def test_stream_loads_each_file_once(spark, tmp_path):
    folder, schema = tmp_path / "in", "k bigint, v string"
    folder.mkdir()
    table = tables.VersionedTable(spark, str(tmp_path / "t"), schema)
    ledger = tables.VersionedTable(spark, str(tmp_path / "l"), incremental.LEDGER)
    run = lambda: incremental.load_files(spark, str(folder), schema, str(tmp_path / "c"), ledger, incremental.upsert_into(table, ["k"])).awaitTermination()
    (folder / "a.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    run()
    (folder / "b.json").write_text('{"k": 2, "v": null}\n{"k": 3, "v": "c"}\n')
    run()
    run()
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(ledger.read().select(F.substring_index("file", "/", -1), "status", "attempt", "rows")) == [("a.json", "succeeded", 1, 2), ("b.json", "succeeded", 1, 2)]


def test_snapshots_log_changes(spark, tmp_path):
    snapshots = tables.VersionedTable(spark, str(tmp_path / "s"), "id bigint, v string, n bigint")
    log = tables.VersionedTable(spark, str(tmp_path / "l"), "id bigint, change string, details string, version bigint")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id bigint, v string, n bigint")
    second = spark.createDataFrame([(1, "a", 1), (3, "c", 2)], "id bigint, v string, n bigint")
    assert [incremental.next_snapshot(snapshots, log, s, "id", "n") for s in (first, second)] == [0, 1]
    assert rows(log.read().select("id", "change", "version")) == [(2, "deleted", 1), (3, "added", 1)]
