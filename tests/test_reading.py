"""Dockets, reports, intake, lookups, readers and streams against known values and plain Python."""

import datetime
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docketry.functions import dockets, reports
from docketry.functions import scalars as s
from docketry.operators import filters, graphs, intake, lookups, matching, search
from docketry.sources import readers, tables, vocabulary
from docketry.streaming import incremental


def values(spark, inputs, make, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r["y"] for r in rows.select("k", make("x").alias("y")).orderBy("k").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FOUND = {
    "nothing here": [],
    "CON-1234567": ["CON-1234567"],
    "con 2020-014 and CON2020-014": ["CON-2020-014"],
    "DET04-21-003.": ["DET-04-21-003"],
    "lnr_asc2005006": ["LNR-ASC-2005006"],
    "DET EQT 2024 073": ["DET-EQT-2024-073"],
    "xCON-1234567 5CON-1234567": [],
    "CON-123": [],
    "DET-12": [],
    "DET-123": ["DET-123"],
    "CON-123456789": [],
    "CON-1234-1234567": ["CON-1234"],
    "Atlanta, GA 30303 and GA-123456": ["CON-123456"],
    "GA12345": [],
    "Fulton-213, BEN_HILL-45, Jeff Davis.7": ["FULTON-213", "BEN-HILL-45", "JEFF-DAVIS-7"],
    "Fulton 213": [],
    "Clayton-12 Clay-3": ["CLAYTON-12", "CLAY-3"],
    "CON–2021007": ["CON-2021007"],
}


def test_dockets_in_texts(spark):
    found = values(spark, [*FOUND, None, ""], dockets.extract_dockets)
    assert [[d["canonical"] for d in own] for own in found] == [*FOUND.values(), [], []]


def test_one_docket_meant(spark):
    meant = {"Docket No. CON-1234567": "CON-1234567", "Project #: LNR 2023-008": "LNR-2023-008", "(GA-1234567)": "CON-1234567", "Ben Hill 45": "BEN-HILL-45", "see CON-1234 and CON-5678": None, "the file CON-1234": "CON-1234", "": None, None: None}
    assert values(spark, list(meant), dockets.normalize_docket) == list(meant.values())


REPORT = """Some notices
Week of May 4, 2026 and after
May 1, 2026 – May 7, 2026
\f2Pending ReviewApplications
2026-014 River Hospital d/b/aRiver
A new wing with 20 beds
Filed: 4/14/2026 Deemed Complete: 4/16/2026
30thDayDeadline: 5/13/2026
Decision Deadline: 8/11/2026
Site: 12 Hill Road, Atown, GA30213 (Fulton County)
Estimated Cost: $24,793,000
Page 2 of 9
\f32026015 Lake Clinic (Richmond)
Widen the clinic - OPPOSITION FILED
Superior Court of Fulton County: Denies the petition
Agency Decision: Approved, 7/28/2025
Appealed By: Others, 8/27/2025
Appealed Determinations
LNR-EQT2022-035 Hill Imaging, LLC Request forLetter ofDetermination received on 4/5/2022,
regarding a second scanner. It goes on.
Agency Decision: Denied on7/27/2022
Requests for Extended Implementation/Effective Period
2023064 Oak Imaging
Build it
Request Received: 3/30/2026
Approved Cost: $5.1 million
Determination: Approved, April 9, 2026 Extended Mandatory Completion: October 24, 2026
Non-Filed or Incomplete Requests of the week
2026-099 belongs to the notes
Letters of Intent
none
"""


def test_report_with_lost_blanks(spark):
    found = reports.report_events(spark.createDataFrame([("r", REPORT)], "name string, text string"), "name", "text").orderBy("entry").collect()
    day = datetime.date
    told = [(r.section, r.docket_id, r.applicant, r.project_description, r.county, r.cost, r.opposition, r.filing_date, r.decision_deadline, r.decision_date) for r in found]
    assert told == [
        ("PENDING_APPLICATION", "CON-2026014", "River Hospital d/b/aRiver", "A new wing with 20 beds", "Fulton", Decimal("24793000.00"), None, day(2026, 4, 14), day(2026, 8, 11), None),
        ("PENDING_APPLICATION", "CON-2026015", "Lake Clinic", "Widen the clinic", "Richmond", None, "OPPOSITION FILED", None, None, day(2025, 7, 28)),
        ("APPEALED_DETERMINATION", "LNR-EQT-2022-035", "Hill Imaging, LLC", "a second scanner", None, None, None, day(2022, 4, 5), None, day(2022, 7, 27)),
        ("EXTENDED_IMPLEMENTATION", "CON-2023064", "Oak Imaging", "Build it", None, Decimal("5100000.00"), None, day(2026, 3, 30), None, day(2026, 4, 9)),
        ("OTHER", "CON-2026099", "belongs to the notes", None, None, None, None, None, None, None),
    ]
    texts = [("a", REPORT), ("b", "x\nWeek of 5/4/2026\nMay 1, 2026 – May 7, 2026"), ("c", "Report Date: 2026-05-04\n"), ("d", "top\nJune 3, 2026\nend"), ("e", "nothing")]
    dates = {r.name: r.report_date for r in reports.report_dates(spark.createDataFrame(texts, "name string, text string"), "name", "text").collect()}
    assert dates == {"a": day(2026, 5, 7), "b": day(2026, 5, 7), "c": day(2026, 5, 4), "d": day(2026, 6, 3)}


def test_dates_and_small_columns(spark):
    assert values(spark, ["Approved, 13/40/2026 then 4/9/26", "onApril 15, 2026", "2024-02-30 or 2024-02-29", "none", None], lambda c: reports.any_date(F.col(c))) == [datetime.date(2026, 4, 9), datetime.date(2026, 4, 15), datetime.date(2024, 2, 29), None, None]
    assert values(spark, ["Filed Jan 5, 2026 · x", "Feb 30, 2026 and Mar 1, 2026", "Foo 1, 2026"], s.stage_date) == [datetime.date(2026, 1, 5), datetime.date(2026, 3, 1), None]
    assert values(spark, ["$1.5 B", "3 thousand and $2", "5 apples", "12,000", "a $7.129"], s.money) == [Decimal("1500000000.00"), Decimal("3000.00"), None, Decimal("12000.00"), Decimal("7.13")]
    names = ["a/Main Application/Main Application.pdf", "a/Main Application/bates main application.pdf", "a/Decision/certificate decision.pdf", "a/Evaluation/my response.pdf", "a/Judicial Review/order.pdf", "a/x/y.pdf"]
    assert values(spark, names, s.worth_ocr) == [True, False, False, True, True, True]
    assert values(spark, ["con/CON2005029 Saint Co/x", "a\\con2005029\\y", "none"], lambda c: s.applicant_in_path(c, F.array(F.lit("CON-1"), F.lit("CON2005029")))) == ["Saint Co", None, None]
    assert values(spark, ["Big  Name!", "", "x" * 60], s.slug)[0].startswith("big-name-")
    named = spark.createDataFrame([(b"%PDF-1.4", "a.bin"), (b"\x89PNG", "a"), (b" <!DOCTYPE html>", "b"), (b"hello", "c.bin"), (b"\xff\xfe\x00", "d")], "c binary, n string")
    assert [r.k for r in named.select(s.sniff_type("c", "n").alias("k")).collect()] == ["pdf", "image", "html", "text", "unknown"]
    one = spark.createDataFrame([("x", None, datetime.datetime(2026, 1, 2, 3, 4, 5))], "a string, b string, t timestamp")
    assert one.select(s.labelled(some_name="a", other="b").alias("l"), s.iso_time("t").alias("t")).first() == ("Some name: x", "2026-01-02T03:04:05Z")


def test_export_rows_have_one_error_each(spark):
    given = [(1, "5", "CON-1234567", "x", "9", "Provisional"), (2, "y", "none", "", "3", "Validated"), (3, "6", "see", "", "", ""), (4, " 7 ", "DET-EQT2024-073", "12", "3 Superior Court Decision", None), (5, "8", "CON-7654321", "", "9", "")]
    good, bad = intake.shape_rows(spark.createDataFrame(given, "row_number int, entry_id string, docket_id string, bed_count string, decision_level string, validation_status string"))
    assert rows(bad) == [(1, "decision_level", "not a level from 1 to 5", "9"), (2, "entry_id", "missing or non-integer", "y"), (3, "docket_id", "missing or not a docket", "see"), (5, "decision_level", "not a level from 1 to 5", "9")]
    assert rows(good.select("entry_id", "docket_id", "docket_family", "bed_count", "decision_level", "validation_status", "warnings")) == [(7, "DET-EQT-2024-073", "DET-EQT", 12, 3, "Unvalidated", None)]


def test_text_records(spark):
    lines = ["[1]", '{"entry_id": true, "full_text": "a", "text_source": "ocr"}', '{"entry_id": "4", "full_text": "ab", "text_source": "OCR", "paragraphs": []}', '{"entry_id": 5, "full_text": "a", "text_source": "ocr", "paragraphs": [{"text": " "}]}', '{"entry_id": 6, "full_text": "a", "text_source": "ocr", "paragraphs": {"text": "a"}}', '{"entry_id": 7, "full_text": "a", "text_source": "ocr", "di_confidence": "x"}']
    good, bad = intake.shape_texts(spark.createDataFrame(list(enumerate(lines)), "row_number int, line string"))
    assert rows(good.select("entry_id", "char_count", "text_source", F.size("paragraphs"))) == [(4, 2, "ocr", 0)]
    assert [(r.row_number, r.field) for r in bad.orderBy("row_number").collect()] == [(0, "record"), (1, "entry_id"), (3, "paragraphs"), (4, "paragraphs"), (5, "di_confidence")]


def test_trees_of_any_depth_and_circles(spark):
    chain = [(k, k - 1 if k else None) for k in range(100)]
    found = {r.id: (r.root, r.level, r.path) for r in graphs.tree(spark.createDataFrame([*chain, (200, 201), (201, 200), (300, 999), (301, 300)], "id long, up long"), "id", "up").collect()}
    assert len(found) == 104 and found[99][:2] == (0, 99) and found[3] == (0, 3, "0/1/2/3") and found[301] == (300, 1, "300/301") and found[200] == (None, None, None)


def test_a_hot_entry_streams(spark):
    many = [(1, n, "Masterfile" if n % 3 == 0 else None, ["c"] if n % 3 == 1 else []) for n in range(30_000)]
    found = matching.fold_axes(spark.createDataFrame(many, "entry_id long, row_number long, axis2 string, codes array<string>"), spark.createDataFrame([], "entry_id long, closed boolean, coded boolean"))
    assert found.where("accepted").count() == 20_000 and found.where("reason = 'closed'").count() == 10_000


def test_lookups(spark):
    assert lookups.advanced("a b", " x y ", "", "Fulton", {"forum": "OSAH", "dkt": ""}) == ('a b "x y" Fulton', {"forum": ["OSAH"]})
    with pytest.raises(ValueError):
        lookups.one_of("x", ["a"])
    flags = spark.createDataFrame([(1, '["a", "b"]'), (2, "bad"), (3, None), (4, "[]")], "k int, f string")
    assert rows(filters.with_flag(flags, "f", "b").select("k")) == [(1,)]
    assert filters.envelope(flags, {"k": "k"}, "-k", ["k"], 2, 1) == {"items": [{"k": 3, "f": None}, {"k": 2, "f": "bad"}], "total": 4, "limit": 2, "offset": 1}
    a, b = (spark.createDataFrame(x, "k string, position int") for x in ([("p", 1), ("q", 2)], [("q", 1)]))
    assert [r.k for r in search.fused(a, b, "k").collect()] == ["q", "p"]
    assert search.prompt(spark.createDataFrame([(2, "b", "t2"), (1, "a", "t1")], "n int, k string, t string"), "k", "t", "n").first()[0] == "[1] a: t1\n[2] b: t2"
    assert rows(vocabulary.vocabulary(spark, "decision-levels"))[2] == (3, "Superior Court Decision")
    with pytest.raises(KeyError):
        vocabulary.vocabulary(spark, "x")


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_ROWS", 7)
    monkeypatch.setattr(search, "QUERY_ROWS", 3)
    vectors = spark.createDataFrame([(k, [float(k % 5), float(k % 3), 1.0] if k else [0.0, 0.0, 0.0]) for k in range(40)], "id long, v array<float>")
    found = search.nearest(vectors, vectors.where("id < 10"), "id", "v", 4).collect()
    data = {r.id: r.v for r in vectors.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for q in range(1, 10):
        score = lambda i: round(dot(data[q], data[i]) / (dot(data[q], data[q]) * dot(data[i], data[i])) ** 0.5, 6)  # noqa: B023, E731
        best = sorted((i for i in data if i), key=lambda i: (-score(i), i))[:4]
        assert [r.id for r in sorted((r for r in found if r["query"] == q), key=lambda r: r.position)] == best


def workbook(path, table):
    """A small XLSX file: shared strings for texts, numbers as they are."""
    texts = sorted({v for row in table for v in row if isinstance(v, str)})
    cell = lambda c, r, v: "" if v is None else f'<c r="{chr(65 + c)}{r}" t="s"><v>{texts.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(table, 1)) + "</sheetData></worksheet>")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"a ""b"", c"\n2,\n', encoding="utf-8")
    assert rows(readers.read_csv(spark, str(tmp_path / "a.csv"), ["id", "name"])) == [("1", 'a "b", c'), ("2", None)]
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"}, {"id": "2"}]')
    assert rows(readers.read_json_array(spark, str(tmp_path / "a.json"), ["id", "name"])) == [("1", "x"), ("2", None)]
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"entry_id": 1, "full_text": "a", "paragraphs": []}\nbad\n{"entry_id": 2}\n')
    good, bad = readers.read_texts(spark, str(folder))
    assert rows(good.select("entry_id", "has_paragraphs")) == [(1, True), (2, False)] and [r.line for r in bad.collect()] == ["bad"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        readers.read_texts(spark, str(tmp_path / "none"))
    files = tmp_path / "files" / "1.2 State Architect Files"
    files.mkdir(parents=True)
    for p in (files / "x.pdf", files.parent / "y.pdf", files.parent / "z.txt"):
        p.write_bytes(b"abc")
    assert [(r.path.rpartition("/")[2], r.size) for r in readers.list_files(spark, str(tmp_path / "files")).collect()] == [("y.pdf", 3)]
    workbook(tmp_path / "index.xlsx", [["Path", "Name", "Type", "Entry ID", "Page Count"], ["a\\b", "n", "pdf", 7, 3], ["c", "m", "pdf", None, 1], [None, "m", "pdf", 8, 1], ["d", "o", "pdf", 9, "many"]])
    assert rows(readers.read_workbooks(spark, str(tmp_path / "index.xlsx"))) == [("a\\b", "n", "pdf", 7, 3), ("d", "o", "pdf", 9, None)]
    tables.write_rejects(spark.createDataFrame([(1, "f", "m", "r")], "row_number int, field string, message string, raw_value string"), str(tmp_path / "rejects"))
    assert spark.read.csv(str(tmp_path / "rejects"), header=True).count() == 1


def test_tables_have_additions(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "k bigint")
    one = lambda k: spark.createDataFrame([(k,)], "k bigint")
    assert [table.append(one(1)), table.write(one(2)), table.append(one(3)), table.append(one(4))] == [0, 1, 2, 3]
    assert rows(table.read()) == [(2,), (3,), (4,)] and rows(table.read(1)) == [(2,)] and table.versions() == [1]


def test_failed_files_come_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.json").write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for v in "xy"))
    ledger = tables.VersionedTable(spark, str(tmp_path / "l"), incremental.LEDGER)
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "k bigint, v string")
    bad = {1, 3}

    def load(batch, batch_id):
        if batch.where(F.col("k").isin(*bad, -1)).count():
            raise RuntimeError("bad file")
        table.append(batch.drop(incremental.PLACE))
        return batch.count()

    def run(**more):
        incremental.load_files(spark, str(folder), "k bigint, v string", str(tmp_path / "c"), ledger, load, 2, **more).awaitTermination()
        return sorted((r.file[-6:-5], r.status, r.attempt, r.rows) for r in incremental.file_states(ledger).collect())

    fine = lambda k, n=1: (str(k), "succeeded", n, 2)
    assert run(stop=False) == [fine(0), ("1", "failed", 1, 0), fine(2), ("3", "failed", 1, 0), fine(4)]  # beside a bad file all load at once
    (folder / "5.json").write_text(json.dumps({"k": 5, "v": "x"}) + "\n" + json.dumps({"k": 5, "v": "y"}) + "\n")
    bad.discard(3)
    assert run(stop=False) == [fine(0), ("1", "failed", 2, 0), fine(2), fine(3, 2), fine(4), fine(5)]
    assert intake.sweep_counts(incremental.file_states(ledger).replace("succeeded", "processed", "status")).first() == (5, 1, 0)
    assert run(stop=False, attempts=2)[1] == ("1", "failed", 2, 0)  # no tries left
    bad.clear()
    assert run()[1] == fine(1, 3) and run()[1] == fine(1, 3)
    assert rows(table.read()) == sorted((k, v) for k in range(6) for v in "xy")  # each once
    with pytest.raises(Exception, match="1 files failed"):
        bad.add(7)
        (folder / "7.json").write_text(json.dumps({"k": 7, "v": "x"}) + "\n")
        run()
    bad.clear()
    assert run()[-1] == ("7", "succeeded", 2, 1)


def test_snapshots_have_names(spark, tmp_path):
    snapshots, log, names = (tables.VersionedTable(spark, str(tmp_path / x), schema) for x, schema in (("s", "id bigint, v string, n bigint"), ("g", "id bigint, change string, details string, version bigint"), ("n", "name string, version bigint")))
    first, second = (spark.createDataFrame([(1, v, 1)], "id bigint, v string, n bigint") for v in "ab")
    taken = [incremental.next_snapshot(snapshots, log, df, "id", "n", name, names) for df, name in ((first, "one"), (second, "one"), (second, "two"))]
    assert taken == [0, 0, 1] and log.read().count() == 1


def test_streams_of_events(spark, tmp_path):
    folder = tmp_path / "e"
    folder.mkdir()
    given = [("2024-01-01T00:00:00", "a"), ("2024-01-01T01:00:00", "a"), ("2024-01-02T00:00:00", "b")]
    (folder / "a.json").write_text("".join(json.dumps({"ts": t, "digest": d}) + "\n" for t, d in given))
    read = lambda: spark.readStream.schema("ts timestamp, digest string").json(str(folder))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.table(name))

    assert [r[1] for r in run(incremental.distinct_events(read(), "ts", "digest"), "once", "append")] == ["a", "b"]
    assert [(r[1], r[2]) for r in run(incremental.windowed_counts(read(), "ts", "digest"), "counted", "complete")] == [("a", 2), ("b", 1)]
    watches = spark.createDataFrame([(1, "b", None, None, True), (2, "a", None, None, False)], "watch_id int, docket_id string, entry_id long, path_prefix string, active boolean")
    met = read().select(F.col("digest").alias("docket_id"), "ts").join(lookups.active_only(watches).select("docket_id", "watch_id"), "docket_id")
    assert [r[2] for r in run(met, "met", "append")] == [1]
    marked, top = incremental.changed_since(spark.createDataFrame([(1,), (5,)], "n int"), "n", 1)
    assert rows(marked) == [(5,)] and top == 5 and incremental.changed_since(marked, "n", 9)[1] == 9


def test_watches_are_met_once_without_a_shuffle_of_pairs(spark):
    rows = [(k % 97, k % 7, k % 11, f"a/{k % 5}/x") for k in range(100)] + [(None, 1, 1, "a/1/x"), (500, None, None, None)]
    live = [(k % 37, k % 7 if k % 2 else None, k % 11 if k % 3 else None, f"a/{k % 5}/" if k % 4 else None, k % 9 != 0) for k in range(40)]
    events = spark.createDataFrame(rows, "event_id long, docket_id long, entry_id long, path string")
    watches = spark.createDataFrame(live, "watch_id long, docket_id long, entry_id long, path_prefix string, active boolean")
    found = lookups.watched(events, watches)
    met = {(e, w) for e, d, n, p in rows for w, wd, wn, wp, on in live if on and ((wd is not None and d == wd) or (wn is not None and n == wn) or (wp is not None and p is not None and p.startswith(wp)))}
    pairs = [(r.event_id, r.watch_id) for r in found.collect()]
    assert len(pairs) == len(met) and set(pairs) == met
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_pairs_of_watched_folders_are_stored_in_little(spark, tmp_path):
    events = spark.range(4000).select(F.col("id").alias("event_id"), F.lit(None).cast("long").alias("docket_id"), F.lit(None).cast("long").alias("entry_id"), F.concat(F.lit("a/"), (F.col("id") % 40).cast("string"), F.lit("/x")).alias("path"))
    watches = spark.range(24000).select(F.col("id").alias("watch_id"), F.lit(None).cast("long").alias("docket_id"), F.lit(None).cast("long").alias("entry_id"), F.concat(F.lit("a/"), (F.col("id") % 40).cast("string"), F.lit("/")).alias("path_prefix"), F.lit(True).alias("active"))
    lookups.watched(events, watches).select("event_id", "watch_id").write.parquet(f"{tmp_path}/met")
    met = spark.read.parquet(f"{tmp_path}/met")
    assert met.count() == met.distinct().count() == 4000 * 600 and met.where("event_id % 40 != watch_id % 40").isEmpty()
    assert sum(p.stat().st_size for p in (tmp_path / "met").glob("*.parquet")) < 4000 * 600 // 2


def test_first_citation_takes_the_first_row_of_a_repeated_id(spark, tmp_path):
    from docketry.operators import graphs
    from docketry.plans.carriers import Carriers

    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp, l_quantity double"
    rows = [(2, 1, 7, "A", "F", None, 4.0), (1, 1, 7, "A", "F", None, None), (1, 2, 7, "A", "F", None, 9.0), (1, 2, 7, "A", "F", None, 3.0), (5, 1, 8, "A", "F", None, None)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = graphs.first_citation(Carriers(spark, str(tmp_path)).placed_citations, "cited", "cite", "cite_id", "file", "place")
    assert {r.cited: r.cite for r in found.collect()} == {7: "1 R. 9", 8: None}


def test_authorities_without_a_case_are_not_dealt_to_one_task(spark):
    cited = "citation_id long, citing_entry_id long, cited_entry_id long, cited_statute_id string, cited_external string, treatment string, pinpoint string, snippet string, topic_id int"
    made = [(k, k % 400, 3 if k % 100 == 0 else None, None, f"Ext {k}", None, None, None, None) for k in range(2000)]
    documents = spark.createDataFrame([(k, k, f"Case {k}") for k in range(400)], "entry_id long, docket_id long, title string")
    frames = [([], "docket_id long, docket_family string"), ([], "entry_id long, court_docket_no string"), ([], "topic_id int, key_number string"), ([], "statute_id string, kind string, citation_label string, title string"), ([], "entry_id long, cite_id int, citation string")]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        page = graphs.citator_report(spark.createDataFrame(made, cited), documents, *(spark.createDataFrame(r, x) for r, x in frames))
        rest = page.where("part = 'authority' AND kind = 'external'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in rest) == 1980 and max(r["count"] for r in rest) < 990
