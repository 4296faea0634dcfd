"""Stored indexes, folds in parts, event-time windows and alerts on streams."""

import json
import os
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import scalars
from docketry.operators import intake, matching, records, search
from docketry.operators.text_index import TextIndex
from docketry.operators.vector_index import Codebook, VectorIndex, recall
from docketry.sources import readers, tables
from docketry.streaming import incremental

SF = "/root/testdata/sf0.1"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_text_index_finds_what_is_added(spark, tmp_path):
    texts = {1: "The Licence, the licensee", 2: "lí é 漢字 x9", 3: None, 4: "", 5: "a license of the 漢 kind: license of the", 6: "l le lic"}
    docs = lambda *ids: spark.createDataFrame([(k, texts[k]) for k in ids], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i"), "doc_id")
    with pytest.raises(ValueError):
        index.bm25("x").count()
    index.add(docs(1, 2, 3), "text")
    assert rows(index.prefix_search("licen")) == rows(search.prefix_search(docs(1, 2, 3), "doc_id", "text", "licen"))
    assert index.add(docs(1, 2, 3, 4, 5, 6), "text") == 3 and index.add(docs(4), "text") == 0 and len(index.segments()) == 2
    every = docs(*texts)
    for _ in range(2):  # in segments, then as one
        for query in ("the licen", "l", "lí", "漢", ""):
            assert rows(index.prefix_search(query)) == rows(search.prefix_search(every, "doc_id", "text", query)), query
        assert rows(index.phrase("license of the")) == [(5, 2)] and rows(index.phrase("the license")) == [] and rows(index.phrase("l LE")) == [(6, 1)]
        assert [r.doc_id for r in index.bm25("licence x9").collect()] == [1, 2] and index.bm25("").count() == 0
        index.merge()
    assert len(index.segments()) == 1


def test_text_index_reads_the_terms_partitions_alone(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = TextIndex(spark, str(tmp_path / "i"), "doc_id")
    index.add(docs, "text")
    found = index.prefix_search("licen")
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*range#\d+ = l\)", plan) and re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(token,licen\)", plan)
    ranges = index.postings().select("range").distinct().count()
    read = index.hits(["licen"], False).select("token").distinct().count()
    assert ranges > 20 and read < 20 and "documents.parquet" not in plan


@pytest.mark.parametrize("small", [False, True])
def test_text_index_stores_postings_in_blocks(spark, tmp_path, monkeypatch, small):
    from docketry.operators import text_index

    if small:  # many shares of a range, ids that are not broadcast, few words at once
        for name, value in (("SHARE", 50), ("SENT", 10), ("AT_ONCE", 700)):
            monkeypatch.setattr(text_index, name, value, raising=False)
    rng = random.Random(5)
    texts = {k: " ".join(rng.choice(["the", "The", "lí", "apache", "x9", "漢字", f"w{k % 7}"]) for _ in range(rng.randrange(12))) for k in range(400)} | {400: None, 401: "", 402: "the " * 3000}
    docs = spark.createDataFrame([*texts.items(), (None, "the")], "doc_id long, text string").repartition(3)
    index = TextIndex(spark, str(tmp_path / "i"), "doc_id")
    index.add(docs.where("doc_id % 2 = 0"), "text")
    assert index.add(docs, "text") == 201
    held = {}
    for k, t in texts.items():
        for at, w in enumerate((t or "").lower().split()):
            held.setdefault((w, k), []).append(at)
    for _ in range(2):
        assert {(r.token, r.doc_id): (r.tf, r.positions) for r in index.postings().collect()} == {x: (len(at), at) for x, at in held.items()}
        assert index.postings().count() == len(held) and index.documents().count() == len(texts)
        terms = [spark.read.parquet(f"{tmp_path}/i/{s}/terms") for s in index.segments()]
        assert sum(r.cf for t in terms for r in t.collect()) == sum(map(len, held.values())) and sum(r.df for t in terms for r in t.collect()) == len(held)
        stored = sum(spark.read.parquet(f"{tmp_path}/i/{s}/postings").count() for s in index.segments())
        assert stored < len(held) / 2, (stored, len(held))
        index.merge()


def test_vector_index_recall(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = VectorIndex(spark, str(tmp_path / "v"), "vec_id", "embedding")
    index.build(vectors.where("vec_id % 3 != 0"))
    index.add(vectors.where("vec_id % 3 = 0"))
    asked = vectors.where("vec_id % 50 = 0")
    exact = search.nearest(vectors, asked, "vec_id", "embedding", 10).cache()
    found = index.nearest(vectors, asked, 10).cache()
    share = recall(found, exact, "vec_id")
    assert share >= 0.9, share
    known = {(r.query, r.vec_id): r.score for r in exact.collect()}
    assert all(known[r.query, r.vec_id] == r.score for r in found.collect() if (r.query, r.vec_id) in known)
    assert found.groupBy("query").count().where("count != 10").count() == 0
    codes = spark.read.parquet(f"{tmp_path}/v/codes")
    assert codes.select(F.sum(F.size("ids"))).first()[0] == vectors.count() and codes.select("cell").distinct().count() > 20


def test_vector_index_edges(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0])], schema)
    index = VectorIndex(spark, str(tmp_path / "v"), "vec_id", "embedding")
    with pytest.raises(ValueError):
        index.build(few.limit(0))
    index.build(few)
    assert [(r.query, r.vec_id, r.score) for r in index.nearest(few, few.where("vec_id = 1"), 2, probes=9).orderBy("position").collect()] == [(1, 1, 1.0), (1, 5, 1.0)]
    hot = np.tile([[1.0, 2.0, 3.0]], (50, 1))
    assert len(Codebook.learnt(hot).cells) == 1


def plain_fold(given, state):
    out, now = {}, dict(state)
    for entry, number, axis2, codes in sorted(given, key=lambda r: (r[0], r[1])):
        shut, coded = now.get(entry, (False, False))
        shuts, opens, adds = axis2 == "Masterfile", axis2 not in (None, "Masterfile"), bool(codes)
        reason = "has codes" if shuts and coded else "closed" if adds and shut and not opens else None
        out[entry, number] = reason
        if reason is None:
            now[entry] = (shuts or (shut and not opens), coded or adds)
    return out, now


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_in_parts_equals_row_loop(spark, seed):
    rng = random.Random(seed)
    given = [(1 if rng.random() < 0.5 else rng.randrange(2, 40), k, rng.choice([None, None, "Order", "Masterfile"]), rng.choice([[], [], ["3.1"]])) for k in range(3000)]
    state = {k: (rng.random() < 0.5, rng.random() < 0.3) for k in range(0, 40, 2)}
    rng.shuffle(given)
    df = spark.createDataFrame(given, "entry_id int, row_number int, axis2 string, codes array<string>").repartition(6)
    held = spark.createDataFrame([(k, *v) for k, v in state.items()], "entry_id int, closed boolean, coded boolean")
    reasons, after = plain_fold(given, state)
    judged = matching.fold_axes(df, held).collect()
    assert {(r.entry_id, r.row_number): r.reason for r in judged} == reasons and all(r.accepted == (r.reason is None) for r in judged)
    assert rows(matching.folded_state(df, held)) == sorted(((k, *v) for k, v in after.items()), key=repr)
    # batch by batch with the state carried over is the same as at once
    first, second = df.where("row_number < 1300"), df.where("row_number >= 1300")
    then = matching.fold_axes(second, matching.folded_state(first, held)).collect()
    assert {(r.entry_id, r.row_number): r.reason for r in then} == {k: v for k, v in reasons.items() if k[1] >= 1300}
    assert matching.fold_axes(df.limit(0), held).count() == 0


def steps(spark, tmp_path, build, name):
    """Runs a stream anew for each file, as a restarted job would: its rows after each."""
    out = []

    def run():
        build().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").option("path", str(tmp_path / f"{name}-o")).trigger(availableNow=True).start().awaitTermination()
        out.append(rows(spark.read.parquet(str(tmp_path / f"{name}-o"))))
        return out[-1]

    return run


def source(spark, folder, schema):
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def put(folder, name, given):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(g) + "\n" for g in given))
    os.utime(folder / f"{name}.json", (1_700_000_000 + int(name),) * 2)  # files come in order of time


def test_alerts_once_and_expire(spark, tmp_path):
    folder = tmp_path / "in"
    event = lambda k, day, d: {"event_id": k, "ts": f"2024-01-{day:02}T00:00:00", "docket_id": d, "entry_id": k}
    watches = spark.createDataFrame([(1, "a", None, None, True), (2, None, 7, None, True), (3, "a", None, None, False)], "watch_id int, docket_id string, entry_id long, path_prefix string, active boolean")
    read = source(spark, folder, "event_id long, ts timestamp, docket_id string, entry_id long")
    run = steps(spark, tmp_path, lambda: incremental.alerts(read(), watches, "ts", "7 days").select("event_id", "watch_id"), "alerts")
    put(folder, "1", [event(7, 1, "a"), event(7, 1, "a"), event(8, 1, "b")])
    assert run() == [(7, 1), (7, 2)]
    put(folder, "2", [event(7, 2, "a"), event(9, 3, "a")])  # told before
    assert run() == [(7, 1), (7, 2), (9, 1)]
    put(folder, "3", [event(10, 30, "a")])
    run()
    put(folder, "4", [event(11, 30, "a"), event(9, 2, "a")])  # what is late goes, and the state with it
    assert run() == [(10, 1), (11, 1), (7, 1), (7, 2), (9, 1)]


def test_sessions_and_joins_of_streams_with_late_rows(spark, tmp_path):
    folder, other = tmp_path / "in", tmp_path / "other"
    event = lambda k, at: {"k": k, "ts": f"2024-01-{at}:00"}
    read = source(spark, folder, "k string, ts timestamp")
    run = steps(spark, tmp_path, lambda: incremental.session_counts(read(), "ts", "k", "30 minutes", "1 hour").select("k", "n"), "sessions")
    put(folder, "1", [event("a", "01T00:00"), event("a", "01T00:40"), event("b", "01T00:10")])
    put(folder, "2", [event("a", "01T00:20"), event("c", "05T00:00")])  # late, but in time: it joins two runs
    put(folder, "3", [event("c", "05T00:05")])  # a batch is judged by the watermark that the batches before the last have left
    put(folder, "4", [event("a", "01T00:30"), event("c", "05T00:10")])  # the first is too late
    put(folder, "5", [event("d", "09T00:00")])
    run()
    put(folder, "6", [event("d", "09T00:01")])
    assert run() == [("a", 3), ("b", 1), ("c", 3)]
    put(other, "1", [event("a", "01T00:05"), event("a", "01T03:00"), event("c", "04T23:30")])
    right = source(spark, other, "k string, ts timestamp")
    join = steps(spark, tmp_path, lambda: incremental.joined_within(read(), right().withColumnRenamed("ts", "r"), "k", "ts", "r", "1 HOUR", "2 days").select("k", F.date_format("ts", "dd HH:mm").alias("t")), "joins")
    assert join() == [("a", "01 00:20"), ("a", "01 00:40"), ("c", "05 00:00"), ("c", "05 00:05"), ("c", "05 00:10")]


def test_bucketed_merge_leaves_other_files_alone(spark, tmp_path):
    table = tables.BucketedTable(spark, str(tmp_path / "t"), "k bigint, v string, w string", ["k"], 16)
    every = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit("w").alias("w"))
    assert table.read().count() == 0 and table.merge(every.limit(0)) == 0 and table.merge(every) == 16
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    coming = spark.createDataFrame([(7, "new", None), (999, "first", "x")], "k bigint, v string, w string")
    touched = table.merge(coming)
    assert touched <= 2 and len(before - files()) == len({f.split("/")[1] for f in before - files()}) <= touched
    assert rows(table.read()) == rows(records.merge(every, coming, ["k"])) and table.read().count() == 201
    assert table.merge(coming, direct=["w"]) == touched and rows(table.read().where("k = 7")) == [(7, "new", None)]


def test_crosswalk_compares_few_pairs(spark):
    rng = random.Random(3)
    words = ["letter", "of", "intent", "appeal", "hearing", "order", "final", "agency", "exhibit", "review"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 5)))
    index = [(rng.randrange(3), k, name(), rng.choice([None, 1, 2])) for k in range(150)] + [(0, 500, "", 1), (1, 501, None, None)]
    files = [(k, d, f"{d} {n}x" if k % 4 else n.upper(), p) for k, (d, _, n, p) in enumerate(index[:90]) if n is not None] + [(900, 0, "0", 1), (901, 7, "alone", 1), (902, 1, None, 2)]
    left = spark.createDataFrame(files, "file_id int, docket_id int, stem string, pages int")
    right = spark.createDataFrame(index, "docket_id int, entry_id int, name string, pages int")
    strip = lambda t, d: re.sub(r"\s+", " ", (t or "").lower().replace(str(d), " ")).strip()
    wanted = {}
    for f, d, stem, pages in files:
        scores = []
        for block, entry, text, row_pages in index:
            if block == d:
                a, b = strip(stem, d), strip(text, d)
                a, b = (a, b) if a and b else ((stem or "").lower(), (text or "").lower())
                scores.append((-(SequenceMatcher(None, a, b).ratio() + (0.15 if pages is not None and pages == row_pages else 0.0)), entry))
        best = sorted(scores)[:5]
        sure = best and -best[0][0] >= 0.55 and (len(best) < 2 or best[1][0] - best[0][0] >= 0.08)
        wanted[f] = (best[0][1] if sure else None, [e for _, e in best])
    found = {r.file_id: (r.entry_id, [c.entry_id for c in r.candidates or []]) for r in matching.resolve_files(left, right).collect()}
    assert found == wanted
    pairs = matching.bounded_pairs(left, right)
    first, rest = matching.worth_verifying(pairs)
    assert first.count() + rest.count() < 0.5 * pairs.count()


def test_crosswalk_of_a_large_block_stores_no_pairs(spark, tmp_path):
    from functools import lru_cache

    rng = random.Random(4)
    names = [" ".join(rng.choices(["letter", "of", "intent", "appeal", "hearing", "order"], k=rng.randint(1, 4))) for _ in range(40)]
    index = [(7, rng.randrange(10**6), rng.choice(names), rng.choice([None, 1, 2])) for _ in range(600)] + [(8, 1, "order", 1)]
    files = [(k, 7, f"7 {rng.choice(names)}", rng.choice([None, 1])) for k in range(1100)] + [(5000, 8, "order", 1), (5000, 8, "order", 1), (None, 8, "order", 1), (5001, None, "order", 1)]
    left = spark.createDataFrame(files, "file_id int, docket_id int, stem string, pages int")
    right = spark.createDataFrame(index, "docket_id int, entry_id int, name string, pages int")
    ratio = lru_cache(None)(lambda a, b: SequenceMatcher(None, a, b).ratio())
    wanted = []
    for f, d, stem, pages in files:
        own = sorted((-(ratio(stem.replace(str(d), " ").strip(), text) + (0.15 if pages is not None and pages == p else 0.0)), entry) for block, entry, text, p in index if block == d and f is not None)
        own = [x for x in own for _ in range(2 if f == 5000 else 1)][:5]
        sure = own and -own[0][0] >= 0.55 and (len(own) < 2 or own[1][0] - own[0][0] >= 0.08)
        wanted.append((f, own[0][1] if sure else None, round(-own[0][0], 6) if own else 0.0, [(k + 1, e, round(-n, 6)) for k, (n, e) in enumerate(own)] or None))
    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path / "checkpoints"))
    try:
        found = [(r.file_id, r.entry_id, r.confidence, r.candidates and [tuple(c) for c in r.candidates]) for r in matching.resolve_files(left, right).collect()]
    finally:
        context.setCheckpointDir(before.rpartition("/")[0] if before else str(tmp_path))
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert sum(p.stat().st_size for p in (tmp_path / "checkpoints").rglob("part-*")) < 100_000


def test_counts_come_with_the_writing_job(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id": 1, "name": "a"}\n\n{"id": "x"}\nnot json\n{"id": 2}\n')
    counts = readers.load_snapshot(spark, str(tmp_path / "s.jsonl"), str(tmp_path / "out"))
    assert counts == {"lines": 4, "records": 2, "malformed": 2}
    good, bad = readers.read_snapshot(spark, str(tmp_path / "s.jsonl"))
    assert rows(spark.read.parquet(str(tmp_path / "out/kind=record")).select(*good.columns)) == rows(good) and spark.read.parquet(str(tmp_path / "out/kind=malformed")).count() == bad.count()
    raw = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "row_number int, v string")
    kept, rejects = matching.first_error(raw, [("v", F.col("v").isNull(), "missing")])
    assert intake.write_judged(kept, rejects, str(tmp_path / "judged")) == {"upserted": 2, "rejected": 1}
    assert rows(spark.read.parquet(str(tmp_path / "judged/status=rejected")).select("row_number", "message")) == [(2, "missing")]


def test_collated_keys_are_one(spark):
    own = scalars.collated(spark.createDataFrame([("CON-1", "a", None), ("DET-2", "b", None)], "docket string, v string, w string"), "docket")
    coming = scalars.collated(spark.createDataFrame([("con-1  ", None, "new"), ("det-3", "c", None)], "docket string, v string, w string"), "docket")
    merged = records.merge(own, coming, ["docket"])
    assert sorted((r.docket.lower().strip(), r.v, r.w) for r in merged.collect()) == [("con-1", "a", "new"), ("det-2", "b", None), ("det-3", "c", None)]
    assert own.unionByName(coming).select("docket").distinct().count() == 3 and own.join(coming, "docket").count() == 1
    assert records.unprocessed(coming, own.withColumn("status", F.lit("succeeded")), ["docket"]).count() == 1
    assert own.unionByName(coming).groupBy("docket").count().where("count = 2").count() == 1
