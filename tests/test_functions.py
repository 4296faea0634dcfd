"""Scalars and parsers against known values."""

import datetime
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docketry.functions import dockets, reports, texts
from docketry.functions import scalars as s
from docketry.sources import vocabulary


def values(spark, inputs, make):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r["y"] for r in rows.select("k", make("x").alias("y")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("make", "pairs"),
    [
        (s.clean, [("  a ", "a"), ("   ", None), (None, None)]),
        (s.multi, [("a; b;;a", ["a", "b"]), ("", []), (None, None)]),
        (s.match_county, [("fulton COUNTY", "Fulton"), ("de-kalb", "DeKalb"), ("Ben Hill", "Ben Hill"), ("Nowhere", None), (None, None)]),
        (s.money, [("$4.5 million", Decimal("4500000.00")), ("about $1.2M", Decimal("1200000.00")), ("$1,234.50", Decimal("1234.50")), ("17", Decimal("17.00")), ("none", None), (None, None)]),
        (s.parse_date, [("2024-02-29", datetime.date(2024, 2, 29)), ("2/3/2024", datetime.date(2024, 2, 3)), ("2023-02-29", None), (None, None)]),
        (s.name_date, [("index_2024.05.31.jsonl", datetime.date(2024, 5, 31)), ("index-2024-02-31", None)]),
        (s.classify_family, [("DET-EQT2024-073", "DET-EQT"), ("LNR-ASC2026002", "LNR-ASC"), ("DETROIT 5", "CON"), ("LNR 2020", "DET"), ("CON-1", "CON")]),
        (s.bare_docket, [("2026-002 Some name", "CON-2026002"), ("2023013", "CON-2023013"), ("see 2026-002", None)]),
        (s.decision_level, [("3", 3), ("3 Superior Court Decision", 3), ("3 Desk Decision", None), ("9", None)]),
        (s.rule_label, [("con-ho-appointment", "HO Appointment"), ("det-letter", "Letter")]),
        (s.event_kind, [("Order · Court", "Order"), ("briefs", "Brief"), ("x", "Notice")]),
        (s.folder_type, [("a/1 Main Application/f.pdf", "Application/Request"), ("a/Z/f.pdf", None)]),
        (s.worth_ocr, [("a/B Appendices/x.pdf", False), ("a/Decision/Letter.pdf", True), ("a/APA Appeal/draft order.pdf", False), ("a/Other/x.pdf", True)]),
        (lambda c: s.seed_of(c), [("", 0.0), ("a", 0.097), ("ab", 0.105)]),
        (lambda c: s.match_vocabulary(c, vocabulary.SERVICE_TYPES), [(" nicu / PERINATAL", "NICU/perinatal"), ("Ambulatory surgery - multi-specialty", "Ambulatory surgery — multi-specialty"), ("MRIs", None)]),
        (lambda c: s.duration(F.length(c)), [("x" * 30, "1 month"), ("x" * 365, "1 yr"), ("x" * 800, "2 yrs 2 mo")]),
        (dockets.normalize_docket, [("Docket No. CON-1234567", "CON-1234567"), ("DET-EQT2024-073", "DET-EQT-2024-073"), ("Fulton 213", "FULTON-213"), ("GA1234567", "CON-1234567"), ("CON 21", None), ("CON-1234 and CON-5678", None), (None, None)]),
        (texts.html_text, [("<p>a<script>x</script> b </p>", "a\nb"), ("", ""), (None, None)]),
    ],
)
def test_scalars(spark, make, pairs):
    assert values(spark, [p[0] for p in pairs], make) == [p[1] for p in pairs]


def test_dockets_in_order_with_variants(spark):
    found = values(spark, ["LNR-ASC2005006, then con 2020-014 and CON2020-014; Clayton-12"], dockets.extract_dockets)[0]
    assert [(d["canonical"], d["kind"]) for d in found] == [("LNR-ASC-2005006", "LNR"), ("CON-2020-014", "CON"), ("CLAYTON-12", "COUNTY")]
    assert found[1]["variants"] == ["CON-2020-014", "CON2020-014", "con 2020-014"]


def test_ratio_depends_on_order(spark):
    row = spark.range(1).select(texts.ratio(F.lit("tide"), F.lit("diet")).alias("a"), texts.ratio(F.lit("diet"), F.lit("tide")).alias("b")).first()
    assert (row.a, row.b) == (0.25, 0.5)


REPORT = """Tracking Report
June 10, 2026 – June 16, 2026
Recently Approved Projects
2026-002 First Hospital (Fulton County)
Replace an imaging unit
Cost: $4.5 million Date Filed: 1/5/2026
1
DET-EQT2024-073 Second Clinic
Project: New scanner - OPPOSITION FILED
County: DeKalb
Recently Denied Applications
none
"""


def test_report_events(spark):
    rows = spark.createDataFrame([("r1", REPORT), ("r2", ""), ("r3", None)], "name string, text string")
    found = reports.report_events(rows, "name", "text").orderBy("entry").collect()
    assert [(r.section, r.docket_id, r.applicant, r.county) for r in found] == [("APPROVED", "CON-2026002", "First Hospital", "Fulton"), ("APPROVED", "DET-EQT-2024-073", "Second Clinic", "DeKalb")]
    assert (found[0].cost, found[0].filing_date) == (Decimal("4500000.00"), datetime.date(2026, 1, 5))
    assert (found[1].project_description, found[1].opposition) == ("New scanner", "OPPOSITION FILED")
    dates = {r.name: r.report_date for r in reports.report_dates(rows, "name", "text").collect()}
    assert dates["r1"] == datetime.date(2026, 6, 16)


def test_labels_are_found_in_one_pass(spark):
    def plain(line):
        """Label by label, longer ones first."""
        if "superiorcourtof" in "".join(c for c in line.lower() if c.isascii() and c.isalnum()):
            return []
        for phrase, field in sorted(((p, f) for f, phrases in reports.LABELS.items() for p in phrases), key=lambda x: -len(x[0])):
            words = r"\s*".join(w.replace(".", "[.]?") for w in phrase.split(" "))
            line = re.sub(rf"(?i)(?<![A-Za-z\x02]){words}\s*:", f"\x01{field}\x02", line)
        tidy = lambda v: re.sub(r"^[\s;,–—-]+|[\s;,–—-]+$", "", v).strip(" ") or None
        return [(p.split("\x02")[0], tidy(p.split("\x02")[-1])) for p in line.split("\x01")[1:]]

    rng = random.Random(3)
    phrases = [p for own in reports.LABELS.values() for p in own]
    piece = lambda: rng.choice([rng.choice(phrases), rng.choice(phrases).lower(), rng.choice(phrases).replace(" ", ""), "x", "5", " ", "Superior Court of", "é"])
    lines = ["".join(piece() + rng.choice([":", ": ", " : ", " ", "", ";"]) for _ in range(rng.randrange(1, 7))) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    marked = reports.labelled(F.col("line"))
    for r in df.select("line", reports.fields_of(F.array(marked)).alias("found")).collect():
        assert [tuple(f) for f in r.found] == plain(r.line), r.line
    one = spark.createDataFrame([("x Cost : 5",)], "line string").select(marked.alias("m")).first()
    assert one.m == "x \x01Cost\x02 5"
    heads = {"Project No. 5": True, "Pro-ject Number: 5": True, "Docket # 5": True, "\ufb01le no 5": True, "Projects: No": False, "Project Cost: 5": False, "# Docket": False, None: None}
    told = spark.createDataFrame([(x,) for x in heads], "line string").select("line", reports.numbered(F.col("line")).alias("n"), reports.leading(F.col("line")).alias("l")).collect()
    assert {r.line: r.n for r in told} == heads and all(r.l is None for r in told)


def test_similar_texts_are_compared_once(spark, monkeypatch):
    import pandas as pd

    calls = []

    class Counted(texts.SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(texts, "SequenceMatcher", Counted)
    (found,) = texts.ratio.func(iter([(pd.Series(["red bolt", None] * 50), pd.Series(["rad bolt", "x"] * 50))]))
    assert found.tolist() == [0.875, 0.0] * 50 and len(calls) == 2


def test_python_gets_pages_in_small_batches(spark):
    page = spark.range(5).select(texts.html_text(F.lit("<p>a</p>")).alias("x"))
    assert "BatchEvalPython" in page._jdf.queryExecution().executedPlan().toString() and {r.x for r in page.collect()} == {"a"}


def test_python_gets_vectors_in_small_batches(spark, monkeypatch):
    from docketry.operators import search

    sizes = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(search, "VECTOR_ROWS", 4)
    monkeypatch.setattr(search, "BATCH_BYTES", 4096)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    vectors = spark.range(400).selectExpr("id", "transform(sequence(1, 16), x -> cast(cos(id * x) as float)) AS v").repartition(1).cache()
    search.nearest(vectors, vectors.where("id % 50 = 0"), "id", "v", 3)  # sets the size

    def count(frames):
        for f in frames:
            sizes.add(1)
            yield f

    try:
        blocks = search.blocks(vectors, "id", "v", 4, "v").coalesce(1)
        assert blocks.mapInPandas(count, blocks.schema).count() > 1 and sizes.value > 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
