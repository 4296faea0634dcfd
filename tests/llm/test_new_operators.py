"""Whitening, fill-in-the-middle and quality rules against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("docketry.llm")

from docketry.llm import bpe, infill, lines, ngram_join, quality, substrings, whitening  # noqa: E402

DOCS = "doc_id long, text string, lang string, key string, n long, form string, kept boolean, output string, n_words long"
VECTORS = "vec_id long, embedding array<float>, label int, key string, x long, n long, dims int, whitened double"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "k", 1, "f", True, "o", 2) for k, t in rows], DOCS).repartition(3)


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "k", 2, 3, 4, 5.0) for k, v in rows], VECTORS).repartition(5)


def grid(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def brute_white(rows, components=4):
    """By the exact integer covariance matrix and its eigenvectors."""
    left = [(k, grid(v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in left})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    moved = np.array([[n * c - t for c, t in zip(x, s, strict=True)] for x in fit], float) / n
    values, vecs = np.linalg.eigh(moved.T @ moved / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    out = {}
    for k, x in left:
        centred = [n * c - t for c, t in zip(x, s, strict=True)]
        for j in range(components):
            out.setdefault((k, j + 1), []).append((n, sum(c * c for c in centred), float(np.array(centred, float) / n @ vecs[:, j]) / math.sqrt(values[j]), values[j] / values.sum()))
    return out


def same_but_sign(found, wanted):
    signs = {}
    assert sum(map(len, found.values())) == sum(map(len, wanted.values()))
    for at, rows in wanted.items():
        for own, ref in zip(sorted(found[at]), sorted(rows), strict=True):
            assert own[:2] == ref[:2] and own[3] == pytest.approx(ref[3], rel=1e-9)
            assert abs(own[2]) == pytest.approx(abs(ref[2]), abs=1e-8)
            if abs(ref[2]) > 1e-6:
                assert signs.setdefault(at[1], own[2] * ref[2] > 0) == (own[2] * ref[2] > 0)


@pytest.mark.parametrize("dims, n", [(5, 40), (12, 7), (16, 3000)])
def test_whitening_equals_eigenvectors(spark, dims, n):
    rng = np.random.default_rng(dims)
    mixed = rng.normal(size=(n, dims)) @ (np.diag(np.arange(1, dims + 1) ** 1.5) @ rng.normal(size=(dims, dims))) + 3
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(mixed)]
    rows += [(k % 9, rows[0][1]) for k in range(n)] + [(1000 + n, None), (1001 + n, [None] * dims), (1002 + n, [math.nan] * dims), (1003 + n, [math.inf, *[0.0] * (dims - 1)]), (None, rows[1][1])]
    out = whitening.whitened_components(vectors(spark, rows)).collect()
    found = {}
    for r in out:
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    same_but_sign(found, brute_white(rows))
    assert max(r.identity_error for r in out) == min(r.identity_error for r in out) < 1e-9


def test_merging_is_lossless_in_any_order():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (400, 9)) * np.arange(1, 10) + 10**6
    whole = whitening.summary(x)
    parts = [whitening.summary(p) for p in np.split(x, [1, 2, 30, 190, 191])]
    random.Random(4).shuffle(parts)
    while len(parts) > 1:
        parts.append(whitening.merged(parts.pop(0), parts.pop(0)))
    assert parts[0].sums == whole.sums and parts[0].n == whole.n and parts[0].rows.shape == (9, 9)
    assert np.allclose(parts[0].rows.T @ parts[0].rows, whole.rows.T @ whole.rows, rtol=1e-11)


def test_many_partitions_merge_by_levels(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(300, 6)) * [1, 2, 3, 4, 5, 6])]
    fit = whitening.gridded(vectors(spark, rows), "vec_id", "embedding").select("x").repartition(70)
    models = whitening.fitted(fit)
    x = np.array([grid(v) for _, v in rows], float)
    assert models[6].n == 300 and models[6].sums == x.sum(axis=0).tolist()
    assert np.allclose(models[6].values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], rtol=1e-10)


def test_whitening_edges(spark):
    white = lambda rows: sorted(tuple(r) for r in whitening.whitened_components(vectors(spark, rows)).collect())
    assert white([]) == [] and white([(1, None), (2, []), (3, [math.nan])]) == []
    one = white([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [r[:4] for r in one] == [(1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0)] and {r[4] for r in one} == {r[6] for r in one} == {None}
    flat = white([(k, [float(k), 5.0, -0.0]) for k in range(4)])  # one dimension varies
    assert {r[4] is None for r in flat if r[1] == 1} == {False} and {r[4] for r in flat if r[1] > 1} == {None} and flat[0][6] < 1e-12
    two = white([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [3.0])])  # lengths are spaces of their own
    assert [r[:3] for r in two] == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 2), (4, 1, 2)]
    huge = white([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1e10, 1.0])])
    assert {r[3] for r in huge if r[0] < 3} == {None} and len(huge) == 6
    model = whitening.Model(3, [5 * 10**9, 1], np.ones(2), np.eye(2))
    assert model.centred(np.array([[2 * 10**9, 7]]))[1] == [10**18 + 400]


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text)


def brute_infill(doc_id, text):
    text, u = text or "", units(text or "")
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 20
    return doc_id, len(u), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def infill_rows():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abXYZ  é漢\n\t<>PSM😀0", k=rng.choice([1, 2, 5, 40, 600, 1500]))) for _ in range(150)]
    texts += ["<P", "<S>", "a<M>b", "<", "P>", "x" * 5000 + " " + "y" * 5000, "漢字\r\n" * 3000, "A" * 511 + "é" + "b" * 600, "\x00a\x00"]
    return [*enumerate(texts), (500, None), (501, ""), (None, "null id"), (502, "word, " * 100_000), (1, texts[1]), (1, texts[1])]


def test_infill_equals_brute_force(spark):
    rows = infill_rows()
    found = infill.output_digests(documents(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((brute_infill(*r) for r in rows), key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infill.output_digests(documents(spark, [])).count() == 0


def test_infill_pieces_never_cut_units():
    for _, text in infill_rows():
        cuts = {0, *itertools.accumulate(map(len, units(text or "")))}
        bounds = list(infill.pieces(text or ""))
        assert all(a in cuts and b in cuts for a, b in bounds) and sum(b - a for a, b in bounds) == len(text or "")


def repeats(words):
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def brute_quality(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, rep = len(words), repeats(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    inside = lambda spans: len({k for i, m in spans for k in range(i, i + m)})
    in3, in10 = inside((i, 3) for i, m in enumerate(rep) if m >= 3), inside((i, m) for i, m in enumerate(rep) if m >= 10)
    spans = sum(m >= 10 and not (i and rep[i - 1] > m) for i, m in enumerate(rep))
    failed = n < 50 or 100 * in3 > 50 * n
    longest = max(rep, default=0)
    kept = not failed and 10 * in10 <= 3 * n and not (longest >= 50 and 4 * longest > n)
    return doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), in3, in10, longest, spans, failed, kept


def test_quality_equals_brute_force(spark):
    rng = random.Random(6)
    some = lambda k, letters: " ".join("".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(k))
    texts = [some(rng.choice([1, 10, 49, 50, 90, 150]), rng.choice(["ab", "abcdé", "abcdefghijklmnop#*<>|"])) for _ in range(80)]
    wide = "abcdefghijklmnopqrstuvwxyz"
    passage = some(20, wide)
    texts += [f"{some(80, wide)} {passage} {some(60, wide)}\n{passage}\n\t{some(k, wide)}" for k in (0, 10, 40)]  # 40 words of some 200
    texts += [f"{passage} {some(60, wide)} {passage}", *(f"{some(30, wide)} {(p := some(k, wide))} {some(95, wide)} {p}" for k in (49, 50, 60))]
    texts += ["", " \n\t", "a", "w " * 300, "x\ny\nx\n\n\nx \n x", "line\r\nline\r\n", "\x1c\x85\xa0 a\xa0b"]
    rows = [*enumerate(texts), (900, None), (None, texts[5]), (3, texts[3]), (3, texts[3])]
    found = quality.quality(documents(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((brute_quality(*r) for r in rows), key=repr)
    assert any(r.kept for r in found) and any(not r.kept and not r.base_failed for r in found)
    assert quality.quality(documents(spark, [])).count() == 0


def test_quality_of_long_texts(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400_000)]
    rng.shuffle(words)
    words[200_000:200_030] = words[10:40]
    long = "  ".join(words)
    assert len(long) > 2 * quality.PIECE
    (r,) = quality.quality(documents(spark, [(1, long)])).collect()
    assert (r.n_words, r.n_covered, r.n_repeat_words, r.longest_repeat, r.n_repeats, r.kept) == (400_000, 60, 60, 30, 2, True)
    assert quality.numbered(long.encode()).tolist() == [*range(200_000), *range(10, 40), *range(200_000, 399_970)]
    one = quality.numbered(b"a" * (3 * quality.PIECE))
    assert one.tolist() == [0]


def twins(a, b, size):
    """Two sequences whose polynomial hashes are equal modulo a power of two for every odd base."""
    bits = [bin(k).count("1") & 1 for k in range(size)]
    return [(a, b)[k] for k in bits], [(b, a)[k] for k in bits]


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_no_text_collides_for_every_base(spark, kind):
    shared = [f"w{k}" for k in range(30)]
    if kind == "bytes":
        one, two = ("".join(t) for t in twins("a", "b", 2048))
        texts = [" ".join([*shared, x, *reversed(shared)]) for x in (one, two)]
        short = [one, two]
    else:
        one, two = twins("left", "right", 2048)
        texts = [" ".join(x) for x in (one, two)]
        short = texts
    rows = documents(spark, list(enumerate(texts)))
    removed = {r.doc_id: r.n_removed for r in substrings.kept_digests(rows).collect()}
    words = [t.split() for t in texts]
    windows = [[tuple(w[k : k + 50]) for k in range(len(w) - 49)] for w in words]
    again = {k + o for k, x in enumerate(windows[1]) if x in set(windows[0]) for o in range(50)}
    assert removed == {0: 0, 1: len(again)} and (kind == "words" or not again)
    components = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(spark, list(enumerate(short)))).collect()}
    grams = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} or {tuple(w)} for w in (s.split() for s in short)]
    linked = 100 * len(grams[0] & grams[1]) >= 85 * len(grams[0] | grams[1])
    assert components == {0: 0, 1: 0 if linked else 1} and (kind == "words" or not linked)


def test_hashes_of_runs():
    from docketry.llm import word_hash as wh

    rng = random.Random(8)
    p = (1 << 61) - 1
    a = [rng.randrange(p) for _ in range(200)] + [0, 1, p - 1]
    b = [rng.randrange(p) for _ in range(200)] + [p - 1, p - 1, p - 1]
    assert wh.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b, strict=True)]
    values = np.array([rng.randrange(1 << 64) for _ in range(300)], np.uint64)
    base = int(wh.RUN) % p
    starts, ends = np.array([0, 0, 5, 299, 7, 100]), np.array([0, 300, 9, 300, 290, 230])
    plain = [sum(int(v) * pow(base, k, p) for k, v in enumerate(values[s:e])) % p for s, e in zip(starts, ends, strict=True)]
    assert wh.runs(values, starts, ends, wh.RUN).tolist() == wh.mix(np.array(plain, np.uint64)).tolist()
    few = np.array([rng.randrange(257) for _ in range(300)], np.uint64)  # as bytes are, which take a shorter way
    plain = [sum(int(v) * pow(base, k, p) for k, v in enumerate(few[s:e])) % p for s, e in zip(starts, ends, strict=True)]
    assert wh.runs(few, starts, ends, wh.RUN).tolist() == wh.mix(np.array(plain, np.uint64)).tolist()
    for left, right in (twins(1, 2, 1024), twins(3, 9, 4096)):
        x = np.array([*left, *right], np.uint64)
        h = wh.runs(x, np.array([0, len(left)]), np.array([len(left), len(x)]), wh.BASE)
        assert h[0] != h[1]
    long = ["x" * wh.LONG_WORD + c for c in "aba"]
    (found,) = [wh.Words(d, o).hash for _, d, o in wh.chunks(pa.array([" ".join(long)]), 1 << 23)]
    assert found[0] == found[2] != found[1]


def test_lines_are_measured_in_code_points(spark):
    from docketry.llm import word_hash as wh

    texts = ["abcdefghij", "abcdefgh\U00010400\U00010401", "\U00010400\U00010401 é漢", "a--b", ""]
    data = "".join(texts).encode()
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = lines.form_lengths(wh.Words(np.frombuffer(data, np.uint8), ends, wh.LOWER, lines.MARKS))
    assert found.tolist() == [10, 10, 5, 3, 0] and lines.alike(found[:1], found[1:2]).all()
    with pytest.raises(ValueError):
        lines.line_digests(documents(spark, [(1, "x")]), similarity=0.7)


def test_toxicity_on_held_out_labels(spark):
    from docketry.llm import catalog

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL")
    rows = catalog.QUERIES["op4_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    area = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    caught = sum(r.predicted for r in rows if r.toxic)
    assert area > 0.98 and caught / len(bad) > 0.9 and sum(r.predicted for r in rows) - caught <= 0.02 * caught


def test_no_text_collides_for_the_bases_in_the_code(spark):
    from docketry.llm import word_hash as wh

    one, two = "kmjllnolnmlqkikl", "omqnnmkolnnipqpo"
    (found,) = [wh.Words(d, o).hash for _, d, o in wh.chunks(pa.array([f"{one} {two}"]))]
    assert found[0] == found[1]
    shared = [f"w{k}" for k in range(30)]
    rows = documents(spark, [(k, " ".join([*shared, x, *reversed(shared)])) for k, x in enumerate([one, two, one])])
    assert {r.doc_id: r.n_removed for r in substrings.kept_digests(rows).collect()} == {0: 0, 1: 0, 2: 61}
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(spark, list(enumerate([one, two, one])))).collect()} == {0: 0, 1: 1, 2: 0}


def test_subtrees_see_all_pieces_of_a_prefix_after_a_join(spark):
    """A join that has dealt the pieces by their prefix and then becomes a broadcast one reads them where they lie."""
    body = "cast(array_join(transform(sequence(1, 60), k -> concat('w', id % 50, '-', k)), ' ') as binary) words"
    pieces = spark.range(0, 400, 1, 8).selectExpr("id % 50 core", "id % 50 first", "id stretch", "id low", "0 at", "11 count", "id part", body)
    few = spark.range(0, 50, 1, 4).selectExpr("id core").where("core % 7 >= 0").distinct()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = substrings.in_subtrees(pieces.join(few, "core", "left_semi"), 50, substrings.drawn())
        assert {r.stretch: len(r.offsets) for r in found.collect()} == dict.fromkeys(range(50, 400), 11)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_substrings_of_one_word_in_a_crowded_group(spark):
    texts = ["x " * (50 + k) for k in range(12)] + ["y " + "x " * 49]
    found = substrings.kept_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=2)
    assert {r.doc_id: r.n_removed for r in found.collect()} == {0: 0, 12: 0} | {k: 50 + k for k in range(1, 12)}


def test_merges_look_up_pairs_beside_a_merge_alone():
    import public_tokenizers

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    model = bpe.ForcedBoundaryBPE(bpe.content_of(public_tokenizers.path("word_bpe_49k.json")), bpe.unicode_rules())
    model.ranks = Counted(model.ranks)
    word = "internationalisationandthereforehowevernotwithstandingthis"
    assert "".join(model.texts[k] for k in model.fragment(word, True)) == word + model.end and model.ranks.asked < 3 * len(word)
