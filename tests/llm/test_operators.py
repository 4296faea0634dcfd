"""The ten operators and the pipeline against brute force on small tables with nulls, empty and long texts, repeated
rows and columns whose names clash."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("docketry.llm")

import public_tokenizers  # noqa: E402
import tokenizers  # noqa: E402
from docketry.llm import bpe, common, decontaminate, licenses, lines, media, ngram_join, secrets, shards, substrings, toxicity  # noqa: E402
from docketry.llm.word_hash import Words, chunks  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, comp long, shard int, media binary"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def table(spark, pairs):
    return spark.createDataFrame([(k, t, "en", f"src{(k or 0) % 3}", len(t or ""), 7, "k", 1, 2, b"x") for k, t in pairs], SCHEMA)


def sample(seed=3, n=60):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 7))) for _ in range(300)] + ["Éa", "ñu", "the", "The", "of"]
    text = lambda k: " ".join(random.choices(vocabulary, k=k))
    passage = text(70)
    out = [(k, text(random.choice([1, 3, 4, 30, 90, 200]))) for k in range(1, n)]
    for k in range(n, 2 * n):
        words = random.choice(out)[1].split(" ")
        if k % 3:
            words[random.randrange(len(words))] = "changed"
        if k % 5 == 0:
            words = [*text(8).split(), *passage.split(), *text(9).split()]
        out.append((k, ("  " if k % 7 == 0 else " ").join(words) + ("\n" + text(12)) * (k % 4)))
    long = text(30_000)
    return [*out, (500, None), (501, ""), (502, " \n\t"), (503, long), (504, long + " end"), (503, long), (505, "a\nb\n"), (506, "A B C"), (507, "a b c"), (None, passage), (None, None)]


@pytest.fixture(scope="module")
def pairs():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, pairs):
    return table(spark, pairs).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_components(spark):
    random.seed(1)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    found = {r.id: r.comp for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = {}
    for x in parent:
        if any(root(y) == root(x) for y in parent if y != x):
            groups.setdefault(root(x), set()).add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(x for x in found if found[x] == c) for c in set(found.values())}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_words_are_bytes_between_separators():
    import pyarrow as pa

    texts = ["a  b", "", "é x\n", None, "b"]
    found = []
    for _, data, offsets in chunks(pa.array(texts), 4):
        w = Words(data, offsets)
        found += [[data[a:b].tobytes().decode() for a, b in zip(w.starts[x:y], w.ends[x:y], strict=True)] for x, y in zip(w.first, w.first[1:], strict=False)]
    assert found == [WORD.findall(t or "") for t in texts]


def test_secrets_keep_base_findings(spark):
    key = "".join(random.Random(5).choices("0123456789abcdef", k=40))
    texts = [f'password: "abcdef{k}"' for k in range(30)] + [f"x {key[k:]}{key[:k]} y AKIA{'Q2' * 8}" for k in range(20)] + [None, "", "secret=abc", "é api_key = ZZZZZZ"]
    found = secrets.secret_spans(table(spark, list(enumerate(texts)))).collect()
    for r in found:
        text = texts[r.doc_id] or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base.sort(key=lambda f: (f[1], ["assign", "access", "hex"].index(f[0])))
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        kinds = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(said)))
        assert set(said) <= set(filter(None, r.spans.split(",")))


def test_automaton_prefers_its_format():
    random.seed(2)
    keys = ["ak-" + "".join(random.choices("0123456789", k=12)) for _ in range(200)]
    shape = lambda v: v.translate(secrets.SYMBOLS)
    follows = Counter()
    for token in ("".join(random.choices("abcdefgh", k=15)) for _ in range(300)):
        follows.update("".join(p) for p in zip(" " + shape(token), [*shape(token), ""], strict=True))
    model = secrets.learn({0: [shape(k) for k in keys[:150]]}, follows)
    assert np.mean([secrets.gain(model, shape(k)) >= model["least"] for k in keys[150:]]) > 0.9
    assert secrets.gain(model, shape("abcdefghabcdefgh")) < model["least"]


def test_candidates_are_all_that_base_findings_leave(spark, empty):
    """Against marking each character: tokens of 6 and more, also beside base findings, in texts of any script."""
    random.seed(14)
    texts = ["é" * k + "password=abcdef-12 " + "xyzw99.secret: qwerty77/" + "f" * 26 + "zz9 éabcdefgé " * 3 for k in range(3)]
    for text in [*texts, "".join(random.choices("ab0Z+é =:", k=3000)), "token=abcdefg " * 4000 + "longtoken9 " * 4000, ""]:
        base, data = secrets.base_findings(text), text.encode()
        inside = {k for s, _, e, _ in base for k in range(s, e)}
        marked = "".join("\n" if k in inside or c not in set(secrets.CLASSES) | set('+/_.=-') else c for k, c in enumerate(text))
        expected = [(len(text[: m.start()].encode()), m[0].translate(secrets.SYMBOLS).encode()) for m in re.finditer("[^\n]{6,}", marked)]
        assert [(s, shape) for s, _, shape in secrets.candidates(data.translate(secrets.SHAPES), secrets.covered_bytes(text, data, base))] == expected
    assert secrets.secret_spans(empty).isEmpty()


def test_grammar_findings_of_a_known_format(spark):
    """Tokens of a labelled format outside any assignment are found, words are not, also in repeated and null rows."""
    random.seed(15)
    key = lambda: "-".join("".join(random.choices("0123456789", k=4)) for _ in range(4))
    words = lambda k: " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(3, 10))) for _ in range(k))
    texts = [f"{words(30)} token={key()} {words(9)}" for _ in range(300)]
    bare = [f"é {words(20)} {key()} {words(20)}" for _ in range(50)]
    plain = [words(40) for _ in range(50)]
    docs = table(spark, [*enumerate(texts + bare + plain), (None, None), (None, bare[0]), (7, texts[7])])
    found = secrets.secret_spans(docs).collect()
    assert len(found) == 403
    for r in found:
        if r.doc_id is not None and r.doc_id >= 300:
            text = (texts + bare + plain)[r.doc_id]
            keys = [f"grammar:{m.start()}:{m.end()}" for m in re.finditer(r"\d{4}(-\d{4}){3}", text)]
            assert r.n_grammar == len(keys) and r.spans == ",".join(keys), (r, text)


def test_lines_keep_one_of_each_group(spark, docs, pairs, empty):
    found = {(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in lines.line_digests(docs).collect()}
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    distinct = sorted(set(pairs), key=lambda p: (p[0] is None, p[0] or 0))
    forms = {}
    for d, text in distinct:
        for k, line in enumerate((text or "").split("\n")):
            form = " ".join(words.findall(line.translate(LOW)))
            if form:
                forms.setdefault(form, []).append((d, k))
    own = list(forms)
    import pyarrow as pa

    sims = np.concatenate([lines.simhashes(Words(data, offsets, lines.LOWER, lines.MARKS)) for _, data, offsets in chunks(pa.array(own))])
    group = list(range(len(own)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(own)):
        for b in np.flatnonzero(np.bitwise_count(sims[:a] ^ sims[a]) <= lines.BITS).tolist():
            if distance(own[a], own[b]) <= 0.2 * max(len(own[a]), len(own[b])) + 1e-9:
                group[root(a)] = root(b)
    places = {}
    for k, form in enumerate(own):
        places.setdefault(root(k), []).extend(forms[form])
    gone = {p for at in places.values() for p in sorted(at, key=lambda p: (p[0] is None, p[0] or 0, p[1]))[1:]}
    for d, text in distinct:
        if d is not None:
            kept = [line for k, line in enumerate((text or "").split("\n")) if (d, k) not in gone]
            n = text.count("\n") + 1 if text else 0
            assert (d, n, n - len(kept) if n else 0, sha("\n".join(kept))) in found
    assert lines.deduplicated(docs).columns == docs.columns and lines.deduplicated(docs).count() == len(pairs)
    assert lines.line_digests(empty).isEmpty()


def distance(a, b):
    """Edit distance after common ends."""
    begin = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    a, b = a[begin:], b[begin:]
    end = next((k for k, (p, q) in enumerate(zip(a[::-1], b[::-1], strict=False)) if p != q), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_edit_distance():
    random.seed(7)
    for _ in range(300):
        a, b = ("".join(random.choices("abé", k=random.randrange(12))) for _ in range(2))
        assert lines.edit_distance(a, b, 50) == distance(a, b)
        most = random.randrange(4)
        assert (lines.edit_distance(a, b, most) <= most) == (distance(a, b) <= most)


def test_shards_are_even_and_gapless(docs, pairs, empty):
    found = shards.hilbert_shards(docs).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(pairs) and max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards.SHARDS)) <= 1
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(sizes[k])) for k in sizes)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in pairs)
    assert shards.hilbert_shards(empty).isEmpty()


def test_shards_follow_the_curve_and_prune(spark, docs, pairs, tmp_path):
    found = sorted(shards.hilbert_shards(docs).collect(), key=lambda r: (r.shard, r.slot))
    assert all(a.hilbert <= b.hilbert for a, b in zip(found, found[1:], strict=False))
    random.seed(31)
    many = spark.createDataFrame([(k, "x" * random.choice([1, 40, 900]), f"l{random.randrange(4)}", f"s{random.randrange(6)}", 3) for k in range(4800)], "doc_id long, text string, lang string, source string, shard int")
    shards.write_shards(many.unionByName(many.where("doc_id < 5")), f"{tmp_path}/shards")
    written = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(written.columns) == sorted(many.columns) and sorted(r[0] for r in written.select("doc_id").collect()) == sorted([*range(4800), *range(5)])
    for column in ("lang", "source"):  # a value is in few shards, where rows by id have it in all
        met = written.groupBy(column).agg(F.countDistinct("shard").alias("n")).agg(F.avg("n")).first()[0]
        assert met <= 14 and written.groupBy(column, (F.col("doc_id") % 24).alias("s")).count().count() / written.select(column).distinct().count() == 24


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(shards.hilbert_index(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_ftrl_follows_its_formula():
    """Against one update at a time over plain dictionaries."""
    random.seed(51)
    given = [(np.array(sorted(random.sample(range(30), random.randrange(1, 6)))), random.randrange(2)) for _ in range(400)]
    model, z, n = toxicity.FTRL(5), Counter(), Counter()
    for row, label in given:
        model.learn(row, label)
        at = [*row.tolist(), 32]
        w = {i: 0.0 if abs(z[i]) <= model.l1 else -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + n[i] ** 0.5) / model.alpha) for i in at}
        slope = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            z[i] += slope - ((n[i] + slope**2) ** 0.5 - n[i] ** 0.5) / model.alpha * w[i]
            n[i] += slope**2
    assert np.allclose(model.z, [z[i] for i in range(33)]) and np.allclose(model.n, [n[i] for i in range(33)])


def test_toxicity_takes_one_text_of_each_id(spark):
    docs = table(spark, [(1, "aa bb")] * 50 + [(1, "cc dd"), (2, "ee ff"), (3, "x" * 100_000)])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 53 and len({r.score for r in found if r.doc_id == 1}) <= 2


def test_toxicity_learns_words(spark, empty):
    random.seed(4)
    texts = [" ".join(random.choices(["tree", "river", "stone", "cloud", "leaf"], k=30) + (["vileword"] if k % 3 == 0 else [])) for k in range(600)]
    docs = table(spark, [*enumerate(texts), (900, None), (901, "")])
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(600)] + [(None, 1, 1), (900, None, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    judged = [r for r in found if r.held_out and r.doc_id < 600]
    assert judged and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in judged]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found) and len(found) == 602
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in found)
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(empty, labels).isEmpty()


def test_suffix_trees_have_common_lengths():
    random.seed(41)
    for _ in range(30):
        parts = [[random.randrange(2 + random.randrange(3)) for _ in range(random.randrange(1, 40))] for _ in range(4)]
        values = np.array([v for p in parts for v in p])
        ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        order, common = substrings.suffix_tree(values, ends, 10)
        suffix = lambda i: values[i : ends[i]].tolist()[:31]  # noqa: B023, E731
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), common[1:].tolist(), strict=True):
            x, y = suffix(a), suffix(b)
            assert n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        prefixes = [tuple(suffix(i)[:10]) for i in order.tolist() if len(suffix(i)) >= 10]
        assert sum(p != q for p, q in zip(prefixes[1:], prefixes, strict=False)) == max(0, len(set(prefixes)) - 1)  # equal ones stand together


@pytest.mark.parametrize("group", [500, 2, 0])
def test_substrings_leave_first_documents(docs, pairs, empty, group):
    texts = {p: WORD.findall(p[1] or "") for p in pairs}
    number = lambda d: substrings.LAST if d is None else d
    first = {}
    for d, t in pairs:
        for k in range(len(texts[d, t]) - 49):
            window = tuple(texts[d, t][k : k + 50])
            first[window] = min(first.get(window, substrings.LAST), number(d))
    expected = Counter()
    for d, t in pairs:
        words = texts[d, t]
        gone = {w for k in range(len(words) - 49) if first[tuple(words[k : k + 50])] < number(d) for w in range(k, k + 50)}
        expected[d, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))] += 1
    assert rows(substrings.kept_digests(docs, group=group), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert substrings.kept_digests(empty).isEmpty()


def test_licenses_are_found_and_confirmed(spark, pairs, empty):
    notices = [("mit", "Released under the MIT License."), ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0.")]
    given = [(k, f"{t}\n{notices[k % 3][1]}" if k and k % 2 and t else t) for k, t in pairs]
    docs = table(spark, given)
    for r in licenses.license_paragraphs(docs).collect():
        if r.doc_id is not None and r.doc_id < 500:
            assert r.families == (notices[r.doc_id % 3][0] if r.doc_id % 2 else ""), r
    assert licenses.license_paragraphs(empty).isEmpty()


def test_media_is_stored_and_read_back(docs, pairs, empty):
    expected = Counter()
    for d, t in pairs:
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        expected[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert rows(media.payload_features(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == expected
    assert media.payload_features(empty).isEmpty()


def test_validators_tell_whole_files(spark):
    """Files of each format, alone and within other bytes, whole and cut off."""
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0\x3f\0abc\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\nmore\nstartxref\n20\n%%EOF"
    page = lambda flags, n, body: b"OggS\0" + bytes([flags]) + bytes(8) + b"SERI" + struct.pack("<I", n) + bytes(4) + bytes([1, len(body)]) + body
    ogg = page(2, 0, b"head") + page(0, 1, b"abc") + page(4, 2, b"end")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 10)
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data"
    webp = b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd"
    gif = b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b"
    bmp = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    files = {"image/png": png, "image/jpeg": jpeg, "application/pdf": pdf, "application/ogg": ogg, "application/zip": out.getvalue(), "video/mp4": mp4, "image/webp": webp, "image/gif": gif, "image/bmp": bmp, "application/gzip": gzip.compress(b"x" * 3_000_000), "audio/wav": media.to_wave(b"12345678")}
    machine = media.automaton()
    for kind, content in files.items():
        assert (0, len(content), kind) in media.find_media(content, machine), kind
        inside = media.find_media(b"text before " + content + b" and after", machine)
        if kind != "application/pdf":
            assert (12, len(content), kind) in inside, kind
        if kind not in ("video/mp4", "application/pdf"):  # what is left of these is a shorter file
            assert not any(t == kind and a == 0 for a, _, t in media.find_media(content[:-3], machine)), kind
    given = [(1, png, "image/jpeg"), (2, b"some words", "text/plain"), (3, b"note " + png + b" - " + ogg, "text/plain"), (4, None, None), (5, b"", "image/png"), (6, webp, "image/webp")]
    found = {r.doc_id: r for r in media.sniff(spark.createDataFrame(given, "doc_id long, body binary, said string"), "doc_id", "body", "said").collect()}
    assert (found[1].type, found[1].corrected) == ("image/png", True) and (found[6].type, found[6].corrected) == ("image/webp", False)
    assert [(m.offset, m.length, m.type) for m in found[3].media] == [(5, len(png), "image/png"), (8 + len(png), len(ogg), "application/ogg")]
    assert found[2].type == found[4].type == found[5].type == media.UNKNOWN and not found[4].corrected


def test_media_inside_other_bytes():
    wave = media.to_wave(b"12345678")
    found = media.find_media(b"..RIFFxx BM" + wave + b"tail", media.automaton())
    assert found == [(11, len(wave), "audio/wav")] and media.samples(wave) == b"12345678"


def test_contamination_by_windows(spark, docs, pairs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, next(t for d, t in pairs if d == 60)), (2, "a b c"), (3, None), (4, ""), (5, " ".join(pairs[5][1].split()[:20])), (5, "A B C")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        own = word.findall((t or "").translate(LOW))
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            grams.setdefault(tuple(own[k : k + n]), set()).add(i)
    expected = Counter()
    for d, t in pairs:
        own = word.findall((t or "").translate(LOW))
        hit, named = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(own) - n + 1):
                if found := grams.get(tuple(own[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= found
        expected[d, len(own), len(hit), len(named), sha(",".join(sorted(map(str, named)))), bool(hit) and 20 * len(hit) >= len(own)] += 1
    out = decontaminate.contamination(docs, benchmark)
    assert rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    shuffled = decontaminate.contamination(docs, benchmark, broadcast_bytes=0)
    assert rows(shuffled, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    cleaned = {(r.doc_id, r.text) for r in decontaminate.without_hits(docs, benchmark).collect()}
    for d, t in pairs:
        spans, at = [m.span() for m in word.finditer((t or "").translate(LOW))], set()
        own = [t[a:b].translate(LOW) for a, b in spans]
        for n in {len(g) for g in grams}:
            at |= {w for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in grams for w in range(k, k + n)}
        gone = {c for w in at for c in range(*spans[w])}
        assert (d, t and "".join(c for k, c in enumerate(t) if k not in gone)) in cleaned
    assert decontaminate.decontaminate(docs, benchmark).count() == sum(n for k, n in expected.items() if not k[-1])
    assert decontaminate.contamination(empty, benchmark).isEmpty()
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


def test_jaccard_components(docs, pairs, empty):
    sets = []
    for _, t in pairs:
        own = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(own[k : k + 4]) for k in range(max(1, len(own) - 3))) if own else frozenset())
    group = list(range(len(pairs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0:
                group[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(pairs):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    expected = Counter((d, len(sets[k]), least.get(root(k)) if sets[k] else d) for k, (d, _) in enumerate(pairs))
    assert rows(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == expected
    kept = ngram_join.keep_one(docs).collect()
    assert len(kept) == len({root(k) for k in range(len(pairs)) if sets[k]}) + len({p for k, p in enumerate(pairs) if not sets[k]})
    assert ngram_join.jaccard_components(empty).isEmpty()


def test_cells_lose_no_pair():
    """Pairs found in the cell of the first common key, by leaf and by tree, hold all similar ones."""
    import pyarrow as pa

    random.seed(6)
    members = [sorted(random.sample(range(160), random.randint(80, 120))) for _ in range(150)]
    members += [sorted(random.sample(range(5000), random.randint(900, 1100))) for _ in range(50)]
    for k in range(60):  # near copies, and sets with many members in one group
        members.append(sorted({*members[random.randrange(200)][3:], 6000 + k}))
        members.append(sorted({64 * x for x in random.sample(range(60), 50)}))
    size = np.array([len(m) for m in members])
    doc, value = np.repeat(np.arange(len(size)), size), np.concatenate([np.array(m, np.uint64) for m in members])
    vecs = ngram_join.count_vectors(doc, value, size)
    found = {"leaf": set(), "tree": set()}
    for key in range(160):
        rows = [k for k, m in enumerate(members) if key in m]
        if len(rows) > 1:
            pos = np.array([members[k].index(key) for k in rows])
            heads = pa.array([np.array(members[k][:p], np.uint16).tobytes() for k, p in zip(rows, pos, strict=True)], pa.binary())
            sets = ngram_join.Sets(np.array(rows), np.array(rows), size[rows], pos, heads, pa.array([vecs[k] for k in rows], pa.binary()), 60)
            at = np.arange(len(rows))
            for name, pairs in (("leaf", ngram_join.leaf_pairs(sets, np.zeros(1, int), np.array([len(rows)]))), ("tree", ngram_join.tree_pairs(sets, at, at)), ("tree", ngram_join.tree_pairs(sets, at[:9], at[9:]))):
                found[name] |= {tuple(sorted((rows[a], rows[b]))) for a, b in pairs[:2].T.tolist()}
    sets = [set(m) for m in members]
    near = {(a, b) for b in range(len(sets)) for a in range(b) if min(sets[a] & sets[b], default=999) < 160 and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    assert len(near) > 60 and near <= found["leaf"] and near <= found["tree"]


@pytest.mark.parametrize(("dense", "sent"), [(0, 0), (4, 1_000_000)])
def test_dense_families_are_joined(spark, monkeypatch, dense, sent):
    """Families of near copies around the threshold, in cells of several blocks, whichever cells count as dense, with
    the candidates' places broadcast or not."""
    monkeypatch.setattr(common, "SMALL_ROWS", sent)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    random.seed(16)
    texts = []
    for family in range(3):
        base = [f"w{family}x{k}" for k in range(160)]
        for _ in range(70):
            words = list(base)
            for at in random.sample(range(160), random.randint(0, 4)):
                words[at] = f"c{random.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(157)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table(spark, list(enumerate(texts)))).collect()}
    assert found == dict(enumerate(group)) and 3 < len(set(group)) < 210


def test_bpe_equals_the_library(docs, pairs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    expected = Counter()
    for d, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert rows(bpe.encoding_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert bpe.encoding_digests(empty, path).isEmpty()
    model = bpe.ForcedBoundaryBPE(bpe.content_of(path), bpe.unicode_rules())
    for text in ("It's 12 o'clock…", "ÀÉ ñ ǅ İ", "日本語  x", "<|endoftext|> a", "é a‍b"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    random.seed(10)
    for text in ("".join(random.choices("abeinrst", k=20_000)), "a" * 3000, "thethe" * 400):
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids
    encoded = bpe.encode_documents(docs, path)
    assert rows(encoded.withColumn("n", F.size("ids")), "doc_id", "n") == Counter({k: n for k, n in Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs).items()})
    shown = Counter((d, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in pairs)
    assert rows(bpe.decode_documents(encoded, path), "doc_id", "text") == shown


def test_new_words_are_encoded_at_once_as_one_by_one(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    random.seed(31)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aet", "aà日éß", "0123456789", "!?.,-_#=", "thеinа"]
    words = list({"".join(random.choices(random.choice(kinds), k=random.choice([1, 2, 3, 6, 9, 20, 64]))) for _ in range(5000)})
    texts = [" ".join(words[k : k + 250]) for k in range(0, len(words), 250)] + ["", "<|endoftext|> " + words[0], "a" * 200 + " " + words[1]]
    model = bpe.ForcedBoundaryBPE(bpe.content_of(path), bpe.unicode_rules())
    one_by_one = []
    monkeypatch.setattr(model, "word", lambda w, own=model.word: one_by_one.append(w) or own(w))
    for seen in (1 << 20, 1 << 12):
        for text, (n, said, decoded) in zip(texts, model.digests(texts), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert (n, said, decoded) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert seen < 1 << 20 or {len(w) > bpe.LONG for w in one_by_one} == {True}
        monkeypatch.setattr(bpe, "REMEMBERED", 100)  # in the second round what is known is cleared again and again
        monkeypatch.setattr(bpe, "SEEN", 1 << 12)
        model.known.clear()


def test_ids_are_given_out_as_counted(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.encoding_digests(docs, path, with_ids=True).join(docs.select("doc_id", "text"), "doc_id").select("ids", "n_tokens", "ids_sha256").distinct().collect()
    assert found and all(len(r.ids) == r.n_tokens and sha(" ".join(map(str, r.ids))) == r.ids_sha256 for r in found)


def test_python_gives_memory_back_after_a_task():
    released = []
    run = common.returned(lambda batches: (b * 2 for b in batches))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda _: released.append(1)})())
        given = run(iter([1, 2]))
        assert next(given) == 2 and not released
        assert list(given) == [4] and released


def test_line_dedup_leaves_no_signatures(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    lines.removed_lines(docs).count()
    tables = [spark.read.parquet(str(t)).columns for t in tmp_path.glob("tables/*/*")]
    assert tables and not [c for c in tables if "sig" in c or "leader" in c]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    random.seed(9)
    pairs = [p for p in sample(8, 30) if p[0] is not None]
    item = " ".join(f"bench{k}" for k in range(30))
    docs = [*pairs, (700, f"{item} tail"), (701, "a clean text of a few words alone"), (702, "a clean text of a few words alone")]
    table(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 701 in kept and 702 not in kept and 700 not in kept
    assert kept[701].n_tokens == len(kept[701].ids)


def test_near_lines_are_found_by_edit_similarity(spark):
    """All pairs by edit similarity alone: one typo in a line of any length, words changed, a block of a sixth."""
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrst", k=random.randint(3, 8)))
    texts = []
    for k in range(300):
        words = [word() for _ in range((2, 4, 8, 12, 20, 60)[k % 6])]
        line, n = " ".join(words), len(words)
        at = random.randrange(len(line))
        texts += [line, f"{line[:at]}z{line[at + 1 :]}"]
        if n >= 8:
            for x in random.sample(range(n), n // 8):
                words[x] = word()
            size = len(line) // 6
            at = random.randrange(len(line) - size)
            texts += [" ".join(words), line[:at] + "z" * size + line[at + size :]]
    forms = [" ".join(re.findall("[a-z]+", t)) for t in texts]
    near = {b for a in range(len(forms)) for b in range(a + 1, min(a + 4, len(forms))) if lines.edit_distance(forms[a], forms[b], 500) <= 0.2 * max(len(forms[a]), len(forms[b]))}
    removed = {r.doc_id for r in lines.line_digests(table(spark, list(enumerate(texts)))).collect() if r.n_removed}
    assert len(near) > 500 and len(near - removed) <= len(near) // 100 and removed <= near


def test_pairs_of_a_large_group_of_near_lines_are_not_made(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    passage, made = [word() for _ in range(14)], []
    for _ in range(500):
        own = list(passage)
        for k in rng.sample(range(14), rng.randint(1, 2)):
            own[k] = word()
        made.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    seen, real = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda forms, pairs, similarity: seen.append(pairs.count()) or real(forms, pairs, similarity))
    assert sum(r.n_removed for r in lines.line_digests(docs).collect()) == 499
    assert sum(seen) < 5000


@pytest.mark.parametrize("size", [0, 1, 30, 63, 64, 65, 130, 700])
def test_edit_distances_together(size):
    rng = random.Random(size)
    pairs = []
    for _ in range(300):
        a = rng.choices("abcdé字 ", k=size)
        b = [rng.choice("abé😀") if rng.random() < 0.2 else c for c in a if rng.random() > 0.05] + rng.choices("ab", k=rng.randint(0, 2))
        pairs.append(("".join(a), "".join(b)))
    most = np.array([max(len(a), len(b)) // 5 for a, b in pairs])
    assert lines.within(pairs, most).tolist() == [lines.edit_distance(a, b, int(m)) <= m for (a, b), m in zip(pairs, most, strict=True)]


def test_lines_against_all_pairs_of_a_corpus(spark):
    """Recall over lines of the smallest tables, judged by edit similarity of all pairs alone."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    forms = list(dict.fromkeys(" ".join(word.findall(line.translate(LOW))) for t in texts if t for line in t.split("\n")))
    forms = [f for f in forms if f][:2500]
    letters = np.array([np.bincount([ord(c) % 64 for c in f], minlength=64) for f in forms], np.int32)
    long = letters.sum(axis=1)
    near, any_near = set(), set()
    for b in range(1, len(forms)):
        most = (0.2 * np.maximum(long[:b], long[b]) + 1e-9).astype(int)
        apart = np.abs(letters[:b] - letters[b]).sum(axis=1)
        for a in np.flatnonzero(((apart + np.abs(long[:b] - long[b])) // 2 <= most)).tolist():
            if lines.edit_distance(forms[a], forms[b], int(most[a])) <= most[a]:
                near.add(b)
                any_near |= {a, b}
    removed = {r.doc_id for r in lines.line_digests(table(spark, list(enumerate(forms)))).collect() if r.n_removed}
    assert removed <= any_near
    assert len(near & removed) >= 0.9 * len(near), (len(near), len(near & removed))


@pytest.mark.parametrize("sent", [0, 10**9])
def test_lines_by_broadcast_and_by_shuffle(spark, docs, monkeypatch, sent):
    expected = rows(lines.line_digests(docs), "doc_id", "n_removed", "kept_sha256")
    monkeypatch.setattr(lines, "LINES_SENT", sent)
    assert rows(lines.line_digests(docs), "doc_id", "n_removed", "kept_sha256") == expected


def test_wrapped_licenses_are_found(spark, pairs):
    notices = {
        "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use.',
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    }
    given, expected = [(k, t) for k, t in pairs if k is not None and k < 100], {}
    for k, (family, notice) in enumerate(notices.items()):
        for width in (50, 72):
            for mark in ("", " * "):
                d = 1000 + len(expected)
                expected[d] = (family, f"{family}:2")
                given.append((d, "\n".join(["some code", "", *(mark + x for x in textwrap.wrap(notice, width)), "", "more code"])))
        given.append((2000 + k, "\n\n".join(textwrap.wrap(notice, 50))))
    for r in licenses.license_paragraphs(table(spark, given)).collect():
        assert (r.families, r.spans) == expected.get(r.doc_id, ("", "")), r


def test_license_families_are_told_apart():
    """Names that hold other names, versions, denials and mentions; trained without any corpus."""
    random.seed(21)
    prose = [" ".join(random.choices("the town has many old houses and a river that people like to visit in summer with friends".split(), k=12)) for _ in range(600)]
    model = licenses.Classifier(*licenses.training_rows(prose))
    cases = {
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl",
        "This work is licensed under the GNU General Public License, version 2.": "gpl",
        "Licensed under CC BY-ND 4.0.": "cc-by-nd",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa",
        "Licensed under CC BY 4.0.": "cc-by",
        "This text is published under the MIT License by its authors.": "mit",
        "It is not licensed under the MIT License.": None,
        "We never released it under the GNU General Public License.": None,
        "the old town has many houses": None,
    }
    for text, family in cases.items():
        words = licenses.packed([text])
        _, p = model.probabilities(words)
        best = licenses.FAMILIES[p[0].argmax()] if len(p) and p[0].max() >= licenses.LEAST else "unknown"
        assert (best if best in licenses.confirmed(words.hash) else None) == family, (text, best, licenses.confirmed(words.hash))


def test_pipeline_joins_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(400)]
    near = [*words, *(f"new{k}" for k in range(98))]  # 396 of 494 shingles of five words: 0.802
    under = [*words, *(f"add{k}" for k in range(101))]  # 396 of 497: 0.797, and 0.661 to the one before
    kept = corpus_pipeline.keep_one_of_each_group(spark, table(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(under))]), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3}
