"""Secret scans by grammar inference.

Fixed patterns find the base findings. Their values are labelled credentials: for each kind a bounded sample
(``TRAINING`` distinct values, the first by hash, none longer than ``LONGEST``) becomes a prefix tree over character
classes, whose statistically compatible states are merged (Hoeffding bounds) into a probabilistic automaton; a quarter
of the sample is held out and sets the threshold. Every token of ``SHORTEST`` characters or more (the shortest that a
labelled value can have), less what base findings cover of it, is a candidate. It is a finding of kind ``grammar`` where
its likelihood under an automaton exceeds that under a background model, for each character, by as much as nearly all
held-out credentials do. The background model holds how often symbols follow each other in all candidates of all
documents. Base findings always stay. Only shapes (character classes) and hashes of values leave the documents' tasks.

Edge cases: null texts are empty and have no findings; offsets count code points, ends exclusive; without base
findings nothing is learnt and nothing is added; repeated rows each get a row; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut

KINDS = ("assign", "access", "hex", "grammar")
TRAINING, LONGEST, SHORTEST = 512, 128, 6
REMEMBERED = 200_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CLASSES = {c: k for k, group in {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in group}
SYMBOLS = str.maketrans(CLASSES)
SHAPES = bytes(ord(CLASSES.get(chr(b), chr(b))) for b in range(256))
CANDIDATE = re.compile(rb"[0agAG+/_.=-]{%d,}" % SHORTEST)
ALPHABET = 12


def base_findings(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), by start and then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(shapes: bytes, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, shape) in bytes of the tokens, without what ``covered`` (bytes, by start) holds of them."""
    k = 0
    for m in CANDIDATE.finditer(shapes):
        start, end = m.span()
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        at = k
        while at < len(covered) and covered[at][0] < end:
            if covered[at][0] - start >= SHORTEST:
                yield start, covered[at][0], shapes[start : covered[at][0]]
            start = max(start, covered[at][1])
            at += 1
        if end - start >= SHORTEST:
            yield start, end, shapes[start:end]


def covered_bytes(text: str, data: bytes, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Disjoint spans of bytes that base findings cover."""
    out: list[tuple[int, int]] = []
    at, byte = 0, 0
    place = {}
    for p in sorted({p for s, _, e, _ in base for p in (s, e)}):
        byte += p - at if len(text) == len(data) else len(text[at:p].encode())
        at = p
        place[p] = byte
    for s, _, e, _ in base:
        if out and place[s] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], place[e]))
        else:
            out.append((place[s], place[e]))
    return out


class Automaton:
    """Probabilistic automaton from a prefix tree by merging compatible states."""

    def __init__(self, samples: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # of each symbol; "" is the end
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for sample in samples:
            state = 0
            for symbol in sample:
                self.count[state][symbol] += 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = self.next[state][symbol]
            self.count[state][""] += 1
        self._merge_states()

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a].total(), self.count[b].total()
            if not n or not m:
                continue
            room = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.count[a][s] / n - self.count[b][s] / m) > room for s in self.count[a].keys() | self.count[b].keys()):
                return False
            todo += [(t, self.next[b][s]) for s, t in self.next[a].items() if s in self.next[b]]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            for symbol, target in self.next[b].items():
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], target))
                else:
                    self.next[a][symbol] = target

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            fringe = [(s, c, t) for s in kept for c, t in sorted(self.next[s].items()) if t not in kept]
            if not fringe:
                break
            source, symbol, state = max(fringe, key=lambda f: (self.count[f[2]].total(), -f[2]))
            for other in kept:
                if self._alike(other, state):
                    self.next[source][symbol] = other
                    self._fold(other, state)
                    break
            else:
                kept.append(state)
        at = {s: k for k, s in enumerate(kept)}
        self.next = [{c: at[t] for c, t in self.next[s].items()} for s in kept]
        self.count = [self.count[s] for s in kept]

    def tables(self) -> list[dict[str, tuple[float, int]]]:
        """For each state: symbol to (log likelihood, next state); "?" stands for a symbol never seen there."""
        out = []
        for own, count in zip(self.next, self.count, strict=True):
            total = count.total() + 0.1 * ALPHABET
            out.append({c: (math.log((count[c] + 0.1) / total), t) for c, t in own.items()} | {"": (math.log((count[""] + 0.1) / total), 0), "?": (math.log(0.1 / total), 0)})
        return out


def likelihood(tables: list[dict[str, tuple[float, int]]], symbols: str) -> float:
    """Log likelihood of a string and its end, for each symbol."""
    total, state = 0.0, 0
    for symbol in symbols:
        step, state = tables[state].get(symbol) or tables[state]["?"]
        total += step
    return (total + tables[state][""][0]) / (len(symbols) + 1)


def background(follows: dict[str, int]) -> list[dict[str, tuple[float, int]]]:
    """A first-order model of symbols, in the form of an automaton's tables. ``follows`` counts pairs: a blank in front
    stands for the beginning, one symbol alone for the end after it."""
    names = sorted(set("".join(follows)) - {" "} | set(CLASSES.values()))
    at = {c: k for k, c in enumerate([" ", *names])}
    count = [Counter() for _ in at]
    for pair, n in follows.items():
        count[at[pair[0]]][pair[1:]] += n
    return [{c: (math.log((n[c] + 0.1) / (n.total() + 0.1 * ALPHABET)), at.get(c, 0)) for c in [*names, ""]} | {"?": (math.log(0.1 / (n.total() + 0.1 * ALPHABET)), 0)} for n in count]


def learn(labelled: dict[int, list[str]], follows: dict[str, int]) -> dict | None:
    """Automata from the shapes of labelled values, three of four; the fourth ones set the threshold."""
    taught = {k: [v for at, v in enumerate(values) if at % 4 or len(values) < 4] for k, values in labelled.items()}
    automata = [Automaton(sorted(values)).tables() for _, values in sorted(taught.items()) if values]
    if not automata:
        return None
    model = {"automata": automata, "background": background(follows), "least": 0.0}
    gains = sorted(gain(model, v) for values in labelled.values() for v in (values[::4] if len(values) >= 4 else values))
    return model | {"least": max(0.25, gains[len(gains) // 50])}


def gain(model: dict, shape: str) -> float:
    return max(likelihood(a, shape) for a in model["automata"]) - likelihood(model["background"], shape)


def labelled_shapes(docs: DataFrame) -> DataFrame:
    """(kind, hash, shape, n): shapes of base findings by the hash of the value, and as kind 3 the pairs of symbols
    that follow each other in candidates, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def pairs() -> pa.RecordBatch:
            follows: Counter = Counter()
            for shape, n in seen.items():
                own = shape.decode()
                for pair in zip(" " + own, [*own, ""], strict=True):
                    follows["".join(pair)] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([3] * len(follows), pa.int32()), pa.array([0] * len(follows), pa.int64()), pa.array(list(follows), pa.string()), pa.array(list(follows.values()), pa.int64())], names=["kind", "hash", "shape", "n"])

        for batch in batches:
            found = []
            for item in batch[0]:
                text = item.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                if base := base_findings(text):
                    found += [(k, int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), v.translate(SYMBOLS)) for _, k, _, v in base if len(v) <= LONGEST]
                    seen.update(shape for _, _, shape in candidates(data.translate(SHAPES), covered_bytes(text, data, base)))
                else:
                    seen.update(CANDIDATE.findall(data.translate(SHAPES)))
            kinds, hashes, shapes = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array(shapes, pa.string()), pa.array([1] * len(found), pa.int64())], names=["kind", "hash", "shape", "n"])
            if len(seen) > REMEMBERED:
                yield pairs()
        yield pairs()

    return docs.select("text").mapInArrow(run, "kind int, hash bigint, shape string, n bigint").groupBy("kind", "hash", "shape").agg(F.sum("n").alias("n"))


def model_of(docs: DataFrame) -> dict | None:
    """The automata, background and threshold that ``docs`` teach."""
    shapes = cut(labelled_shapes(docs))
    taken = [shapes.where(F.col("kind") == k).orderBy("hash", "shape").limit(TRAINING) for k in range(3)]
    labelled = {k: [r["shape"] for r in rows.collect()] for k, rows in enumerate(taken)}
    return learn(labelled, {r["shape"]: r["n"] for r in shapes.where("kind = 3").collect()})


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar."""
    sent = docs.sparkSession.sparkContext.broadcast(model_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}

        def accepted(shape: bytes) -> bool:
            out = known.get(shape)
            if out is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                out = known[shape] = gain(model, shape.decode()) >= model["least"]
            return out

        for batch in batches:
            rows = []
            for item in batch[1]:
                text = item.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                base = base_findings(text)
                shapes, more = data.translate(SHAPES), []
                if model and (base or any(map(accepted, set(CANDIDATE.findall(shapes))))):
                    found = [(s, e) for s, e, shape in candidates(shapes, covered_bytes(text, data, base)) if accepted(shape)]
                    at, byte = 0, 0
                    for s, e in found:
                        at, byte = at + len(data[byte:s].decode("utf-8", "surrogatepass")), s
                        more.append((at, 3, at + e - s))
                own = [f[:3] for f in base]
                kinds = Counter(k for _, k, _ in own)
                said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(said(own).encode()).hexdigest(), said(own + more), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_grammar bigint")
