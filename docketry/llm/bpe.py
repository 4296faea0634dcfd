"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand side by side inside no vocabulary token can never be merged, so a word is cut
there first. Fragments are encoded on their own and concatenated; the last fragment of a word carries the word end.
A bounded memory of words answers most of them. Those of some texts that are new are encoded at once, with numpy: every
fragment's first pair of least rank merges in each round, and fragments without one are done. Long words are encoded one by one.

Edge cases: null and empty texts have no ids and decode to the empty text; special tokens in a text are single ids,
as the library reads them; other columns are ignored; repeated rows each get a row.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import returned

REMEMBERED = 150_000
SEEN, FEW_NEW = 1 << 20, 32  # characters whose words are looked at together; fewer new words are encoded one by one
LONG = 64  # symbols from which a heap finds merges faster than looking at all pairs
FIRST, SECOND = itemgetter(0), itemgetter(1)


@functools.cache
def unicode_rules() -> tuple[str, str, str, dict[int, str]]:
    """The tokenizers library's letters and numbers as ranges, what the ``regex`` module sees otherwise (the two follow
    different versions of Unicode), and lower-case letters that ``str.lower`` gives otherwise."""
    import regex
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    own = {k: set("".join(t for t, _ in pre_tokenizers.Split(Regex(rf"[^\p{{{k}}}]+"), "removed").pre_tokenize_str(every))) for k in "LN"}
    other = {k: set(regex.findall(rf"\p{{{k}}}", every)) for k in "LN"}

    def ranges(found: set[str]) -> str:
        codes, out = sorted(map(ord, found)), []
        for code in codes:
            if out and out[-1][1] == code - 1:
                out[-1][1] = code
            else:
                out.append([code, code])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    single = every.replace("\n", "")
    low = zip(single, normalizers.Lowercase().normalize_str("\n".join(single)).split("\n"), strict=True)
    lower = {ord(c): k for c, k in low if c.lower() != k} | {ord("Σ"): "σ"}
    return ranges(own["L"]), ranges(own["N"]), ranges((own["L"] ^ other["L"]) | (own["N"] ^ other["N"])), lower


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    out = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one word-end BPE vocabulary, given as its file's content."""

    def __init__(self, content: str, rules: tuple[str, str, str, dict[int, str]]):
        import regex

        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        letters, numbers, disputed, self.lower = rules
        self.words = regex.compile(pattern)
        self.unlike = re.compile("[" + "".join(map(chr, self.lower)) + "]")
        named = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        self.exact = re.compile(named.replace(r"\s\p{L}\p{N}", r"\t-\r \x85\xa0\u2028\u2029" + letters + numbers))
        self.disputed = re.compile(f"[{disputed}]") if disputed else None
        self.plain = re.compile(pattern.replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d").replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"))
        self.odd = re.compile("[^\0-\x1b -\x84\x86-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u024f\u2010-\u2027\u20ac]")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.symbols = dict(enumerate(byte_symbols()))
        inside = set()
        for token in self.vocab:
            own = token.removesuffix(self.end)
            inside.update(zip(own, own[1:], strict=False))
        self.inside = {a + b for a, b in inside}
        self.texts = {k: t for t, k in self.vocab.items()} | {k: t for t, k in self.specials.items()}
        self.tables()
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        self.known: dict[str, tuple[str, str]] = {}

    def tables(self) -> None:
        """What ``many`` looks up: symbols are numbered, the bytes from 0 and those that end a word from 256 on."""
        ends = [s + self.end for s in self.symbols.values()]
        names = dict.fromkeys([*self.symbols.values(), *ends, *(x for pair in self.ranks for x in (*pair, "".join(pair)))])
        number = {name: k for k, name in enumerate(names)}
        self.ids = np.array([self.vocab.get(name, -1) for name in names], np.int64)
        pairs = np.array([number[a] << 32 | number[b] for a, b in self.ranks], np.int64)
        ranks = np.array(list(self.ranks.values()), np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = np.append(pairs[order], -1), np.append(ranks[order], len(ranks))
        self.made = np.zeros(len(ranks), np.int64)
        self.made[ranks] = [number[a + b] for a, b in self.ranks]
        meets = np.array([[a + b in self.inside for b in self.symbols.values()] for a in self.symbols.values()])
        self.parted = ~np.tile(meets, (1, 2))
        two = np.arange(256)[:, None] << 32 | np.arange(512)[None, :]
        self.first_ranks = np.where(self.parted, len(ranks), self.ranked(two.ravel()).reshape(256, 512)).astype(np.int32)
        self.shown = {k: (str(k), text) for k, text in self.texts.items()}

    def ranked(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pairs of numbered symbols, ``len(self.ranks)`` where they don't merge."""
        at = np.searchsorted(self.pairs[:-1], pairs)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], len(self.ranks))

    def many(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all ``words`` one after another, where each word's ids end). The words aren't empty."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        stops = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        symbol = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        symbol[stops - 1] += 256
        out, none = symbol.copy(), np.int64(len(self.ranks))
        left = symbol[:-1].clip(max=255)  # a word's last symbol is cut from the next word's first below
        rank = np.append(self.first_ranks[left, symbol[1:]].astype(np.int64), none)
        begins = np.append(True, self.parted[left, symbol[1:]])
        begins[stops[:-1]] = True
        rank[stops - 1] = none
        place, kept = np.arange(len(symbol)), np.ones(len(symbol), bool)
        while True:
            starts = np.flatnonzero(begins)
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            merges = least < none << 32
            if not merges.all():  # these fragments are done
                stay = np.repeat(merges, np.diff(np.append(starts, len(rank))))
                symbol, rank, begins, place = symbol[stay], rank[stay], begins[stay], place[stay]
                if not len(symbol):
                    break
                starts = np.flatnonzero(begins)
                least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            at = least & 0xFFFFFFFF
            symbol[at] = self.made[least >> 32]
            out[place[at]] = symbol[at]
            kept[place[at + 1]] = False
            left_in = np.ones(len(symbol), bool)
            left_in[at + 1] = False
            at -= np.arange(len(at))  # one symbol goes from each fragment before
            symbol, begins, place = symbol[left_in], begins[left_in], place[left_in]
            left_in[at + np.arange(len(at)) + 1] = True
            left_in[at + np.arange(len(at))] = False
            rank = rank[left_in]  # a merged pair's rank goes, what follows it is looked up
            last = np.append(begins[1:], True)
            for where in (at, at[~begins[at]] - 1):
                inner = where[~last[where]]
                rank[where] = none
                rank[inner] = self.ranked(symbol[inner] << 32 | symbol[inner + 1])
        ends = np.cumsum(kept)[stops - 1]
        ids = self.ids[out[kept]]
        if (ids < 0).any():
            raise KeyError("a symbol has no id")
        return ids.tolist(), ends.tolist()

    def learn(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """What ``remembered`` gives for each of ``words`` that isn't known; they are known afterwards, long ones aside."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = words
        brief = [w for w in new if len(w) <= LONG]
        if len(brief) < FEW_NEW:
            return {w: self.remembered(w) for w in new}
        ids, ends = self.many(brief)
        shown = list(map(self.shown.__getitem__, ids))
        numbers, texts = list(map(FIRST, shown)), list(map(SECOND, shown))
        found = {w: (" ".join(numbers[a:b]), " ".join(texts[a:b])) for w, a, b in zip(brief, [0, *ends], ends, strict=False)}
        self.known.update(found)
        return found | {w: self.remembered(w) for w in new if len(w) > LONG}

    def normalise(self, text: str) -> str:
        """Composed and lower-cased letter by letter; blanks only part words, so they stay as they are."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return (text.translate(self.lower) if self.unlike.search(text) else text).lower()

    def fragment(self, symbols: str, last: bool) -> list[int]:
        """Ids of one fragment: the pair of lowest rank merges first, wherever it stands, from the left."""
        key = (symbols, last)
        if (known := self.fragments.get(key)) is not None:
            return known
        parts = list(symbols)
        if last:
            parts[-1] += self.end
        rank_of, none = self.ranks.get, len(self.ranks)
        if len(parts) > LONG:
            parts = self.merged(parts)
        if 1 < len(parts) <= LONG:
            ranks = list(map(rank_of, zip(parts, parts[1:], strict=False), repeat(none)))
            while ranks and (best := min(ranks)) < none:
                at = ranks.index(best)
                left, right = parts[at], parts[at + 1]
                both = left + right
                while True:  # ranks beside a merge are looked up, others stay
                    parts[at : at + 2] = (both,)
                    del ranks[at]
                    if at:
                        ranks[at - 1] = rank_of((parts[at - 1], both), none)
                    if at < len(ranks):
                        ranks[at] = rank_of((both, parts[at + 1]), none)
                    at += 1
                    if best not in ranks:
                        break
                    while at < len(ranks) and (ranks[at] != best or parts[at] != left or parts[at + 1] != right):
                        at += 1
                    if at >= len(ranks):
                        break
        ids = [self.vocab[p] for p in parts]
        if len(self.fragments) >= REMEMBERED:
            self.fragments.clear()
        self.fragments[key] = ids
        return ids

    def merged(self, parts: list[str]) -> list[str]:
        """``parts`` after all merges, in time that grows little faster than their number: a heap of pairs by rank
        and place over linked parts."""
        many, own = len(parts), list(parts)
        after, before = list(range(1, many + 1)), list(range(-1, many - 1))
        heap = [(rank, k) for k in range(many - 1) if (rank := self.ranks.get((own[k], own[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if own[k] == "" or right == many or self.ranks.get((own[k], own[right])) != rank:
                continue
            own[k], own[right] = own[k] + own[right], ""
            after[k] = after[right]
            if after[k] < many:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < many and (found := self.ranks.get((own[a], own[b]))) is not None:
                    heapq.heappush(heap, (found, a))
        return [p for p in own if p]

    def word(self, word: str) -> list[int]:
        symbols = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")
        symbols = symbols.translate(self.symbols)
        inside = self.inside
        cuts = [k for k in range(1, len(symbols)) if symbols[k - 1 : k + 1] not in inside]
        if not cuts:
            return self.fragment(symbols, True)
        ids: list[int] = []
        start = 0
        for k in cuts:
            ids += self.fragment(symbols[start:k], False)
            start = k
        return ids + self.fragment(symbols[start:], True)

    def split(self, text: str) -> list[str]:
        """Words of a normalised text. Python's own pattern, which is faster, serves texts of plain characters."""
        if not self.odd.search(text):
            return self.plain.findall(text)
        return (self.exact if self.disputed and self.disputed.search(text) else self.words).findall(text)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Runs of text, and special tokens (True), in order."""
        if not self.special or not any(s in text for s in self.specials):
            return [(text, False)]
        return [(p, p in self.specials) for p in self.special.split(text) if p]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece, special in self.pieces(text):
            if special:
                ids.append(self.specials[piece])
            else:
                for word in self.split(self.normalise(piece)):
                    ids += self.word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by a blank each: the vocabulary file names no decoder."""
        return " ".join(map(self.texts.__getitem__, ids))

    def remembered(self, word: str) -> tuple[str, str]:
        ids = self.word(word)
        own = (" ".join(map(str, ids)), self.decode(ids))
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = own
        return own

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: count of ids, ids joined by a blank, and the decoded text, by whole remembered words."""
        held: list[list[tuple[bool, list[str]]]] = []
        size = 0
        for text in texts:
            held.append([(special, [piece] if special else self.split(self.normalise(piece))) for piece, special in self.pieces(text)])
            size += len(text)
            if size >= SEEN:
                yield from self.answers(held)
                held, size = [], 0
        yield from self.answers(held)

    def answers(self, held: list[list[tuple[bool, list[str]]]]) -> Iterator[tuple[int, str, str]]:
        own = self.learn({w for parts in held for special, words in parts if not special for w in words})
        known = self.known
        for parts in held:
            said: list[tuple[str, str]] = []
            for special, words in parts:
                if special:
                    said.append((str(self.specials[words[0]]), words[0]))
                    continue
                found = list(map(known.get, words))
                if None in found:
                    found = [k or own[w] for k, w in zip(found, words, strict=True)]
                said += found
            ids = " ".join(map(FIRST, said))
            yield ids.count(" ") + 1 if ids else 0, ids, " ".join(map(SECOND, said))

    def digest(self, text: str) -> tuple[int, str, str]:
        return next(self.digests([text]))


def content_of(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as f:
        return f.read()


def sent_rules(docs: DataFrame, vocabulary: str):
    """Content of the file and Unicode rules for all workers; only the driver opens the path."""
    return docs.sparkSession.sparkContext.broadcast((content_of(vocabulary), unicode_rules()))


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, ids."""

    sent = sent_rules(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ForcedBoundaryBPE(*sent.value)
        for batch in batches:
            ids = pa.array([model.encode(t.as_py() or "") for t in batch[1]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch[0], ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, text."""

    sent = sent_rules(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ForcedBoundaryBPE(*sent.value)
        for batch in batches:
            text = pa.array([model.decode(i.as_py() or []) for i in batch[1]], pa.string())
            yield pa.RecordBatch.from_arrays([batch[0], text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def encoding_digests(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids on request."""

    sent = sent_rules(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ForcedBoundaryBPE(*sent.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            counts, sums, shown, ids = [], [], [], []
            for n, said, decoded in model.digests(text.as_py() or "" for text in batch[1]):
                counts.append(n)
                sums.append(sha(said))
                shown.append(sha(decoded))
                if with_ids:
                    ids.append(np.fromstring(said, np.int32, sep=" "))
            columns = [batch[0], pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(shown, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(returned(run), schema + ", ids array<int>" * with_ids)
