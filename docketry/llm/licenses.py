"""Licence scans with a trained paragraph classifier.

A sparse multinomial logistic regression over hashed word n-grams (1 to 3 words) tells licence families and an
``unknown`` class apart. It is trained here: family paragraphs are sentences that name a licence (``PHRASES`` with
``NAMES``) and public notices (``TEXTS``), with seeded variants of them (words dropped, words put around them); unknown
ones are a bounded sample of the corpus (``NEGATIVES`` distinct paragraphs, the first by hash, none close to a template),
denials and shuffled template words. Sentences and corpus paragraphs that training doesn't see set the temperature of the
probabilities (calibration), and the unknown class takes every paragraph in which no family reaches ``LEAST``.

A prediction counts only where a template confirms it: the paragraph holds most word pairs of a notice of that family, or
all of a name of it after a word that licenses (``CUES``) and no denial, and no longer name of another family
stands there. A paragraph is a line; notices that are wrapped over neighbouring lines are found as stretches of words that
hold a template, are judged in the same way, and count as one finding at their first line.

Edge cases: null and empty texts have no paragraphs; a paragraph without known n-grams is unknown; repeated rows each
get a row; an empty table gives no rows (and is scanned with templates alone); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import kind_of
from docketry.llm.lines import MARKS, line_offsets
from docketry.llm.word_hash import LOWER, RUN, Words, chunks, mix, runs

BITS, NEGATIVES, VARIANTS, LONGEST = 18, 4000, 80, 2000
LEAST, CONFIRM, ROUNDS = 0.5, 0.75, 120

# Public notices by licence family.
TEXTS = {
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
# How licences are named, and what is said around a name.
CREATIVE = {"cc-by": ("BY", "Attribution"), "cc-by-nc": ("BY-NC", "Attribution-NonCommercial"), "cc-by-sa": ("BY-SA", "Attribution-ShareAlike"), "cc-by-nd": ("BY-ND", "Attribution-NoDerivatives"), "cc-by-nc-sa": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), "cc-by-nc-nd": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")}
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL"],
    "gpl": ["GNU General Public License", "GNU GPL"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL"],
    "isc": ["ISC License"],
    "mit": ["MIT License"],
    "mpl-2.0": ["Mozilla Public License"],
    **{family: [f"CC {code} {n}.0" for n in (2, 3, 4)] + [f"Creative Commons {name} {n}.0" for n in (2, 3, 4)] for family, (code, name) in CREATIVE.items()},
}
PHRASES = ["Released under the {}.", "Licensed under {}.", "This work is licensed under the {}, version 3.", "This software is distributed under the terms of the {}.", "Available under a {} International License."]
CALIBRATION = ["The text is published under the {}.", "All files here are covered by the {}.", "You may use it as licensed under the {}."]
DENIALS = ["It is not licensed under the {}.", "We compare it with the {} and other terms.", "This was never released under the {}."]
CUES = ["licensed", "released", "distributed", "available", "published", "covered", "license", "terms"]
NEGATIONS = ["not", "never", "no", "isn", "wasn", "aren", "without"]
NEAR_CUE = 8
FAMILIES = [*sorted({*TEXTS, *NAMES}), "unknown"]
UNKNOWN = len(FAMILIES) - 1


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of each paragraph (line), and the first paragraph of each document."""
    bounds, first = line_offsets(data, offsets)
    return Words(data, bounds, LOWER, MARKS), first


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, coordinate) of its 1- to 3-grams, with repeats."""
    doc = words.doc_of()
    rows, values = [doc], [mix(words.hash ^ np.uint64(0x1D))]
    for n in (2, 3):
        starts = words.gram_starts(n)
        rows.append(doc[starts])
        values.append(words.gram_hash(starts, n))
    return np.concatenate(rows), (np.concatenate(values) >> np.uint64(64 - BITS)).astype(np.int64)


def packed(texts: list[str]) -> Words:
    data = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]), LOWER, MARKS)


def word_pairs(text: str) -> np.ndarray:
    words = packed([text])
    return words.gram_hash(words.gram_starts(2), 2)


def word_hashes(words: list[str]) -> np.ndarray:
    return packed([w + "\n" for w in words]).hash


class Template:
    """A notice, of which most word pairs must be there, or a name, of which all must."""

    def __init__(self, family: str, text: str, named: bool):
        self.family, self.named, self.words = family, named, len(packed([text]).hash)
        self.ordered = word_pairs(text)
        self.pairs = np.unique(self.ordered)
        self.need = len(self.pairs) if named else int(np.ceil(CONFIRM * len(self.pairs)))
        self.reach = self.words if named else int(self.words / CONFIRM) + 1


TEMPLATES = [Template(f, t, False) for f, texts in TEXTS.items() for t in texts] + [Template(f, t, True) for f, texts in NAMES.items() for t in texts]
EVERY = np.unique(np.concatenate([t.pairs for t in TEMPLATES]))
MASK = np.zeros(1 << 16, bool)
MASK[EVERY >> np.uint64(48)] = True
CUE_HASHES, NEGATION_HASHES = word_hashes(CUES), word_hashes(NEGATIONS)


def confirmed(hashes: np.ndarray, before: np.ndarray | None = None) -> set[str]:
    """Families that templates confirm in a paragraph's words, ``before`` being words in front of it. Names need a cue
    in front and no denial, and where a name stands inside a longer one of another family the longer one holds."""
    if len(hashes) < 2:
        return set()
    front = 0 if before is None else len(before)
    whole = hashes if before is None else np.concatenate([before, hashes])
    starts = np.arange(front, len(whole) - 1)
    pairs = runs(whole, starts, starts + 2, RUN)
    known = np.flatnonzero(np.isin(pairs, EVERY))
    out, held = set(), []
    if not len(known):
        return out
    for t in TEMPLATES:
        at = known[np.isin(pairs[known], t.pairs)]
        if len(np.unique(pairs[at])) < t.need:
            continue
        if not t.named:
            out.add(t.family)
            continue
        held += [(k, k + t.words, t.family) for k in at[pairs[at] == t.ordered[0]].tolist() if np.array_equal(pairs[k : k + t.words - 1], t.ordered)]
    for a, b, family in held:
        if any(x <= a and b <= y and (y - x) > (b - a) and other != family for x, y, other in held):
            continue
        low = max(0, front + a - NEAR_CUE)
        cue = np.flatnonzero(np.isin(whole[low : front + a], CUE_HASHES))
        if len(cue) and not np.isin(whole[max(0, low + int(cue[0]) - 3) : front + a], NEGATION_HASHES).any():
            out.add(family)
    return out


def wrapped(words: Words, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, first line, last line, first word, end word) of stretches over several lines, none of them without
    words, that hold a template."""
    bounds = words.first[first]
    if len(words.hash) < 2:
        return []
    pairs = words.gram_hash(np.arange(len(words.hash) - 1), 2)
    at = np.flatnonzero(MASK[pairs >> np.uint64(48)])
    at = at[np.isin(pairs[at], EVERY)]
    doc = np.searchsorted(bounds, at, "right") - 1
    at, doc = at[at + 1 < bounds[doc + 1]], doc[at + 1 < bounds[doc + 1]]
    out = {}
    for t in TEMPLATES if len(at) else ():
        mine = np.isin(pairs[at], t.pairs)
        place, of, done = at[mine], doc[mine], 0
        more = len(place) - t.need + 1
        if more <= 0:
            continue
        close = (place[t.need - 1 :] - place[:more] < t.reach) & (of[t.need - 1 :] == of[:more])
        for a in np.flatnonzero(close).tolist():
            b = min(int(np.searchsorted(place, place[a] + t.reach)), int(np.searchsorted(of, of[a], "right")))
            if a < done or len(np.unique(pairs[place[a:b]])) < t.need:
                continue
            d, low, high, done = int(of[a]), int(place[a]), int(place[b - 1]) + 2, b
            i, j = (int(np.searchsorted(words.first, x, "right")) - 1 for x in (low, high - 1))
            if i < j and (np.diff(words.first[i : j + 2]) > 0).all() and ((d, i) not in out or high - low > out[d, i][4] - out[d, i][3]):
                out[d, i] = (d, i, j, low, high)
    return sorted(out.values(), key=lambda x: (x[0], x[3]))


class Classifier:
    """Sparse weights by coordinate, temperature; trained by proximal gradient steps with L1."""

    def __init__(self, texts: list[str], labels: list[int], held_out: list[bool], l1: float = 2e-4, rounds: int = ROUNDS):
        rows, at = features(packed(texts))
        pairs = np.unique((rows << BITS) | at)
        row, at = pairs >> BITS, pairs & ((1 << BITS) - 1)
        of_family = np.bincount(at[np.asarray(labels)[row] < UNKNOWN], minlength=1 << BITS)
        kept = of_family[at] >= 5  # n-grams of unknown paragraphs alone need no weight
        row, (self.coordinates, column) = row[kept], np.unique(at[kept], return_inverse=True)
        k, many = len(FAMILIES), len(texts)
        wanted = np.eye(k)[labels]
        fit = ~np.asarray(held_out)
        share = fit / fit.sum()
        w, bias = np.zeros((len(self.coordinates), k)), np.zeros(k)
        last, speed, step = w.copy(), 1.0, 4.0
        logits = lambda w, b: np.stack([np.bincount(row, w[column, c], many) + b[c] for c in range(k)], axis=1)
        for _ in range(rounds):  # accelerated
            grown = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            ahead = w + (speed - 1) / grown * (w - last)
            slope = (softmax(logits(ahead, bias)) - wanted) * share[:, None]
            pull = np.stack([np.bincount(column, slope[row, c], len(self.coordinates)) for c in range(k)], axis=1)
            moved = ahead - step * pull
            last, w, speed = w, np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), grown
            bias -= step * slope.sum(axis=0)
        live = np.flatnonzero(np.abs(w).max(axis=1) > 0)
        held = logits(w, bias)[~fit]
        loss = lambda t: -np.log(np.maximum((softmax(held / t) * wanted[~fit]).sum(axis=1), 1e-12)).mean()
        self.temperature = min(np.geomspace(0.25, 4, 33), key=loss)
        self.coordinates, self.weights, self.bias = self.coordinates[live], w[live], bias

    def probabilities(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(paragraphs that hold known n-grams, their probabilities)."""
        rows, at = features(words)
        table = np.full(1 << BITS, -1)
        table[self.coordinates] = np.arange(len(self.coordinates))
        found = table[at]
        pairs = np.unique(rows[found >= 0] * (len(self.coordinates) + 1) + found[found >= 0])
        row, column = pairs // (len(self.coordinates) + 1), pairs % (len(self.coordinates) + 1)
        kept, place = np.unique(row, return_inverse=True)
        logits = np.stack([np.bincount(place, self.weights[column, c], len(kept)) + self.bias[c] for c in range(len(FAMILIES))], axis=1)
        return kept, softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def training_rows(negatives: list[str]) -> tuple[list[str], list[int], list[bool]]:
    """(paragraphs, labels, whether held out): sentences with names and notices with seeded variants, and as unknown
    denials, shuffled words of them and the corpus's own. Held out are other sentences with the names, and of the corpus each
    fourth paragraph."""
    random = np.random.default_rng(11)
    noise = " ".join(negatives[:200]).split() or ["lorem"]
    rows = []
    for k, family in enumerate(FAMILIES[:-1]):
        names = NAMES.get(family, [])
        taught = [*TEXTS.get(family, []), *(p.format(n) for n in names for p in PHRASES)]
        for text in taught:
            words = text.split()
            for v in range(max(3, VARIANTS // len(taught))):
                own = [w for w in words if v == 0 or random.random() > 0.05]
                around = [[noise[i] for i in random.integers(0, len(noise), random.integers(0, 12))] if v % 3 == 2 else [] for _ in range(2)]
                rows.append((" ".join([*around[0], *own, *around[1]]), k, False))
            part = random.permutation(words)[: max(1, len(words) // 2)]
            rows.append((" ".join([*part, *(noise[i] for i in random.integers(0, len(noise), 6))]), UNKNOWN, False))
        rows += [(p.format(n), k, True) for n in names for p in CALIBRATION]
        rows += [(p.format(n), UNKNOWN, i == 0) for n in names[:2] for i, p in enumerate(DENIALS)]
    rows += [(text, UNKNOWN, k % 4 == 0) for k, text in enumerate(negatives)]
    order = random.permutation(len(rows))
    return [rows[i][0] for i in order], [rows[i][1] for i in order], [rows[i][2] for i in order]


def sample_paragraphs(docs: DataFrame, most: int = NEGATIVES) -> list[str]:
    """Distinct paragraphs of at most ``LONGEST`` characters, the first ``most`` by hash, that hold no template."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p")).where(F.length("p").between(3, LONGEST))
    chosen = lines.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.xxhash64("p"), "p").limit(most)
    found = [r["p"] for r in chosen.select("p").collect()]
    part = lambda own: len(own) > 2 and 2 * np.isin(own, EVERY).sum() >= len(own)  # noqa: E731  # a line of a wrapped notice
    return [p for p in found if not part(np.unique(word_pairs(p))) and not confirmed(packed([p]).hash)]


def license_paragraphs(docs: DataFrame, model: Classifier | None = None, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, n_paragraphs, n_licensed, n_unconfirmed, families (comma-joined), spans (family:paragraph)."""
    model = model or Classifier(*training_rows(sample_paragraphs(docs)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch[1]):
                many = len(offsets) - 1
                words, first = paragraphs(data, offsets)
                kept, p = sent.value.probabilities(words)
                found: list[list[tuple[int, str]]] = [[] for _ in range(many)]
                weak: list[set[int]] = [set() for _ in range(many)]
                best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
                for k in np.flatnonzero((best < UNKNOWN) & (p.max(axis=1, initial=0) >= least)).tolist():
                    line = int(kept[k])
                    doc = int(np.searchsorted(first, line, "right")) - 1
                    if FAMILIES[best[k]] in confirmed(words.hash[words.first[line] : words.first[line + 1]]):
                        found[doc].append((line - int(first[doc]), FAMILIES[best[k]]))
                    else:
                        weak[doc].add(line)
                ended: dict[tuple[int, str], int] = {}
                for doc, i, j, low, high in wrapped(words, first):
                    begin = max(low - NEAR_CUE - 3, int(words.first[first[doc]]))
                    shown = words.part(max(begin, int(words.first[i])), high)
                    _, p = sent.value.probabilities(shown)
                    if len(p) and p[0].argmax() < UNKNOWN and p[0].max() >= least and (family := FAMILIES[p[0].argmax()]) in confirmed(words.hash[low:high], words.hash[begin:low]):
                        if i > ended.get((doc, family), -1):  # lines of the notice that name its licence are no findings of their own
                            found[doc] = [(line, x) for line, x in found[doc] if x != family or not i <= line + first[doc] <= j]
                            found[doc].append((i - int(first[doc]), family))
                            weak[doc] -= set(range(i, j + 1))
                        ended[doc, family] = max(j, ended.get((doc, family), -1))
                columns = [
                    pa.array(np.diff(first)),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([len(w) for w in weak], pa.int64()),
                    pa.array([",".join(sorted({x for _, x in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{x}:{n}" for n, x in sorted(f)) for f in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch[0].slice(row, many), *columns], names=["doc_id", "n_paragraphs", "n_licensed", "n_unconfirmed", "families", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, n_paragraphs bigint, n_licensed bigint, n_unconfirmed bigint, families string, spans string")
