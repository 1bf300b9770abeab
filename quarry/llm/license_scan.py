"""Licence scans by a trained paragraph classifier.

A paragraph is a line with a word, or adjacent lines over which a notice is wrapped. A sparse (L1) multinomial logistic regression over word uni-, bi- and trigrams names
its licence family; ``unknown`` is a class of its own. The model is trained here, on paragraphs made by rule and from a
seed out of the notices below (shortened, with words changed, or set in other text) and of ordinary prose, including
prose about licences. A held-out part of these samples calibrates it: a temperature fits the probabilities, and the
acceptance threshold is the least that lets no held-out unknown paragraph pass. A family that the classifier names is
confirmed only if enough of one notice's word trigrams stand in the paragraph.

Lines are classified one by one, and n_paragraphs counts lines. Wrapped notices are looked for in blocks of adjacent
lines, their comment leaders and words of symbols only taken out: where enough of a notice's trigrams stand close
together over more than one line, the words from the first to the last are classified and confirmed as one paragraph, and
the span is those lines. Of overlapping finds of one family the union stays, of different families the better covered.

A null or empty text has no paragraphs. Rows are independent: any other column may be null, rows may repeat, and an empty
table gives an empty result. Nothing is shuffled; texts are taken whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, parts
from .shingles import AT_ONCE, IS_WORD, STEPS, mixed, word_hashes

#: Notices by which public licences are granted (fixed values, quoted or in the usual wording).
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "The author has dedicated the work to the public domain by waiving all rights under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
#: What unknown paragraphs are made of, beside invented words.
PROSE = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would "
    "license licence licensed version free software general public work works use permission terms copy copyright project released under source code file file library program created common "
    "driver fishing marriage office government fee holder expired apply number plate state department"
).split()
CLASSES = ("unknown", *NOTICES)
GRAMS, SEED, SAMPLES, SHARE = 3, 77, 220, 0.5
#: Bytes that stand before the text of a comment's line, and words a notice may be longer than its usual wording.
LEADERS, SLACK = b"#*/;%!<>|-:", 8
SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(LEADERS, np.uint8)] = True
SEEDS = np.array([0x0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each on."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * STEPS[k]
    return mixed(out ^ SEEDS[n - 1])


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


def samples(rng: random.Random) -> list[tuple[str, int]]:
    """Paragraphs with their classes."""
    letters = "abcdefghijklmnoprstuvwyz"
    word = lambda: rng.choice(PROSE) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    out = []
    for k, family in enumerate(CLASSES):
        if not k:
            out += [(" ".join(word() for _ in range(rng.randint(1, 40))), 0) for _ in range(SAMPLES * 8)]
            continue
        for _ in range(SAMPLES):
            w = rng.choice(NOTICES[family]).split()
            if len(w) > 8 and rng.random() < 0.5:  # a part, where the notice is long
                a = rng.randint(0, len(w) // 4)
                w = w[a : max(a + 6, len(w) - rng.randint(0, len(w) // 4))]
            if len(w) > 6:
                w = [x if rng.random() > 0.05 else word() for x in w]
            if rng.random() < 0.4:
                w = [word() for _ in range(rng.randint(0, 10))] + w + [word() for _ in range(rng.randint(0, 10))]
            out.append((" ".join(w), k))
    return out


class Model:
    def __init__(self) -> None:
        rng = random.Random(SEED)
        data = samples(rng)
        rng.shuffle(data)
        cut = len(data) * 3 // 4
        rows = [np.unique(np.concatenate([grams(words_of(t), n) for n in range(1, GRAMS + 1)])) for t, _ in data]
        y = np.array([k for _, k in data])
        names, count = np.unique(np.concatenate(rows[:cut]), return_counts=True)
        self.names = names[count >= 4]
        index = [(np.repeat(i, len(r)), np.searchsorted(self.names, r), r) for i, r in enumerate(rows)]
        at = np.concatenate([i for i, _, _ in index]), np.concatenate([k for _, k, _ in index]), np.concatenate([r for _, _, r in index])
        ok = self.names[np.minimum(at[1], len(self.names) - 1)] == at[2]
        x = np.zeros((len(data), len(self.names)), np.float32)
        x[at[0][ok], at[1][ok]] = 1
        self.weights, self.bias = self.train(x[:cut], y[:cut])
        used = np.abs(self.weights).max(1) > 0
        self.names, self.weights, x = self.names[used], self.weights[used], x[:, used]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.names & np.uint64(len(self.filter) - 1)] = True
        held, truth = x[cut:] @ self.weights + self.bias, y[cut:]
        losses = [(-np.log(self.softmax(held / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in (0.3, 0.5, 0.7, 1.0, 1.4, 2.0)]
        self.temperature = min(losses)[1]
        best = self.softmax(held / self.temperature)
        self.threshold = max(0.5, float(best[truth == 0, 1:].max()) + 0.01)
        self.accuracy = float((np.where(best.max(1) >= self.threshold, best.argmax(1), 0) == truth).mean())
        self.notices = {k: [np.unique(grams(words_of(t), min(GRAMS, len(t.split())))) for t in NOTICES[f]] for k, f in enumerate(CLASSES) if k}
        #: Length in words, length of the grams and grams of each notice; all grams of each length.
        self.wordings = [(len(t.split()), min(GRAMS, len(t.split())), n) for k, f in enumerate(CLASSES) if k for t, n in zip(NOTICES[f], self.notices[k], strict=True)]
        self.grams_of = {n: np.unique(np.concatenate([g for _, m, g in self.wordings if m == n])) for n in {m for _, m, _ in self.wordings}}

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, strength: float = 3e-4, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated proximal gradient."""
        w, b = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
        v, c, t, rate = w.copy(), b.copy(), 1.0, 0.5
        goal = np.eye(len(CLASSES), dtype=np.float32)[y]
        for _ in range(rounds):
            e = (self.softmax(x @ v + c) - goal) / len(y)
            w2 = v - rate * (x.T @ e)
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * strength, 0)
            b2, t2 = c - rate * e.sum(0), (1 + (1 + 4 * t * t) ** 0.5) / 2
            v, c = w2 + np.float32((t - 1) / t2) * (w2 - w), b2 + np.float32((t - 1) / t2) * (b2 - b)
            w, b, t = w2, b2, t2
        return w, b

    def classify(self, hashes: np.ndarray, line: np.ndarray, lines: int) -> list[tuple[int, int, float]]:
        """Line, class and probability of the paragraphs that a family gets. ``line`` of each word, ascending."""
        at_line, at_name = [], []
        for n in range(1, GRAMS + 1):
            g = grams(hashes, n)
            hit = np.flatnonzero(self.filter[g & np.uint64(len(self.filter) - 1)] & (line[: len(g)] == line[n - 1 : n - 1 + len(g)]))
            place = np.minimum(np.searchsorted(self.names, g[hit]), len(self.names) - 1)
            ok = self.names[place] == g[hit]
            at_line.append(line[hit[ok]])
            at_name.append(place[ok])
        pairs = np.unique(np.stack([np.concatenate(at_line), np.concatenate(at_name)]), axis=1)
        there, back = np.unique(pairs[0], return_inverse=True)
        if not len(there):
            return []
        z = np.zeros((len(there), len(CLASSES)))
        np.add.at(z, back, self.weights[pairs[1]])
        p = self.softmax((z + self.bias) / self.temperature)
        best = p.argmax(1)
        sure = (best > 0) & (p.max(1) >= self.threshold)
        return [(int(there[i]), int(best[i]), float(p[i, best[i]])) for i in np.flatnonzero(sure)]

    def cover(self, k: int, hashes: np.ndarray) -> float:
        """The greatest share of the grams of one of the family's notices that stand in the words."""
        own = np.unique(np.concatenate([grams(hashes, n) for n in range(1, GRAMS + 1)]))
        return max(float(np.isin(t, own).mean()) for t in self.notices[k])

    def wrapped(self, hashes: np.ndarray, line: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
        """First word and end of the stretches of words, over more than one line, that hold enough of a notice. ``line`` and ``block`` of each word, ascending."""
        out = set()
        for n, names in self.grams_of.items():
            g = grams(hashes, n)
            at = np.flatnonzero(names[np.minimum(np.searchsorted(names, g), len(names) - 1)] == g)
            at = at[block[at] == block[at + n - 1]]
            if not len(at):
                continue
            cuts = np.flatnonzero(np.diff(block[at])) + 1
            for own in np.split(at, cuts):
                if line[own[0]] == line[own[-1] + n - 1]:
                    continue
                for size, m, notice in self.wordings:
                    if m == n and len(own) >= SHARE * len(notice):
                        out |= {(a, b + n) for a, b in closest(own, g[own], notice, 2 * size + SLACK) if line[a] < line[b + n - 1]}
        return sorted(out)


def closest(at: np.ndarray, names: np.ndarray, notice: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """First and last place of the stretches of at most ``reach`` words with SHARE of the notice's grams, the fullest first; none overlap."""
    ok = np.isin(names, notice)
    at, names = at[ok].tolist(), names[ok].tolist()
    held: dict[int, int] = {}
    found, i = [], 0
    for j, x in enumerate(names):
        held[x] = held.get(x, 0) + 1
        while at[j] - at[i] > reach or held[names[i]] > 1:
            held[names[i]] -= 1
            if not held[names[i]]:
                del held[names[i]]
            i += 1
        if len(held) >= SHARE * len(notice):
            found.append((-len(held), at[j] - at[i], at[i], at[j]))
    out: list[tuple[int, int]] = []
    for _, _, a, b in sorted(found):
        if all(b < x or y < a for x, y in out):
            out.append((a, b))
    return out


def bare(part: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes with comment leaders at the starts of lines, and words of symbols only, made blanks."""
    word, symbol = IS_WORD[part], SYMBOL[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[starts] = True
    edge[len(part)] = True
    first = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])) | word & edge[:-1])
    last = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1
    text = np.append(np.flatnonzero(word & ~symbol), len(part))
    own = text[np.searchsorted(text, first)]  # the first byte from each word on that isn't a symbol
    lines = np.searchsorted(starts, first, "right")
    leads = np.concatenate(([True], lines[1:] != lines[:-1])) if len(first) else np.zeros(0, bool)
    for _ in range(2):  # "/* *" and the like: the word after a leader leads as well
        leads[1:] |= leads[:-1] & (own[:-1] >= last[:-1]) & (lines[1:] == lines[:-1])
    until = np.where(leads | (own >= last), np.minimum(own, last), first)
    step = np.zeros(len(part) + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, until, -1)
    return np.where(np.cumsum(step[:-1]) > 0, np.uint8(32), part)


@lru_cache(1)
def model() -> Model:
    return Model()


def wrapped_finds(models: Model, part: np.ndarray, starts: np.ndarray, own: np.ndarray) -> list[tuple[float, int, int, int, float]]:
    """Cover, first and last line, class and probability of the notices that are wrapped over lines. ``own``: offsets of the texts."""
    hashes, before = word_hashes(bare(part, starts), np.append(starts, len(part)))
    n_words = np.diff(before)
    line = np.repeat(np.arange(len(starts)), n_words)
    new = np.isin(starts, own) | (n_words == 0)
    block = np.cumsum(new)[line]
    out = []
    for a, b in models.wrapped(hashes, line, block):
        words = hashes[a:b]
        for _, k, p in models.classify(words, np.zeros(len(words), np.int64), 1):
            if (cover := models.cover(k, words)) >= SHARE:
                out.append((cover, int(line[a]), int(line[b - 1]), k, p))
    return out


def settled(finds: list[tuple[float, int, int, int, float]]) -> list[tuple[float, int, int, int, float]]:
    """The finds in order of lines: overlapping ones of a family as one, of different families the better covered."""
    out: list[tuple[float, int, int, int, float]] = []
    for cover, x, y, k, p in sorted(finds, key=lambda f: (-f[0], f[1] - f[2], f[1])):
        over = [f for f in out if f[1] <= y and x <= f[2]]
        if all(f[3] == k for f in over):
            out = [f for f in out if f not in over]
            every = [*over, (cover, x, y, k, p)]
            out.append((max(f[0] for f in every), min(f[1] for f in every), max(f[2] for f in every), k, max(f[4] for f in every)))
    return sorted(out, key=lambda f: f[1])


def scan_texts(texts: pa.Array, models: Model | None = None) -> Iterator[tuple[int, list[tuple[int, int, str, float]]]]:
    """Number of paragraphs of each text, and start, end (code points), family and probability of its licence paragraphs."""
    models = models or model()
    strings = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    if not len(strings):
        return
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(strings):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + AT_ONCE, "right")) - 1)
        own, part = offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        breaks = np.flatnonzero(part == 10)
        starts = np.union1d(own[:-1], breaks + 1)
        starts = starts[starts < max(1, len(part))]
        hashes, before = word_hashes(part, np.append(starts, len(part)))
        line = np.repeat(np.arange(len(starts)), np.diff(before))
        finds = []  # cover, first and last line, class and probability
        for x, k, p in models.classify(hashes, line, len(starts)):
            if (cover := models.cover(k, hashes[before[x] : before[x + 1]])) >= SHARE:
                finds.append((cover, x, x, k, p))
        finds = settled(finds + wrapped_finds(models, part, starts, own))
        found: dict[int, list] = {}
        for _, x, y, k, p in finds:
            a, b = int(starts[x]), int(starts[y + 1]) if y + 1 < len(starts) else len(part)
            doc = int(np.searchsorted(own, a, "right")) - 1
            b = min(b, int(own[doc + 1]))
            b -= b > a and part[b - 1] == 10
            at = len(part[own[doc] : a].tobytes().decode())
            found.setdefault(doc, []).append((at, at + len(part[a:b].tobytes().decode()), CLASSES[k], p))
        full = np.diff(before) > 0
        counts = np.bincount(np.searchsorted(own, starts[full], "right") - 1, minlength=last - first)
        for i in range(last - first):
            yield int(counts[i]), found.get(i, [])
        first = last


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, families, spans and least probability of every row."""
    models = docs.sparkSession.sparkContext.broadcast(model())  # trained once, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = list(scan_texts(batch.column("text"), models.value))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_paragraphs": pa.array([n for n, _ in found], pa.int64()),
                    "n_licenses": pa.array([len(x) for _, x in found], pa.int64()),
                    "families": pa.array([",".join(sorted({f for _, _, f, _ in x})) for _, x in found], pa.string()),
                    "spans": pa.array([",".join(f"{f}:{a}:{b}" for a, b, f, _ in x) for _, x in found], pa.string()),
                    "least_probability": pa.array([round(min(p for *_, p in x), 6) if x else None for _, x in found], pa.float64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs long, n_licenses long, families string, spans string, least_probability double")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
