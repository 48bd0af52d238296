"""Licence scan: a trained paragraph classifier with an unknown class, confirmed against templates.

A paragraph is a run of lines up to one without words (comment marks are no words). Its word n-grams that occur in licence notices are
looked up, neighbouring ones form a passage, and a sparse logistic regression over the passage's n-grams names the licence family or
``unknown``. The model is trained on altered copies of the notices, which are whole licence paragraphs and sentences made of customary patterns and
names, against the same sentences with names of no family, mixtures of the notices' words, and passages sampled from the
corpus itself; a temperature calibrates it. A named family counts if the passage is like one of its templates: the share of the
template's n-grams that it holds, weighed by how few families use them, tolerates edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .langid import ftrl, softmax, temperature
from .scratch import batches

# What the licences are customarily called, whole first.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache 2.0", "Apache-2.0"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-4.0"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc0-1.0": ["Creative Commons Zero 1.0 Universal", "CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL version 2", "GPLv2", "GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL version 3", "GPLv3", "GPL-3.0"],
    "mit": ["MIT License", "MIT Expat License", "Expat License", "MIT"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
}
# Customary sentences around a name.
PATTERNS = [
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "Distributed under the terms of the {}.", "Published under the {}.",
    "Made available under the {}.", "This project is licensed under the {}.", "This project is {} licensed.", "This software is available under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This file is subject to the terms of the {}.", "Use of this source code is governed by the {}.", "License: {}", "SPDX-License-Identifier: {}", "See the {} for details.",
]
# Customary paragraphs of the licences and of the notices that they ask for.
PARAGRAPHS = {
    "agpl-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache-2.0": ["Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc0-1.0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "Mozilla Public License Version 2.0"],
}
# Licences of no family here.
OTHERS = ["Eclipse Public License 2.0", "ISC License", "Artistic License 2.0", "European Union Public Licence, version 1.2", "Open Font License, Version 1.1", "Business Source License 1.1", "terms of our shop", "terms of service", "Lesser General Public License, version 3", "BSD 2-Clause License"]


def notices() -> dict[str, list[str]]:
    """Every family's templates: each of its names in each pattern, and its paragraphs."""
    return {f: [p.format(n) for n in names for p in PATTERNS] + PARAGRAPHS.get(f, []) for f, names in NAMES.items()}


UNKNOWN = "unknown"
ORDERS, GAP, CONFIRM = (1, 2, 3), 6, 0.7
COMMON = {b"the", b"of", b"and", b"to", b"in", b"is", b"a", b"or", b"it", b"this", b"that", b"by", b"you", b"are", b"any", b"for", b"with", b"as", b"at", b"be", b"on", b"not", b"has", b"use", b"can", b"may", b"all", b"from", b"under"}
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    k = max(0, len(h) - n + 1)
    out = np.full(k, n, dtype=np.uint64)
    for d in range(n):
        out += h[d : d + k] * tx.MIX[d]
    return tx.mixed(out)


def _notice(text: str) -> tuple[np.ndarray, list[bytes]]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = tx.Words(raw, np.array([0, len(raw)]), 0, 1, WORD)
    return w.hash, [w.bytes[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]


@dataclass
class Model:
    families: list[str]
    grams: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[np.ndarray]]  # a family's templates as features
    rarity: np.ndarray  # of a feature: log(families / families that use it) and a little
    words: int  # of the longest template

    def features(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, feature, position of the last word) of the known n-grams of some words."""
        place, feature, last = [], [], []
        for n in ORDERS:
            g = _grams(h, n)
            if len(g):
                at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
                hit = np.flatnonzero(self.grams[at] == g)
                place.append(hit)
                feature.append(at[hit])
                last.append(hit + n - 1)
        if not place:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        place, feature, last = np.concatenate(place), np.concatenate(feature), np.concatenate(last)
        order = np.argsort(place, kind="stable")
        return place[order], feature[order], last[order]

    def likeness(self, held: np.ndarray, family: str) -> float:
        """The largest share of a template of the family that the features make up, by rarity."""
        has = np.zeros(len(self.grams), dtype=bool)
        has[held] = True
        return max(float((self.rarity[t] * has[t]).sum() / self.rarity[t].sum()) for t in self.templates[family])

    def verdict(self, held: np.ndarray) -> tuple[str, float]:
        """Family and probability for a passage's features; a family that no template confirms is unknown."""
        held = np.unique(held)
        p = softmax((self.weights[held].sum(axis=0) / np.sqrt(max(1, len(held))) + self.bias) / self.temperature)
        best = int(p.argmax())
        family = self.families[best]
        if family != UNKNOWN and self.likeness(held, family) < CONFIRM:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)])
        return family, float(p[best])


def untrained(texts: dict[str, list[str]] | None = None) -> Model:
    """The n-grams and templates of the notices, without weights."""
    hashed = [(f, *_notice(t)) for f, given in (texts or notices()).items() for t in given]
    users: dict[int, set[str]] = {}
    for f, h, words in hashed:
        for n in ORDERS:
            for k, g in enumerate(_grams(h, n).tolist()):
                if n > 1 or words[k] not in COMMON:
                    users.setdefault(g, set()).add(f)
    families = [*sorted({f for f, _, _ in hashed}), UNKNOWN]
    grams = np.sort(np.array(list(users), dtype=np.uint64))
    rarity = np.log(len(families) / np.array([len(users[g]) for g in grams.tolist()])) + 0.1
    m = Model(families, grams, np.zeros((len(grams), len(families))), np.zeros(len(families)), 1.0, {}, rarity, max(len(h) for _, h, _ in hashed))
    for f, h, _ in hashed:
        m.templates.setdefault(f, []).append(np.unique(m.features(h)[1]))
    return m


def train(negatives: list[np.ndarray] = [], texts: dict[str, list[str]] | None = None, copies: int = 6, seed: int = 0) -> Model:  # noqa: B006
    """A model from altered copies of the notices, against notices of other names, mixtures, and ``negatives``: features of passages."""
    rng = np.random.default_rng(seed)
    texts = texts or notices()
    m = untrained(texts)
    unknown = len(m.families) - 1
    rows, y = [], []

    def add(h: np.ndarray, label: int, altered: bool) -> None:
        kept = h[rng.random(len(h)) > (0.08 if altered else 0.0)]
        rows.append(np.unique(m.features(np.concatenate([kept, rng.integers(1, 2**62, 3).astype(np.uint64)]))[1]))
        y.append(label)

    for f, given in texts.items():
        for t in given:
            h = _notice(t)[0]
            for k in range(copies if len(h) < 16 else 4 * copies):
                add(h, m.families.index(f), k > 0)
    for p in PATTERNS:
        for n in OTHERS:
            add(_notice(p.format(n))[0], unknown, False)
        for _ in range(3 * len(OTHERS)):  # a name of no known words, and its version
            name = rng.integers(1, 2**62, int(rng.integers(1, 4))).astype(np.uint64)
            add(np.concatenate([_notice(p.split("{")[0])[0], name, _notice(rng.choice(["License", "License 2.0", "License, version 3", "Public License", ""]))[0]]), unknown, False)
    pool = np.concatenate([_notice(t)[0] for given in texts.values() for t in given[:: len(PATTERNS)]])
    for k in range(len(rows) // 3):  # words of notices in no notice's order
        add(rng.choice(pool, int(rng.integers(1, 12))), unknown, False)
    rows += [np.unique(n) for n in negatives]
    y += [unknown] * len(negatives)
    vectors = [(r, np.full(len(r), 1 / np.sqrt(max(1, len(r))))) for r in rows]
    y = np.array(y)
    out = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~out)
    m.weights, m.bias = ftrl([vectors[i] for i in fit], y[fit], len(m.families), len(m.grams), epochs=5, l1=0.01, l2=0.001)
    m.temperature = temperature(np.array([x @ m.weights[r] + m.bias for r, x in (vectors[i] for i in np.flatnonzero(out))]), y[out])
    return m


def _runs_of_lines(judge, most: int, feature: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, float]:
    """Families in a passage by its runs of lines, so that neighbouring notices are named each by its own lines.

    Every line of a notice holds a word of it, so runs need no more lines than the longest notice has words (``most``).
    Of a family's runs the shortest count; a run of several lines inside another family's is part of that notice.
    """
    lines = np.union1d(first, last)
    starts, to = np.searchsorted(first, lines), np.searchsorted(lines, last)
    ends = np.append(starts[1:], len(first))
    reach: dict[str, np.ndarray] = {}  # by first line, the last line of a family's run
    runs: list[tuple[int, int, str, float]] = []
    for size in range(min(most, len(lines))):
        for i in range(len(lines) - size):
            j, at = i + size, slice(starts[i], ends[i + size])
            family, p = judge(feature[at][to[at] <= j])
            if family == UNKNOWN:
                continue
            own = reach.setdefault(family, np.full(len(lines), len(lines)))
            if own[i : j + 1].min() > j:
                own[i] = j
                runs.append((i, j, family, p))
    got: dict[str, float] = {}
    for i, j, family, p in runs:
        if i == j or not any(f != family and x <= i and j <= y and y - x > j - i for x, y, f, _ in runs):
            got[family] = max(p, got.get(family, 0.0))
    return got


class Passages:
    """The passages of a range of texts: runs of known n-grams at most GAP words apart in one paragraph, one of them used by few families."""

    def __init__(self, model: Model, raw: np.ndarray, offsets: np.ndarray, i: int, j: int):
        self.words = w = tx.Words(raw, offsets, i, j, WORD)
        ends = np.cumsum(np.append(0, raw[offsets[i] : offsets[j]] == 10))
        self.line = ends[w.start] if len(w.start) else np.empty(0, np.int64)
        self.part = np.cumsum(np.append(False, (np.diff(self.line) > 1) | (np.diff(w.row) != 0))) if len(self.line) else self.line
        place, feature, last = model.features(w.hash)
        # an n-gram may not run over a paragraph or text
        keep = (w.row[place] == w.row[last]) & (self.part[place] == self.part[last])
        self.place, self.feature, self.last = place[keep], feature[keep], last[keep]
        p = self.place
        self.starts = np.flatnonzero(np.append(True, (np.diff(p) > GAP) | (np.diff(self.part[p]) != 0) | (np.diff(w.row[p]) != 0))) if len(p) else np.empty(0, np.int64)
        self.ends = np.append(self.starts, len(p))[1:]
        self.telling = np.maximum.reduceat(model.rarity[self.feature], self.starts) > np.log(len(model.families) / 3) if len(self.starts) else np.empty(0, bool)


def _sampled(shared):
    """(at, held): features of passages that are like no template, with a hash to order them by."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            at, held = [], []
            for i, j in tx.chunks(offsets):
                x = Passages(model, raw, offsets, i, j)
                for a, b in zip(x.starts, x.ends, strict=True):
                    features = np.unique(x.feature[a:b])
                    if b - a > 2 and max(model.likeness(features, f) for f in model.templates) < CONFIRM - 0.2:
                        at.append(int(x.words.hash[x.place[a]] ^ tx.mixed(offsets[i : i + 1].astype(np.uint64))[0]) >> 1)
                        held.append(features.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["at", "held"])

    return run


def _scanned(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        cache: dict[bytes, tuple[str, float]] = {}

        def judge(features: np.ndarray) -> tuple[str, float]:
            held = np.unique(features)
            key = held.tobytes()
            if key not in cache:
                if len(cache) > 50_000:
                    cache.clear()
                cache[key] = model.verdict(held)
            return cache[key]

        for batch in it:
            raw, offsets = tx.buffers(batch.column("text"))
            paragraphs, found, sure, licensed = [], [], [], []
            for i, j in tx.chunks(offsets):
                x = Passages(model, raw, offsets, i, j)
                w, line, part = x.words, x.line, x.part
                got: list[dict[str, float]] = [{} for _ in range(j - i)]
                where: list[set[int]] = [set() for _ in range(j - i)]
                for a, b in zip(x.starts[x.telling], x.ends[x.telling], strict=True):
                    r = int(w.row[x.place[a]])
                    for family, p in _runs_of_lines(judge, model.words, x.feature[a:b], line[x.place[a:b]], line[x.last[a:b]]).items():
                        got[r][family] = max(p, got[r].get(family, 0.0))
                        where[r].add(int(part[x.place[a]]))
                paragraphs += [int(np.unique(part[w.at[r] : w.at[r + 1]]).size) for r in range(j - i)]
                found += [",".join(sorted(g)) for g in got]
                sure += [max(g.values(), default=0.0) for g in got]
                licensed += [len(v) for v in where]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(paragraphs, pa.int64()), pa.array(licensed, pa.int64()), pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "n_paragraphs", "n_licensed", "families", "score"])

    return run


def trained(docs: DataFrame, most: int = 2000) -> Model:
    """A model whose negatives include at most ``most`` passages of ``docs`` that are like no template: about one text in as many as that takes."""
    spark = docs.sparkSession
    batches(spark)
    share = max(1, docs.count() // (4 * most))
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    held = rows.mapInArrow(_sampled(spark.sparkContext.broadcast(untrained())), "at long, held array<long>").distinct().orderBy("at", "held").limit(most).collect()
    return train([np.array(r.held, dtype=np.int64) for r in held])


def scan(docs: DataFrame, most: int = 2000) -> DataFrame:
    """Licence families named in every whole text of ``docs`` (doc_id, text).

    Returns a row per input row: doc_id, n_paragraphs, n_licensed (of them with a confirmed family),
    families (their names, sorted, comma-joined; empty for none), score (the highest probability; 0 for none).
    Null and empty texts have no paragraphs; repeated rows are scanned alike; a null doc_id is kept; empty table: no rows;
    other columns are ignored. ``most`` bounds the corpus passages that the model learns from.
    """
    spark = docs.sparkSession
    model = trained(docs, most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned(spark.sparkContext.broadcast(model)), f"doc_id {kind}, n_paragraphs long, n_licensed long, families string, score double")
