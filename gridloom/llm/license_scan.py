"""Operator 8, licence scans: Dice coefficient over word bigrams against licence templates.

Text and templates are brought to lower-case words without punctuation at their ends. Templates are customary grants and
notices, and whole licence texts (`licenses`). Passages are all windows of a document, of any size. A passage of m bigrams
shares m at most, so one that reaches the threshold against a template of n has from least * n / (2 - least) to
n * (2 - least) / least, and shares as many as the former: templates of which a document holds fewer are not compared, and
windows start and end only at bigrams of the template.

A template's best window counts if it reaches the threshold and, for a grant or notice, holds the template's decisive words
(versions, and what tells licences of a family apart) and no others. Of windows that overlap only the best stays, by Dice
times what is shared, so a text is reported for the licence that it is likest to; a licence's best window is its row.

Rows. A document gives a row for each licence found, so a null, empty or clean text gives none. Among equal windows the
first counts, among equal templates the first in the list. Repeated rows are scanned each; a null doc_id stays null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import TwoGenerations, binary_rows, prepare, table, text_bytes, word_values

#: (licence, a text by which it is granted). The licences' own or customary words.
GRANTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: And the licences' whole texts.
TEMPLATES = GRANTS + tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(resources.files("gridloom.llm").joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))
LEAST = 0.8
#: What tells licences of a family apart, besides versions (fixed values), in grants and notices up to GRANT_WORDS.
DECISIVE = frozenset("lesser affero 2-clause 3-clause by-sa by-nc by-nd by-nc-sa by-nc-nd attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives".split())
GRANT_WORDS = 60
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*)")

_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())


def normal(word: bytes) -> bytes:
    """A word in lower case, without what isn't a letter or digit at its ends (bytes above ASCII stay)."""
    return word.strip(_SIGNS).lower()


def decisive(word: bytes) -> str | None:
    """What a normal word decides: a version without .0 at its end, or a word of DECISIVE."""
    text = word.decode("utf-8", "replace")
    if m := _VERSION.fullmatch(text):
        return re.sub(r"(\.0)+$", "", m[1])
    return text if text in DECISIVE else None


def words(text: bytes) -> list[bytes]:
    return [w for w in map(normal, text.split()) if w]


class Vocabulary(TwoGenerations):
    """Number of a word among the templates' words: -1 for what holds no word, 0 for others, or -2 if they are
    decisive."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__()
        self.known = known

    def compute(self, word: bytes) -> int:
        w = normal(word)
        n = self.known.get(w, 0) if w else -1
        return -2 if n == 0 and decisive(w) is not None else n


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least = least
        own = [(name, words(text.encode())) for name, text in templates]
        known = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in own for w in ws}))}
        self.vocabulary, self.base = Vocabulary(known), len(known) + 1
        self.decides = {i: d for w, i in known.items() if (d := decisive(w)) is not None}
        self.asked = [frozenset(d for w in ws if (d := decisive(w)) is not None) if len(ws) <= GRANT_WORDS else None for _, ws in own]
        self.templates = []
        for name, ws in own:
            n = [known[w] for w in ws]
            self.templates.append((name, Counter(a * self.base + b for a, b in zip(n, n[1:], strict=False))))
        self.seen = np.zeros(self.base * self.base, bool)
        self.bigrams = []
        for _, bigrams in self.templates:
            codes = np.array(sorted(bigrams), np.int64)
            self.bigrams.append((codes, np.array([bigrams[c] for c in codes.tolist()], np.int64)))
            self.seen[codes] = True
        self.sizes = np.array([sum(t.values()) for _, t in self.templates], np.int64)
        # what a passage shares at least, and its size at most
        self.needed = np.ceil(least * self.sizes / (2 - least) - 1e-9).astype(np.int64)
        self.longest = np.floor(self.sizes * (2 - least) / least + 1e-9).astype(np.int64)
        # the templates of each bigram, and how often they hold it
        owner = np.repeat(np.arange(len(self.bigrams)), [len(c) for c, _ in self.bigrams])
        code = np.concatenate([c for c, _ in self.bigrams])
        order = np.argsort(code, kind="stable")
        self.owner, self.times = owner[order], np.concatenate([n for _, n in self.bigrams])[order]
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.first = np.append(self.first, len(code))

    def open_templates(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the templates of which a document with these known bigrams holds as many as a passage must share."""
        code, n = np.unique(grams, return_counts=True)
        at = np.searchsorted(self.codes, code)
        many = self.first[at + 1] - self.first[at]
        pair = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(self.owner[pair], np.minimum(self.times[pair], np.repeat(n, many)), minlength=len(self.sizes))
        return np.flatnonzero((shared >= self.needed) & (self.sizes > 0))

    def best_window(self, k: int, hits: np.ndarray, grams: np.ndarray) -> tuple[float, int, int]:
        """Dice, first bigram and bigrams of the best of all windows for template k. grams: the bigrams at the places hits."""
        codes, most = self.bigrams[k]
        g = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
        own = codes[g] == grams
        at, g = hits[own], g[own]
        # a bigram counts in a window that starts after the last place from which on there would be more than in the template
        order = np.argsort(g, kind="stable")
        sorted_g = g[order]
        rank = np.arange(len(g)) - np.searchsorted(sorted_g, sorted_g)
        full = np.flatnonzero(rank >= most[sorted_g])
        after = np.full(len(g), -1, np.int64)
        after[order[full]] = at[order[full - most[sorted_g[full]]]]
        near = np.searchsorted(at, at + self.longest[k]) - np.arange(len(at))
        best, size = (0.0, 0, 0), int(self.sizes[k])
        for i in np.flatnonzero(near >= self.needed[k]).tolist():
            end, first = i + int(near[i]), int(at[i])
            shared = np.cumsum(after[i:end] < first)
            if shared[-1] < self.needed[k]:
                continue
            m = at[i:end] - (first - 1)
            dice = 2 * shared / (m + size)
            j = int(dice.argmax())
            if dice[j] > best[0]:
                best = float(dice[j]), first, int(m[j])
        return best

    def numbers(self, text: bytes) -> np.ndarray:
        return next(word_values([text], self.vocabulary.__getitem__))

    def windows(self, n: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(template, Dice, first bigram, bigrams) of the best window of each template that reaches the threshold."""
        n = np.maximum(n[n != -1], 0)
        grams = n[:-1] * self.base + n[1:]
        hits = np.flatnonzero(self.seen[grams]) if len(grams) else grams
        if len(hits):
            for k in self.open_templates(grams[hits]).tolist():
                best = self.best_window(k, hits, grams[hits])
                if best[0] >= self.least:
                    yield k, *best

    def decided(self, k: int, own: np.ndarray) -> bool:
        """Whether the words of a window decide as template k does."""
        asked = self.asked[k]
        if asked is None:
            return True
        found = {self.decides[x] for x in own[own >= 0].tolist() if x in self.decides}
        return found == asked and not (own < -1).any()

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, words) of each licence found."""
        return self.scan_numbers(self.numbers(text))

    def scan_numbers(self, n: np.ndarray) -> list[tuple[str, float, int, int]]:
        n = n[n != -1]
        found = [x for x in self.windows(n) if self.decided(x[0], n[x[2] : x[2] + x[3] + 1])]
        found.sort(key=lambda x: (-x[1] * x[1] * (x[3] + int(self.sizes[x[0]])), x[0]))  # Dice by what is shared, twice
        taken: list[tuple[int, int, str]] = []
        best: dict[str, tuple[float, int, int]] = {}
        for k, dice, first, m in found:
            name = self.templates[k][0]
            if all(name == other or min(first + m, b) <= max(first, a) for a, b, other in taken):
                taken.append((first, first + m, name))
                if dice > best.get(name, (0.0,))[0]:
                    best[name] = dice, first, m + 1
        return [(name, *best[name]) for name in sorted(best)]


SCHEMA = "doc_id long, license string, dice double, first_word long, n_words long"


def scan_documents(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            out = [(doc_id, *x) for doc_id, n in zip(batch.column(0).to_pylist(), word_values(binary_rows(batch, "body"), scanner.vocabulary.__getitem__), strict=True) for x in scanner.scan_numbers(n)]
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    prepare(docs.sparkSession)
    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
