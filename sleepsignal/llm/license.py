"""Licence scan: a trained paragraph classifier, whose predictions templates confirm.

Paragraphs are the lines of a text. Sparse word and word-pair features go through a softmax regression over the
licence families and ``unknown``. It is trained on copies of the templates below, with words left out, cut
short, or with names and years put in, and on a bounded sample of the corpus's own lines as ``unknown``. On a
part kept apart, one temperature calibrates the probabilities, and the least probability of a family is set so
that at most ``FALSE_RATE`` of unknown lines pass. A prediction counts only if enough of the paragraph's word
triples, or of a template's, are found in the other: a line that merely has licence words stays unknown.

A notice may stand inside a line of any length. Places where word triples of any template occur are joined over
gaps of up to ``GAP`` words, and each piece of a line that comes of it, and each sentence in it, is classified and
confirmed as a line is, but must share ``PIECE`` triples times ``CONFIRM`` with a template, or that part of a
shorter one: the piece was chosen for its triples. Text without a template's triples could not be confirmed anyway.
Lines that are a licence's title or a label with its name, and SPDX identifiers anywhere, count as they are, with a
probability of 1.

Nulls and edge cases: null and empty texts have no paragraph and no licence; a paragraph of fewer than three
words is unknown unless it is a title; an empty table gives no rows; equal rows get equal results; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.llm.common import MIX_A, WordHashes, mix, slices, small_batches, unit
from sleepsignal.llm.ngrams import WORDS, Grams

#: Opening and notice texts of common public licences, by family.
TEMPLATES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL-3.0.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, public domain dedication.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL-2.0 license.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the LGPL-2.1.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Lines that have licence words and are no licence.
NO_LICENCE = [
    "The driver had lost her license and was not permitted to use the public road.",
    "He was granted permission to copy the documents by the general council.",
    "The software was published under a new name without any change of its source.",
    "The author retains the right to distribute the work in any form she likes.",
    "A license fee is due for any purpose that the agreement does not name.",
    "The mozilla and the apache were mentioned in the general report, version two.",
    "Free copies of the file can be obtained from the library for a fee.",
    "This program is shown on public television every year.",
]
#: Names of the families; as a line of their own, or in one with only "license" or "the", they are titles.
NAMES = {
    "AGPL": ["GNU Affero General Public", "GNU AGPL", "AGPL-3.0", "AGPLv3", "AGPL"],
    "Apache": ["Apache", "Apache 2.0", "Apache-2.0", "Apache Version 2.0"],
    "BSD": ["BSD", "BSD 2-Clause", "BSD 3-Clause", "BSD-2-Clause", "BSD-3-Clause", "New BSD", "Simplified BSD", "Modified BSD"],
    "CC-BY": ["Creative Commons Attribution", "Creative Commons Attribution 4.0 International", "CC BY", "CC BY 4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC", "CC BY-NC 4.0", "CC BY-NC-SA", "CC BY-NC-SA 4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA", "CC BY-SA 4.0"],
    "CC0": ["CC0", "CC0 1.0", "CC0 1.0 Universal"],
    "GPL": ["GNU General Public", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"],
    "ISC": ["ISC"],
    "LGPL": ["GNU Lesser General Public", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "MIT": ["MIT"],
    "MPL": ["Mozilla Public", "MPL", "MPL-2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
}
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
SPDX_IDS = {
    "AGPL": r"AGPL-\d.*", "Apache": r"Apache-\d.*", "BSD": r"BSD-\d.*|0BSD", "CC-BY": r"CC-BY-\d.*", "CC-BY-NC": r"CC-BY-NC(-SA|-ND)?-\d.*", "CC-BY-SA": r"CC-BY-SA-\d.*",
    "CC0": r"CC0-\d.*", "GPL": r"GPL-\d.*", "ISC": "ISC", "LGPL": r"LGPL-\d.*", "MIT": "MIT|MIT-0", "MPL": r"MPL-\d.*", "Unlicense": "Unlicense",
}
GAP, PIECE = 12, 10
UNKNOWN = "unknown"
COPIES, LINES = 120, 6000
FALSE_RATE = 0.001
CONFIRM = 0.6


def variants(text: str, rng: np.random.Generator, copies: int) -> list[str]:
    """Copies of a template with words left out, cut short, or with a name and a year put in."""
    words = text.split()
    out = [text]
    for _ in range(copies - 1):
        keep = [w for w in words if rng.random() > 0.08]
        if len(keep) > 12 and rng.random() < 0.3:
            a = int(rng.integers(0, len(keep) - 8))
            keep = keep[a: a + int(rng.integers(8, len(keep)))]
        if rng.random() < 0.3:
            at = int(rng.integers(0, len(keep) + 1))
            keep[at:at] = [f"x{int(rng.integers(0, 1000))}", str(int(rng.integers(1990, 2030)))]
        out.append(" ".join(keep))
    return out


def triples(text: str) -> set[tuple[str, ...]]:
    w = WORDS.findall(text.lower())
    return {tuple(w[i: i + 3]) for i in range(len(w) - 2)}


def titles() -> dict[tuple[str, ...], str]:
    """Words of a line that is a title, to the family. A name of one plain word is none without "license"."""
    out = {}
    for family, names in NAMES.items():
        for name in names:
            bare = tuple(WORDS.findall(name.lower()))
            forms = [("license", *bare), ("licence", *bare), (*bare, "license"), (*bare, "licence")]
            if bare[0] == "apache" and len(bare) > 2:  # Apache License, Version 2.0
                forms.append(("apache", "license", *bare[1:]))
            if name == "Apache":
                forms.append(("apache", "license", "version", "2", "0"))
            if family == "MPL" and "public" in bare:
                forms += [(*bare, "license", "version", "2", "0"), (*bare, "license", "2", "0")]
            if family.endswith("GPL") and "public" in bare:
                forms += [(*bare, "license", "version", v) for v in ("2", "3")]
            if "commons" in bare and "4" in bare:
                forms += [(*bare, "public", "license"), (*bare[:-3], "license")]
            if len(bare) > 1 and name not in ("Apache Version 2.0", "GNU General Public", "Mozilla Public") or family == "CC0":
                forms.append(bare)
            if name == "Unlicense":
                forms.append(("the", "unlicense"))
            for form in forms:
                out |= {form: family, ("the", *form): family, (*form, bare[-1]): family, ("the", *form, bare[-1]): family}
    return out


def spdx(text: str) -> set[str]:
    """Families that SPDX identifiers in ``text`` name; of expressions all that they join."""
    found = set()
    for line in SPDX.findall(text):
        expr = re.match(r"\(*[\w.+-]+\)*(\s+(AND|OR|WITH)\s+\(*[\w.+-]+\)*)*", line)
        ids = re.sub(r"\bWITH\s+\S+", "", expr.group()) if expr else ""
        for x in re.findall(r"[\w.+-]+", ids):
            found |= {f for f, p in SPDX_IDS.items() if re.fullmatch(p, x.rstrip("."), re.I)}
    return found


class Places:
    """Finds the pieces of lines in which word triples of templates stand."""

    def __init__(self):
        self.words = WordHashes(150_000)
        flat = sorted({t for ts in TEMPLATES.values() for x in ts for t in triples(x)})
        self.known = np.unique(self.mixed(self.words.of([w for t in flat for w in t]))[::3])
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        return mix((h[:-2] * MIX_A + h[1:-1]) * MIX_A + h[2:])

    def of(self, tokens: list[list[str]]) -> list[tuple[int, int, int]]:
        """Line, first and last place of triples of each piece with at least two."""
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        h = self.words.of([w for t in tokens for w in t])
        if len(h) < 3:
            return []
        m = self.mixed(h)
        at = np.flatnonzero(self.near[(m & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[self.known[np.minimum(np.searchsorted(self.known, m[at]), len(self.known) - 1)] == m[at]]
        ends = np.cumsum(counts)
        line = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[line] if len(at) else np.zeros(0, bool)
        at, line = at[inside], line[inside]
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(line) != 0) | (np.diff(at) > GAP)) + 1, [len(at)]])
        start = ends - counts
        return [(int(line[a]), int(at[a] - start[line[a]]), int(at[b - 1] - start[line[a]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]


def pieces(tokens: list[list[str]], lines: list[str], places: Places) -> list[tuple[int, str]]:
    """Line and words of every piece that may be a notice, and of its sentences."""
    out = {}
    for i, a, b in places.of(tokens):
        out[i, a, b + 3] = None
        ends = np.cumsum([len(WORDS.findall(x)) for x in re.split(r"(?<=[.;!?])\s+", lines[i].lower())])
        inner = [a, *ends[(ends > a) & (ends < b + 3)].tolist(), b + 3]
        out |= {(i, x, y): None for x, y in zip(inner[:-1], inner[1:], strict=True) if y - x > 2}
    return [(i, " ".join(tokens[i][a:b])) for i, a, b in out]


class Classifier:
    """Softmax regression over the features that templates have."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: np.ndarray, classes: list[str]):
        self.features, self.weights, self.bias, self.classes = features, weights, bias, classes
        self.temperature, self.least = 1.0, 0.5
        self.near = np.zeros(1 << 16, bool)
        self.near[(features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def columns(self, feats: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known features, each once a row, and their rows."""
        near = self.near[(feats & np.uint64(0xFFFF)).astype(np.int64)]
        feats, row = feats[near], row[near]
        k = np.minimum(np.searchsorted(self.features, feats), len(self.features) - 1)
        hit = self.features[k] == feats
        pair = np.unique(row[hit].astype(np.int64) * len(self.features) + k[hit])
        return pair % len(self.features), pair // len(self.features)

    def logits(self, column: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.stack([np.bincount(row, w[column], n) for w in self.weights.T], axis=1)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(lines: list[str], copies: int = COPIES, rounds: int = 150, l2: float = 1e-4) -> Classifier:
    """Train on template copies and ``lines`` as unknown; every fourth example is kept apart to calibrate."""
    rng, grams = np.random.default_rng(3), Grams(stems=False)
    classes = sorted(TEMPLATES) + [UNKNOWN]
    known = [t for ts in TEMPLATES.values() for x in ts for t in triples(x)]
    known = set(known)
    lines = [x for x in lines if (t := triples(x)) and len(t & known) < CONFIRM * len(t)]
    every = [triples(x) for ts in TEMPLATES.values() for x in ts]
    noticed = {i for i, x in pieces([WORDS.findall(x.lower()) for x in lines], lines, Places()) if confirm(x, every, PIECE) >= CONFIRM}
    lines = [x for i, x in enumerate(lines) if i not in noticed]
    texts, target = [], []
    for c, family in enumerate(classes[:-1]):
        for template in TEMPLATES[family]:
            some = variants(template, rng, copies)
            texts += some
            target += [c] * len(some)
    cross = [v for x in NO_LICENCE for v in variants(x, rng, copies)]
    texts += lines + cross
    y = np.array(target + [len(classes) - 1] * (len(lines) + len(cross)))
    features = np.unique(grams.of([x for ts in TEMPLATES.values() for x in ts])[0])
    model = Classifier(features, np.zeros((len(features), len(classes))), np.zeros(len(classes)), classes)
    column, row = model.columns(*grams.of(texts))
    apart = np.arange(len(y)) % 4 == 3
    weight = np.where(apart, 0.0, 1.0 / np.maximum(1, np.bincount(y, minlength=len(classes)))[y])
    weight /= weight.sum()
    square = np.full_like(model.weights, 1e-8)
    one = np.eye(len(classes))[y]
    for _ in range(rounds):
        grad = (model.probabilities(model.logits(column, row, len(y))) - one) * weight[:, None]
        dw = np.stack([np.bincount(column, g[row], len(features)) for g in grad.T], axis=1) + l2 * model.weights
        square += dw * dw
        model.weights -= 0.3 * dw / np.sqrt(square)
        model.bias -= 2.0 * grad.sum(axis=0)
    logits = model.logits(column, row, len(y))[apart]
    scale = np.geomspace(0.1, 10, 41)
    loss = []
    for model.temperature in scale:
        p = model.probabilities(logits)
        loss.append(-np.log(np.maximum(p[np.arange(len(p)), y[apart]], 1e-12)).mean())
    model.temperature = float(scale[int(np.argmin(loss))])
    best = model.probabilities(logits)[y[apart] == len(classes) - 1][:, :-1].max(axis=1)
    model.least = float(np.clip(np.quantile(best, 1 - FALSE_RATE), 0.5, 0.99)) if len(best) else 0.5
    return model


def sample_lines(docs: DataFrame, lines: int = LINES) -> list[str]:
    """At most ``lines`` lines of at most 400 characters, from about ``lines`` / 4 documents."""
    n = max(1, docs.count())
    some = docs.filter(unit(F.col("doc_id"), 31) < lines / 4 / n).select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    return [r["line"] for r in some.filter(F.length("line").between(10, 400)).limit(lines).collect()]


def confirm(text: str, templates: list[set], least: int = 1) -> float:
    """Largest share of the paragraph's triples, taken as ``least`` at least, found in a template, or of a template's found in the paragraph."""
    t = triples(text)
    return max((len(t & x) / min(max(len(t), least), len(x)) for x in templates if t), default=0.0)


FOUND = "families array<string>, n_paragraphs int, score double"


def with_licences(docs: DataFrame, model: Classifier, name: str = "licences") -> DataFrame:
    """Add a struct ``name``: confirmed families in order, paragraphs that have one, the largest probability."""
    by_family = {f: [triples(x) for x in ts] for f, ts in TEMPLATES.items()}

    named = titles()

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, places = Grams(stems=False), Places()
        for whole in batches:
            rows = []
            for part in slices(pa.record_batch({"text": whole}), "text", 2_000_000):
                texts = part.column(0).to_pylist()
                lines = [re.split(r"\n+", t) if t else [] for t in texts]
                flat = [x for ls in lines for x in ls]
                doc = np.repeat(np.arange(len(lines)), [len(ls) for ls in lines])
                out = [{"families": [], "n_paragraphs": 0, "score": 0.0} for _ in texts]
                found: dict[int, dict[str, float]] = {}  # by line

                def add(i: int, family: str, p: float, found: dict = found) -> None:
                    had = found.setdefault(i, {})
                    had[family] = max(p, had.get(family, 0.0))

                tokens = [WORDS.findall(x.lower()) for x in flat]
                for i, words in enumerate(tokens):
                    if 0 < len(words) < 12 and (family := named.get(tuple(words))):
                        add(i, family, 1.0)
                for i, x in enumerate(flat):
                    if "identifier" in x.lower():
                        for family in spdx(x):
                            add(i, family, 1.0)
                cut_out = pieces(tokens, flat, places)
                del tokens
                every, line = flat + [x for _, x in cut_out], [*range(len(flat)), *(i for i, _ in cut_out)]
                column, row = model.columns(*grams.of(every)) if every else (np.empty(0, np.int64),) * 2
                seen, row = np.unique(row, return_inverse=True)  # paragraphs with a template's word
                p = model.probabilities(model.logits(column, row, len(seen)))[:, :-1] if len(seen) else np.empty((0, 1))
                for i in np.flatnonzero(p.max(axis=1) >= model.least) if len(seen) else []:
                    family, k = model.classes[int(p[i].argmax())], int(seen[i])
                    if confirm(every[k], by_family[family], 1 if k < len(flat) else PIECE) >= CONFIRM:
                        add(line[k], family, float(p[i].max()))
                for i, families in found.items():
                    r = out[doc[i]]
                    r["families"] = sorted({*r["families"], *families})
                    r["n_paragraphs"] += 1
                    r["score"] = max(r["score"], *families.values())
                rows += out
            yield pa.array(rows, pa.struct([("families", pa.list_(pa.string())), ("n_paragraphs", pa.int32()), ("score", pa.float64())]))

    small_batches(docs.sparkSession)
    return docs.withColumn(name, scan(F.col("text").cast("string")))


def scan_licences(docs: DataFrame, name: str = "licences", lines: int = LINES) -> DataFrame:
    """Train on the templates and on lines of ``docs``, and scan every document."""
    return with_licences(docs, fit(sample_lines(docs, lines)), name)
