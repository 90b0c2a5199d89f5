"""Operator 9: licence scans by a trained paragraph classifier with template confirmation.

Every line of every text is a paragraph, and so is every block of lines between blank ones (lines
without a letter or digit); a block counts for the families that none of its lines has.  A multinomial
logistic regression over sparse hashed word unigrams and bigrams (A-Z lower-cased, punctuation split
off) gives the chance of each licence family and of ``unknown``.  It is trained on statements built from public licence
names, short names, SPDX ids and grant phrases, and on the body paragraphs of the licences, against
unknown paragraphs: hash-sampled lines of the corpus and sentences that mention licences without
granting one.  One factor on all scores is calibrated on held-out statements and unknown lines; where
the families together are less than ``CERTAIN`` the verdict is unknown.  A prediction counts only when
the nearest template confirms it, and that template names the family: at least ``CONFIRM`` of the words
and word pairs of a full name, of a short name and the grant around it, or of a body paragraph occur in
the paragraph.

Paragraphs are scored in Arrow batches; only those with a word of the licence vocabulary (``CUE``, of
which every template has one) reach the model.  The training sample is bounded by ``SAMPLE`` corpus
lines, none of which a template confirms.

Defined cases: null and blank texts have no paragraph; a text with several families gives a row for
each; rows that share a doc_id are summed; a null doc_id is grouped as one; texts without a licence
give no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 2000
BITS = 14
CERTAIN = 0.6
CONFIRM = 0.75
_TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_CUE = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|creative commons|warranty|\bspdx\b|redistribut"
#: Every template has one of these; version numbers may follow a name (GPLv3, LGPL2.1, CC0).
CUE = _CUE + (
    r"|licensing|warranties|\bpermission\b|free software|source code form|\bcc0|\bcc[ -]by|\b[al]?gpl(?:v?[0-9]|\b)|\bmplv?[0-9]?"
    r"|\bmit\b|\bapache|\basl\b|\bbsd|\bgnu\b|\bmozilla\b|\bexpat\b|liable for any|attribution"
)
_FAMILY = re.compile(r"\b(?:general|lesser|affero|mozilla|apache|noncommercial|sharealike|noderivatives)\b|\bcc(?=0)")
_BLANK = re.compile(r"\n(?:[^\w\n]*\n)+")

#: Names of each family, as its licences call themselves.
NAMES = {
    "mit": ("MIT License", "MIT licence", "Expat License"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL version 2 or later", "GPL-3.0 license"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "LGPL-3.0 license"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "modified BSD license"),
    "mpl": ("Mozilla Public License, version 2.0", "MPL 2.0 license"),
    "agpl": ("GNU Affero General Public License, version 3", "AGPL-3.0 license"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "cc0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal public domain dedication"),
}
_CC = {
    "cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nc": "Attribution-NonCommercial", "cc-by-nd": "Attribution-NoDerivatives",
    "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
#: Short names and SPDX ids of each family.  They are words of other texts as well, so a grant must stand around them.
SHORT = {
    "mit": ("MIT", "Expat", "X11 MIT"),
    "apache": ("Apache 2.0", "Apache-2.0", "Apache License", "Apache 2", "ASL 2.0"),
    "gpl": ("GPL", "GPLv2", "GPLv3", "GPL 2", "GPL 3", "GPL v2", "GPL v3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GNU GPL", "GNU GPLv3", "GNU General Public License"),
    "lgpl": ("LGPL", "LGPLv2.1", "LGPLv3", "LGPL v2.1", "LGPL v3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "GNU LGPL", "GNU Lesser General Public License", "GNU Library General Public License"),
    "bsd": ("BSD", "BSD license", "BSD-3-Clause", "BSD-2-Clause", "New BSD", "BSD-style license", "3-clause BSD", "2-clause BSD"),
    "mpl": ("MPL", "MPL 2.0", "MPLv2", "MPL-2.0", "Mozilla Public License"),
    "agpl": ("AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL", "GNU Affero General Public License"),
    "cc0": ("CC0", "CC0-1.0", "CC0 1.0 Universal"),
} | {
    name: (name.replace("-", " ", 1).upper(), name.upper(), *(f"{name.replace('-', ' ', 1).upper()} {v}" for v in ("2.0", "2.5", "3.0")), f"{name.upper()}-3.0", f"{name.upper()}-4.0",
           f"Creative Commons {title}", f"Creative Commons {title} 3.0", f"Creative Commons {title} License")
    for name, title in _CC.items()
}
_DISCLAIMER = (
    "This software is provided by the {} \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed. In no event shall the {} be liable for any direct, indirect, incidental, special, exemplary, or "
    "consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
    "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of "
    "the use of this software, even if advised of the possibility of such damage."
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.",
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.",
    "You should have received a copy of the GNU {1} along with {0}. If not, see <https://www.gnu.org/licenses/>.",
)
#: Paragraphs of the licences and their notices.
BODIES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a "
        "particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
        "of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ),
    "gpl": tuple(b.format(w, "General Public License", v) for w, v in (("This program", "3"), ("This program", "2")) for b in _GNU),
    "lgpl": tuple(b.format(w, "Lesser General Public License", v) for w, v in (("This program", "3"), ("This library", "2.1")) for b in _GNU),
    "agpl": tuple(b.format("This program", "Affero General Public License", "3") for b in _GNU),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        _DISCLAIMER.format("copyright holders and contributors", "copyright holder or contributors"),
        _DISCLAIMER.format("regents and contributors", "regents or contributors"),
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "cc0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
} | {
    name: (
        f"This work is licensed under the Creative Commons {title} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{name[3:]}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        f"Except where otherwise noted, content on this site is licensed under a Creative Commons {title} 4.0 International license.",
    )
    for name, title in _CC.items()
}
#: How works say that they are under a licence.
GRANTS = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.",
    "This work is licensed under the {}.", "This software is distributed under the terms of the {}.",
    "Distributed under the {}, see the file for details.", "Code is available under the {}.",
    "You may use this file under the {}.", "Permission is granted under the {}.", "{}", "License: {}",
)
#: What stands around short names.
SHORT_GRANTS = (
    "Licensed under {}.", "Licensed under the {}.", "Licensed under a {} license.", "Released under {}.", "Released under the {}.", "Released under a {} license.",
    "This work is licensed under {}.", "This file is under the {}.", "This project is under the {} license.", "Distributed under the {}.", "Available under the {}.",
    "Published under {}.", "SPDX-License-Identifier: {}", "License: {}", "Licence: {}", "{} license", "{} licence", "{} licensed", "Under the terms of the {}.", "Distributed under the terms of {}.",
)
#: Sentences about licences that grant none.
OTHER = (
    "All rights reserved.", "Copyright 2020 the authors.", "The license plate was missing.", "He lost his driving license.",
    "See the license agreement of your vendor.", "Licensed premises close at ten.", "This product comes with no warranty.",
    "The poet took some license with the facts.", "Public domain names are resolved first.", "Released in version 2.0 for the general public.",
    "The Apache helicopter was released in 1986.", "A student at MIT wrote this.", "Under the terms of the contract the work is done.",
    "A general license to trade was granted by the crown.", "Proprietary license: redistribution is forbidden.",
    "Licensed under the contract.", "Released under the name of the band.", "License: none", "Distributed under the terms of a sales contract.", "Published under a pen name.",
    "This file is under the desk.", "She asked for permission to leave.", "The patient was released under the care of a doctor.", "Available under the counter.",
    "He studied at MIT and liked the apache helicopter.", "He went to MIT.", "The GNU project began in 1983.", "FreeBSD and other BSD systems run here.", "Apache served the pages.",
    "Das Haus mit Garten.", "The GPL was written by Stallman.", "Mozilla makes a browser.", "Attribution of the painting is disputed.",
)


def tokens(line: str) -> list[str]:
    return _TOKEN.findall(line.lower())


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    import zlib

    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    index, n = np.unique([zlib.crc32(g.encode()) >> (32 - BITS) for g in grams], return_counts=True)
    value = n / np.sqrt((n * n).sum()) if len(n) else n
    return index.astype(np.int64), value.astype(float)


def _grams(words: list[str]) -> tuple[set, set]:
    return set(words), set(zip(words, words[1:], strict=False))


def fit_softmax(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dim: int, rounds: int = 80, l2: float = 1e-6):
    """``(weights, bias)`` of a multinomial logistic regression by AdaGrad over the full sample, classes balanced."""
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = (1 / np.maximum(np.bincount(y, minlength=classes), 1) / classes)[y]
    truth = np.eye(classes)[y]
    w, bias, seen, seen0 = np.zeros((classes, dim)), np.zeros(classes), np.full((classes, dim), 1e-12), np.full(classes, 1e-12)
    for _ in range(rounds):
        z = np.stack([np.bincount(row, w[k][index] * value, len(rows)) for k in range(classes)], 1) + bias
        error = (_softmax(z) - truth) * share[:, None]
        for k in range(classes):
            grad = np.bincount(index, error[row, k] * value, dim) + l2 * w[k]
            seen[k] += grad * grad
            w[k] -= grad / np.sqrt(seen[k])
        seen0 += error.sum(0) ** 2
        bias -= error.sum(0) / np.sqrt(seen0)
    return w.astype(np.float32), bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sharpness(z: np.ndarray, y: np.ndarray) -> float:
    """The factor on the scores under which held-out rows are likeliest: it calibrates all classes, unknown among them."""
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z * t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class LicenseModel:
    """One calibrated multinomial logistic regression over the families and ``unknown``, and the families' templates."""

    def __init__(self, unknown_lines: list[str], families: list[str] | None = None):
        self.families = list(NAMES) if families is None else families
        lines, family, held = [], [], []

        def learn(name: str, line: str, hold: bool) -> None:
            lines.append(line)
            family.append(self.families.index(name))
            held.append(hold)

        self.templates = {name: [(*_grams(tokens(t)), set()) for t in NAMES[name]] for name in self.families}
        for name in self.families:
            for names, grants in ((NAMES[name], GRANTS), (SHORT[name], SHORT_GRANTS)):
                for i, title in enumerate(names):
                    for j, grant in enumerate(grants):
                        learn(name, grant.format(title), (i + j) % 4 == 3)
                        if grants is SHORT_GRANTS:
                            have = _grams(tokens(grant.format(title)))
                            self.templates[name].append((*have, set.union(*_grams(tokens(title)))))
            for i, body in enumerate(BODIES[name]):
                self.templates[name].append((*_grams(tokens(body)), set(_FAMILY.findall(body.lower()))))
                words = body.split()
                learn(name, body, False)
                for half in (words[: len(words) // 2], words[len(words) // 2 :]):
                    learn(name, " ".join(half), i % 4 == 3)
        other = [*OTHER, *(x for x in unknown_lines if not self.confirmed(x))]
        lines += other
        family += [len(self.families)] * len(other)
        held += [i % 4 == 3 for i in range(len(other))]
        rows, y, held = [_hashed(tokens(x)) for x in lines], np.array(family), np.array(held)
        self.weights, self.bias = fit_softmax([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(self.families) + 1, 1 << BITS)
        z = np.array([self.weights[:, i] @ v + self.bias for (i, v), h in zip(rows, held, strict=True) if h])
        self.scale = sharpness(z, y[held])

    def chances(self, words: list[str]) -> np.ndarray:
        """Calibrated probability of each family and, last, of unknown."""
        index, value = _hashed(words)
        return _softmax((self.weights[:, index] @ value + self.bias) * self.scale)

    def similarity(self, name: str, words: list[str]) -> float:
        """The share of the nearest template's words and neighbouring word pairs that the paragraph has.

        A short name, and the words that tell a body from a like body of another family, must be there as well.
        """
        have, pairs = _grams(words)
        both = have | pairs
        return max((len(t & have) + len(p & pairs)) / (len(t) + len(p)) if own <= both else 0.0 for t, p, own in self.templates[name])

    def confirmed(self, line: str) -> bool:
        """Whether a template of any family confirms the line."""
        words = tokens(line)
        return any(self.similarity(name, words) >= CONFIRM for name in self.templates)

    def judge(self, line: str) -> tuple[str, float, float] | None:
        """``(family, probability, similarity)``; None where unknown or not confirmed.

        The probability is that of a licence of any family; templates tell close families apart.
        """
        words = tokens(line)
        if not words:
            return None
        p = self.chances(words)
        if (known := 1 - float(p[-1])) < CERTAIN:
            return None
        near = {f: self.similarity(f, words) for f in self.families}
        best = max(near.values())
        if best < CONFIRM:
            return None
        family = max((f for f in self.families if near[f] == best), key=lambda f: p[self.families.index(f)])
        return family, known, best


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple | None] = {}
        cue = re.compile(CUE, re.ASCII)

        def judged(paragraph: str) -> tuple | None:
            if paragraph not in known:
                if len(known) > 100_000 or len(paragraph) > 10_000:
                    known.clear()
                known[paragraph] = model.value.judge(paragraph)
            return known[paragraph]

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            hit = pc.match_substring_regex(texts, CUE)
            out = []
            for doc, text in zip(batch.column(0).filter(hit).to_pylist(), texts.filter(hit).to_pylist(), strict=True):
                for block in _BLANK.split(text):
                    if not cue.search(block):
                        continue
                    lines = block.split("\n")
                    own = [judged(line) if cue.search(line) else None for line in lines]
                    for i in range(len(lines) - 1):  # a name that goes on in the next line
                        if own[i] and (x := judged(f"{lines[i]}\n{lines[i + 1]}")) and x[0] not in {o[0] for o in own[i : i + 2] if o}:
                            own[i] = x
                    found = [x for x in own if x]
                    out += ((doc, *x) for x in found)
                    if "\n" in block and (x := judged(block)) and x[0] not in {f[0] for f in found}:
                        out.append((doc, *x))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "family", "probability", "similarity"],
            )

    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> LicenseModel:
    """Fit on the built statements and at most ``sample`` short lines, without a licence cue, of as many documents."""
    some = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")
    some = some.limit(sample).select(F.col("doc_id").alias("__id"))
    texts = docs.join(F.broadcast(some), docs["doc_id"] == F.col("__id"), "left_semi")
    lines = texts.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    lines = lines.where(~F.col("line").rlike(_CUE) & (F.length("line") > 0) & (F.length("line") <= 2000))
    chosen = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(sample)
    return LicenseModel([r["line"] for r in chosen.collect()])


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, family, n_paragraphs, probability, similarity)`` for each licence of each document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_scan(model), "doc_id long, family string, probability double, similarity double")
    return found.groupBy("doc_id", "family").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.round(F.max("probability"), 6).alias("probability"),
        F.round(F.max("similarity"), 6).alias("similarity"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict = {}
