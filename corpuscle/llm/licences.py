"""Licence scans: a trained paragraph classifier over word n-grams, confirmed against templates.

Paragraphs are lines; adjacent lines that hold a hard-wrapped notice together are also judged as one. Their words give unigrams, bigrams and trigrams, the
features of a sparse multinomial logistic regression with one class for each licence family, one for licences of no known
family, and one for other text. It is trained here, on variants of TEMPLATES, of NAMES in FRAMES and of FOREIGN notices (words dropped,
parts, put between other words, with other names and years), on other text from a bounded sample of the corpus (SAMPLED documents, of each the first
SAMPLED_LINES lines of its first SAMPLED_CHARS characters, of a line LINE_CHARS at most, and of all these about MOST_LINES), and on sentences that
use a licence's words in another sense (HARD). A paragraph of more than LONG words is judged in overlapping parts, so a notice in a long text counts.

The classifier decides alone. N-grams it wasn't trained on count nothing. Probabilities are calibrated by a temperature on templates that a model hasn't seen. A paragraph is licence text if the class of other text has
little enough probability, calibrated on other text kept apart; its family counts if that holds enough of the remaining probability, and is
`unknown` otherwise. This threshold is calibrated on families that a model hasn't seen: for each third of the families one is trained without
them, and the threshold tells the best between variants of families it has and hasn't seen, but rejects REJECTED of the latter at least. Templates only confirm: a predicted
family is confirmed if the paragraph holds enough of the word n-grams of one of the family's templates, or one of its key phrases.

Joined lines: wherever word trigrams of one template stand in more than one line between blank lines, the lines from the first to the last of them
that lie within about a template's length are judged together. If the classifier finds the template's family, and they hold enough of it, more than each alone,
and no two of them do so each, they are found as one, confirmed, at their first line, instead of what was found in those lines for the same
family or unconfirmed; of overlapping ones of several families, the one that holds most of its template.

Defined cases: null and empty texts have no paragraphs; blank lines are none; paragraphs of any length are whole; ties go to the family
first in order; repeated rows are judged alike; an empty table gives no rows and trains on the templates alone; further columns pass through, but for
lic_lines and lic_found, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, attached, bounded_batches, class_table, frugal, mix, pieces, prefix_hash, read, runs, span_hash, utf8, without

SLOT_BITS, GRAMS, VARIANTS, SEED = 20, 3, 200, 7
#: The sample of other text.
SAMPLED, SAMPLED_LINES, SAMPLED_CHARS, LINE_CHARS, MOST_LINES = 1500, 20, 20_000, 400, 2000
#: Words beyond which a paragraph is judged in parts of so many, each half a part after the one before.
LONG, PART = 60, 40
#: The share of notices of unseen families that the threshold has to reject.
REJECTED = 0.85
#: Lines of the sample that share so much with templates may be licence text and aren't trained on as other text.
SUSPECT = 0.3
#: A variant is confirmed if so much of a template's or of its own n-grams is shared.
CONFIRMED_AT = 0.6
OTHER, UNKNOWN = "none", "unknown"
IS_WORD = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_K = np.uint64(0xD6E8FEB86659FD93)

# Short notices as the licences' own texts and common practice give them.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is available under the terms of the Apache 2.0 license.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "You are free to share and adapt the material under the Creative Commons Attribution license, provided you give appropriate credit.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes under the Creative Commons Attribution NonCommercial license.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution ShareAlike License; additional terms may apply.",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the Creative Commons Zero universal dedication.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "This software is distributed under the GPL version 2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This code is available under the MIT license.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
# Two or three words of the templates that name a single family.
KEY_PHRASES = {
    "apache": ["apache license"],
    "bsd": ["bsd license", "bsd style license", "bsd 3 clause", "bsd 2 clause"],
    "cc-by": ["cc by 4", "commons attribution 4", "commons attribution license"],
    "cc-by-nc": ["cc by nc", "commons attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "commons attribution sharealike"],
    "cc0": ["cc0 1 0", "creative commons zero"],
    "gpl": ["gnu general public"],
    "lgpl": ["lesser general public"],
    "mit": ["mit license"],
    "mpl": ["mozilla public license"],
    "proprietary": ["proprietary and confidential"],
}
# Notices of licences that are none of the families, in the words of those licences, to train the class of unknown ones.
FOREIGN = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    "Licensed under the European Union Public Licence, Version 1.2 or later.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "You may use, distribute and modify this code under the terms of the Artistic License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "This software is provided as is, without any express or implied warranty; the authors are not liable for any damages arising from its use.",
    "Licensed under the Do What The Fuck You Want To Public License, Version 2.",
    "The data is made available under the Open Database License.",
    "You are granted a limited, revocable, non-transferable license to use the service under these terms.",
    "This document may be copied and distributed freely as long as this notice is kept.",
    "You can copy and modify this freely for any purpose.",
    "Use of this package is subject to the terms of the accompanying license agreement.",
]
# Names of licences by family, and frames they stand in.
NAMES = {
    "apache": ["Apache License", "Apache 2.0 license", "Apache-2.0", "Apache License Version 2.0", "Apache 2 licence"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause", "BSD style license", "new BSD licence"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution License", "Creative Commons Attribution 3.0", "CC-BY license"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial License", "CC-BY-NC", "CC BY-NC 3.0 license"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License", "CC-BY-SA", "CC BY-SA 3.0 license"],
    "cc0": ["CC0 1.0", "CC0", "Creative Commons Zero", "CC0 public domain dedication"],
    "gpl": ["GNU General Public License", "GPL", "GPLv3", "GPLv2 license", "GNU GPL version 3", "GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License", "LGPL", "LGPLv3", "LGPL 2.1 license", "GNU LGPL"],
    "mit": ["MIT License", "MIT license", "MIT", "MIT licence terms"],
    "mpl": ["Mozilla Public License", "MPL 2.0", "MPL", "Mozilla Public License 2.0"],
    "proprietary": ["proprietary license of the company", "confidential commercial license"],
}
FOREIGN_NAMES = ["ISC License", "zlib license", "Boost Software License", "Eclipse Public License", "European Union Public Licence", "Open Font License", "Artistic License", "WTFPL", "Common Development and Distribution License", "PostgreSQL License", "Python Software Foundation License", "Open Database License", "Ruby license", "PHP License", "Microsoft Public License", "Unlicense", "terms of the license agreement"]
FRAMES = ["{}", "{}", "Licensed under the {}.", "Released under the {}.", "This project is {} licensed", "Distributed under the {} or later", "see the {}", "This code is available under the {}.", "This project is available under the terms of the {}.", "License: {}", "The source is published under {}; see the file LICENSE", "under the {}", "Licensed under the {}, Version 2.0.", "subject to the terms of the {}, v. 1.1", "This work is licensed under the {}, version 3."]
# Sentences that use the words of licences in another sense.
HARD = [
    "You need a driving license to operate this vehicle.",
    "He asked his parents for permission to go to the party.",
    "The restaurant lost its liquor licence after a long dispute with the city.",
    "She renewed her fishing license at the office near the lake.",
    "The doctor has been licensed to practice since the war ended.",
    "The warranty on the new washing machine lasts for two years.",
    "The court heard a case about copyright and old paintings.",
    "They spoke about the redistribution of land and wealth in the country.",
    "The public was free to enter the general assembly of the town.",
    "Permission was granted to build a second house on the property.",
    "The source of the river lies in the northern mountains of the region.",
    "He works under difficult conditions and without any notice.",
    "All rights of children are part of the agreement between the countries.",
    "The terms of the contract were either too long or too hard to understand.",
    "A commercial version of the film was released in the summer.",
    "The software industry is an important part of the national economy.",
    "She received a copy of the book and a letter from the author.",
    "They modify the plan every year and share it with their neighbors.",
    "The patent office is open to the public on most days of the week.",
    "This file of letters was found in a box under the stairs.",
    "The foundation published a report on free schools and public health.",
    "You may obtain more information at the office of the university.",
]


def features(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of the word n-grams of every row, for n from 1 to GRAMS, each in order of rows."""
    low = LOWER[buf]
    start, end = runs(IS_WORD[low], off)
    h = span_hash(prefix_hash(low), start, end)
    row = np.searchsorted(off, start, "right") - 1
    out, x = [(row, h)], h
    for n in range(2, GRAMS + 1):
        x = mix(x[:-1] * _K + h[n - 1 :]) if len(x) > 1 else x[:0]
        inside = row[: len(x)] == row[n - 1 :][: len(x)]
        out.append((row[: len(x)][inside], (x * np.uint64(2) + np.uint64(1))[inside]))
    return out


def _flat(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams in order of rows."""
    row, h = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def _columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), off


def paragraphs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line that has a word."""
    edge = np.unique(np.concatenate([off, np.flatnonzero(buf == 10), np.flatnonzero(buf == 10) + 1]))
    start, end = edge[:-1], edge[1:]
    return (start, end) if len(start) else (edge[:0], edge[:0])


def fit(row: np.ndarray, column: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of a multinomial logistic regression (full-batch AdaGrad), one line for each column, the last one for the bias; rows of weight 0 take no part."""
    size = np.maximum(np.bincount(row, minlength=len(y)), 1)
    used = weight[row] > 0
    r, c = row[used], column[used]
    v = (1 / np.sqrt(size[r])).astype(np.float32)[:, None]
    out = np.zeros((column.max() + 2, classes), np.float32)
    names, c = np.unique(c, return_inverse=True)
    by_column = np.argsort(c, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(c[by_column]) != 0))
    r_by, v_by = r[by_column], v[by_column]
    have, begin = np.unique(r, return_index=True)
    target, share = np.eye(classes, dtype=np.float32)[y[have]], (weight[have] / weight.sum()).astype(np.float32)[:, None]
    w, square = np.zeros((len(names), classes), np.float32), np.full((len(names), classes), 1e-6, np.float32)
    bias, of_bias = np.zeros(classes, np.float32), np.full(classes, 1e-6, np.float32)
    g = np.zeros((len(y), classes), np.float32)
    for _ in range(rounds):
        g[have] = (_softmax(np.add.reduceat(w[c] * v, begin, axis=0) + bias) - target) * share
        step = np.add.reduceat(g[r_by] * v_by, cut, axis=0) + 1e-6 * w
        square += step**2
        w -= 0.5 * step / np.sqrt(square)
        step = g.sum(0)
        of_bias += step**2
        bias -= 0.1 * step / np.sqrt(of_bias)
    out[names], out[-1] = w, bias
    return out


class Model:
    """Weights, temperature, thresholds and the templates' n-grams. Classes: the families in order, unknown licences, other text."""

    def __init__(self, other: list[str], seed: int = SEED, without: tuple = ()):
        rng = np.random.default_rng(seed)
        templates = {k: t for k, t in TEMPLATES.items() if k not in without}
        self.families = sorted(templates)
        self.unknown, self.none = len(self.families), len(self.families) + 1
        classes = self.none + 1
        self._of_templates(templates)
        other = [t for t, s in zip(other, self._suspicion(other)) if s < SUSPECT]
        filler = [w for t in other[:200] for w in t.split()][:4000] or ["text"]
        texts, labels, source = [], [], []  # source: which template of its family
        for k, name in enumerate([*self.families, None]):
            whole, names = (templates[name], NAMES[name]) if name else (FOREIGN, FOREIGN_NAMES)
            for i in range(VARIANTS):
                of = names if i % 2 else whole
                j = int(rng.integers(len(of)))
                texts.append(self._variant(FRAMES[int(rng.integers(len(FRAMES)))].format(names[j]) if i % 2 else whole[j], filler, rng))
                source.append(j)
                labels.append(k)
        hard = [self._variant(HARD[i % len(HARD)], filler, rng) for i in range(2 * VARIANTS)]
        senses = [w for t in HARD for w in t.split()]
        mixed = [" ".join(senses[int(rng.integers(len(senses)))] if rng.random() < 0.3 else filler[int(rng.integers(len(filler)))] for _ in range(int(rng.integers(3, PART)))) for _ in range(2 * VARIANTS)]
        texts += hard + mixed + other
        labels += [self.none] * (len(texts) - len(labels))
        y = np.array(labels)
        source = np.append(source, rng.integers(0, 3, len(y) - len(source))).astype(int)
        row, h = _flat(features(*_columns(texts)))
        known, column = np.unique(h, return_inverse=True)
        column = column.ravel()
        even = np.where(y == self.none, 3.0, 1.0) / np.bincount(y, minlength=classes)[y]
        have, begin = np.unique(row, return_index=True)
        root = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1)))[row].astype(np.float32)[:, None]

        def scored(w: np.ndarray) -> np.ndarray:
            z = np.zeros((len(y), classes), np.float32)
            z[have] = np.add.reduceat(w[column] * root, begin, axis=0)
            return z + w[-1]

        w = fit(row, column, y, classes, even, 60)
        self.weights, self.bias = np.vstack([w[:-1], np.zeros((1, classes), np.float32)]), w[-1]
        # a slot of the table of features holds one of them; the others that fall on it are left out
        self.feature = np.full(1 << SLOT_BITS, len(known), np.int32)
        self.feature[(known >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = np.arange(len(known))
        self.print = np.append((known & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.uint32(0))
        # wordings a model hasn't seen: the temperature, and how much other text looks like a licence
        z = np.zeros((len(y), classes), np.float32)
        for third in range(3):
            away = source % 3 == third
            z[away] = scored(fit(row, column, y, classes, np.where(away, 0.0, even), 30))[away]
        at = np.arange(len(y))
        losses = [((-np.log(_softmax(z / t)[at, y] + 1e-9) * even).sum(), t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)]
        self.temperature = min(losses)[1]
        self.licence_at = float(np.clip(np.quantile(1 - _softmax(z / self.temperature)[y == self.none, self.none], 0.998), 0.5, 0.95))
        # families a model hasn't seen
        seen, unseen = [], []
        for third in range(3):
            away = (y < self.unknown) & (y % 3 == third)
            apart = source % 3 == third
            w = fit(row, column, y, classes, np.where(apart | away, 0.0, even), 30)
            q = self._of_families(_softmax(scored(w) / self.temperature))
            q = np.where(np.arange(self.unknown) % 3 == third, 0, q[:, : self.unknown])
            right = q.argmax(1) == y
            seen.append(np.where(right, q.max(1), 0)[apart & (y < self.unknown) & ~away])
            unseen.append(q.max(1)[away | (y == self.unknown) & apart])
        seen, unseen = np.concatenate(seen), np.concatenate(unseen)
        steps = np.linspace(0.3, 0.98, 69)
        self.family_at = float(max(steps[np.argmax([(seen >= t).mean() + (unseen < t).mean() for t in steps])], np.quantile(unseen, REJECTED)))

    def _weights_of(self, h: np.ndarray) -> np.ndarray:
        at = self.feature[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        at[self.print[at] != (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)] = len(self.weights) - 1
        return self.weights[at]

    def _of_families(self, p: np.ndarray) -> np.ndarray:
        """Of the probability that other text leaves, the share of each licence class."""
        return p[:, : self.none] / np.maximum(1 - p[:, self.none :], 1e-9)

    def _of_templates(self, templates: dict[str, list[str]]) -> None:
        self.templates = []
        for k, name in enumerate(self.families):
            for t in templates[name]:
                self.templates.append((k, np.unique(_flat(features(*_columns([t])))[1])))
        self.phrases = {}
        for k, name in enumerate(self.families):
            for t in KEY_PHRASES.get(name, []):
                n = len(t.split())
                self.phrases.setdefault(n, []).append((int(features(*_columns([t]))[n - 1][1][0]), k))
        self.phrases = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([k for _, k in sorted(x)])) for n, x in self.phrases.items()}
        self.phrase_lead = {n: _lead(h) for n, (h, _) in self.phrases.items()}
        # trigrams of each template, for lines that hold a template together, and its number of words
        own = [features(*_columns([t])) for name in self.families for t in templates[name]]
        self.lengths = np.array([len(x[0][1]) for x in own])
        pairs = np.unique(np.array([(int(h), i) for i, x in enumerate(own) for h in x[2][1]], np.uint64), axis=0)
        self.trigrams, self.trigram_of = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        self.trigram_lead = _lead(self.trigrams)

    def _suspicion(self, texts: list[str]) -> np.ndarray:
        """The share of each text's trigrams that stand in a template."""
        if not texts:
            return np.zeros(0)
        row, h = features(*_columns(texts))[2]
        held = np.bincount(row[np.isin(h, self.trigrams)], minlength=len(texts))
        return held / np.maximum(np.bincount(row, minlength=len(texts)), 1)

    @staticmethod
    def _variant(text: str, filler: list[str], rng) -> str:
        words = text.split()
        kept = [w for w in words if rng.random() > 0.06] or words
        if len(kept) > 12 and rng.random() < 0.4:  # a part, as one line of a wrapped notice
            size = int(rng.integers(9, len(kept)))
            first = int(rng.integers(0, len(kept) - size + 1))
            kept = kept[first : first + size]
        around = [[filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(0, 8)) if rng.random() < 0.4 else 0)] for _ in range(2)]
        if rng.random() < 0.2:
            around[0] += ["Copyright", "(c)", str(int(rng.integers(1995, 2026)))]
        return " ".join(around[0] + kept + around[1])

    def _phrased(self, parts) -> dict[int, set]:
        """Families whose key phrase stands in a row, by row."""
        out: dict[int, set] = {}
        for n, (hashes, families) in self.phrases.items():
            row, h = parts[n - 1]
            maybe = np.flatnonzero(self.phrase_lead[n][(h >> np.uint64(48)).astype(np.int64)])
            found, i = _at(hashes, h[maybe])
            for r, k in zip(row[maybe[found]].tolist(), families[i[found]].tolist()):
                out.setdefault(r, set()).add(k)
        return out

    def joined(self, buf: np.ndarray, begin: np.ndarray, has: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first row, last row, family, probability) of adjacent rows that together are confirmed. begin: offsets of lines and line breaks; has: rows
        with words; doc: whose row it is."""
        # blocks: lines with words of one document, and the single break between two of them
        n = len(has)
        line = buf[begin[:-1]] != 10
        glue = np.zeros(n, bool)
        glue[1:-1] = ~line[1:-1] & has[:-2] & has[2:] & (doc[:-2] == doc[2:])
        inside = has | glue
        goes_on = inside[1:] & inside[:-1] & (doc[1:] == doc[:-1])
        first, last = np.flatnonzero(inside & ~np.append(False, goes_on)), np.flatnonzero(inside & ~np.append(goes_on, False))
        several = last > first
        first, last = first[several], last[several]
        if not len(first):
            return []
        cuts = np.unique(np.concatenate([[0], begin[first], begin[last + 1], [len(buf)]]))
        wanted = np.isin(cuts[:-1], begin[first])
        low = LOWER[buf]
        start, end = runs(IS_WORD[low], cuts)
        h = span_hash(prefix_hash(low), start, end)
        if len(h) < 3:
            return []
        x = mix(h[:-1] * _K + h[1:])
        x = mix(x[:-1] * _K + h[2:]) * np.uint64(2) + np.uint64(1)
        maybe = np.flatnonzero(self.trigram_lead[(x >> np.uint64(48)).astype(np.int64)])
        maybe = maybe[_at(self.trigrams, x[maybe])[0]]
        block = np.searchsorted(cuts, start, "right") - 1
        maybe = maybe[(block[maybe] == block[maybe + 2]) & wanted[block[maybe]]]
        if not len(maybe):
            return []
        left, right = np.searchsorted(self.trigrams, x[maybe]), np.searchsorted(self.trigrams, x[maybe], "right")
        row = np.searchsorted(begin, start, "right") - 1
        hits: dict[tuple[int, int], list[int]] = {}
        for w, i, j in zip(maybe.tolist(), left.tolist(), right.tolist()):
            for t in self.trigram_of[i:j].tolist():
                hits.setdefault((int(block[w]), t), []).append(w)
        windows = set()
        for (_, t), at in hits.items():
            span, j, ended = int(self.lengths[t] * 1.5) + 10, 0, -1
            for i, w in enumerate(at):
                j = max(j, i)
                while j + 1 < len(at) and at[j + 1] + 3 - w <= span:
                    j += 1
                a, b = int(row[w]), int(row[at[j] + 2])
                # of windows with the same end the longest is enough
                if b > a and b > ended:
                    windows.add((a, b, t))
                    ended = b
        if not windows:
            return []
        order = sorted(windows, key=lambda w: (w[0], -w[1], w[2]))
        spans = sorted({(a, b) for a, b, _ in order} | {(r, r) for a, b, _ in order for r in range(a, b + 1) if has[r]})
        number = {x: i for i, x in enumerate(spans)}
        off = np.concatenate([[0], np.cumsum([begin[b + 1] - begin[a] for a, b in spans])])
        parts = features(np.concatenate([buf[begin[a] : begin[b + 1]] for a, b in spans]), off)
        p = self._probabilities(parts, len(spans))
        q = self._of_families(p)
        says = np.where((1 - p[:, self.none] >= self.licence_at) & (q[:, : self.unknown].max(1) >= self.family_at), q[:, : self.unknown].argmax(1), self.none)
        at, h = _flat(parts)
        bound = np.searchsorted(at, np.arange(len(spans) + 1))
        grams = [np.unique(h[i:j]) for i, j in zip(bound[:-1], bound[1:])]
        held: list = []
        for a, b, t in order:
            k, wanted_grams = self.templates[t]
            share, alone = _share(grams[number[a, b]], wanted_grams), [_share(grams[number[r, r]], wanted_grams) for r in range(a, b + 1) if has[r]]
            if says[number[a, b]] != k or share < CONFIRMED_AT or share <= max(alone) or sum(x >= CONFIRMED_AT for x in alone) > 1:
                continue
            held.append((-share, a, b, k, float(p[number[a, b], k])))
        # of overlapping windows of several families the one that holds most of its template counts
        out: list = []
        taken: dict[int, int] = {}
        for _, a, b, k, chance in sorted(held):
            if all(taken.get(r, k) == k for r in range(a, b + 1)):
                taken.update(dict.fromkeys(range(a, b + 1), k))
                out.append((a, b, k, chance))
        one: list = []
        for a, b, k, chance in sorted(out):
            if one and a <= one[-1][1]:  # one notice that goes on
                one[-1] = (one[-1][0], max(b, one[-1][1]), k, max(one[-1][3], chance))
            else:
                one.append((a, b, k, chance))
        return one

    def _probabilities(self, parts, n: int) -> np.ndarray:
        """Of each row: the probability of each class; of a long row, of the part that is the least like other text."""
        row, _ = parts[0]
        words = len(row)
        first = np.searchsorted(row, np.arange(n + 1))
        count = np.diff(first)
        half = PART // 2
        # blocks of half a part; a long row's parts are two of them, the last one may be longer
        long = count > LONG
        blocks = np.where(long, count // half, (count > 0).astype(np.int64))
        begin_block = np.concatenate([[0], np.cumsum(blocks)])
        of_block = np.repeat(np.arange(n), blocks)
        start = first[:-1][of_block] + (np.arange(len(of_block)) - begin_block[:-1][of_block]) * half
        z, size = np.zeros((len(of_block), self.none + 1), np.float32), np.zeros(len(of_block))
        if words:
            for k, (at, h) in enumerate(parts):
                where = _places(first, count, k)
                if not len(where):
                    continue
                block = np.searchsorted(start, where, "right") - 1
                cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                z[block[cut]] += np.add.reduceat(self._weights_of(h), cut, axis=0)
                size[block[cut]] += np.diff(np.append(cut, len(block)))
        paired = long[of_block]
        if paired.any():
            follows = np.flatnonzero(paired[:-1] & (of_block[1:] == of_block[:-1]))
            last = np.flatnonzero(paired & (np.append(of_block[1:], -1) != of_block))
            z[follows] += z[follows + 1]
            size[follows] += size[follows + 1]
            keep = np.ones(len(of_block), bool)
            keep[last] = False  # the last block stands in the part before
            z, size, of_block = z[keep], size[keep], of_block[keep]
        p = _softmax((z / np.sqrt(np.maximum(size, 1))[:, None] + self.bias) / self.temperature)
        out = np.zeros((n, self.none + 1), np.float32)
        out[:, self.none] = 1
        if len(of_block):
            order = np.lexsort((p[:, self.none], of_block))
            cut = np.flatnonzero(np.append(True, np.diff(of_block[order]) != 0))
            out[of_block[order[cut]]] = p[order[cut]]
        return out

    def judge(self, buf: np.ndarray, off: np.ndarray):
        """Of each row: class, probability, and whether a template confirms it."""
        n = len(off) - 1
        parts = features(buf, off)
        p = self._probabilities(parts, n)
        licence = 1 - p[:, self.none]
        q = self._of_families(p)
        family = np.where(licence < self.licence_at, self.none, np.where(q[:, : self.unknown].max(1, initial=0) < self.family_at, self.unknown, q[:, : self.unknown].argmax(1)))
        chance = np.where(family == self.none, 0.0, np.where(family == self.unknown, licence, p[np.arange(n), family]))
        confirmed = np.zeros(n, bool)
        looked = np.flatnonzero(family < self.unknown)
        if len(looked):
            phrased = self._phrased(parts)
            row, h = _flat(parts)
            for i in looked.tolist():
                mine = np.unique(h[np.searchsorted(row, i) : np.searchsorted(row, i, "right")])
                confirmed[i] = family[i] in phrased.get(i, ()) or any(k == family[i] and _share(mine, t) >= CONFIRMED_AT for k, t in self.templates)
        return family, chance, confirmed


def _places(first: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """The words at which n-grams of k + 1 words begin."""
    own = np.maximum(count - k, 0)
    begin = np.cumsum(own) - own
    return np.repeat(first[:-1] - begin, own) + np.arange(own.sum())


def _share(grams: np.ndarray, template: np.ndarray) -> float:
    return len(np.intersect1d(grams, template, assume_unique=True)) / len(template)


def _lead(hashes: np.ndarray) -> np.ndarray:
    """Which leading 16 bits occur."""
    out = np.zeros(1 << 16, bool)
    out[(hashes >> np.uint64(48)).astype(np.int64)] = True
    return out


def _at(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which x are among sorted keys, and where."""
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[i] == x, i


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, sampled: int = SAMPLED) -> Model:
    """A model whose other text comes from a bounded sample: at most `sampled` documents, those of least hash."""
    order = F.xxhash64(F.lit("licences"), "doc_id")
    every = max(1, docs.count() // (2 * sampled))  # so that tasks send few rows, however many tasks there are
    some = docs.where((F.pmod(order, F.lit(every)) == 0) & F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, SAMPLED_CHARS).alias("text")).orderBy(order, "doc_id", "text").limit(sampled)
    lines = some.select(F.explode(F.slice(F.split("text", "\n"), 1, SAMPLED_LINES)).alias("line")).collect()
    other = sorted(r.line[:LINE_CHARS] for r in lines if r.line.strip())
    return Model(other[:: max(1, -(-len(other) // MOST_LINES))])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lic_lines (paragraphs), lic_found array<struct<line, family, chance, confirmed>> for paragraphs that are licence text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, "lic_lines", "lic_found")
    shared = spark.sparkContext.broadcast(model)
    item = T.StructType([T.StructField("line", T.LongType()), T.StructField("family", T.StringType()), T.StructField("chance", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])
    kind = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("chance", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        m = shared.value
        names, none = [*m.families, UNKNOWN, OTHER], m.none
        for b in batches:
            buf, off = utf8(b.column("text"))
            n = len(off) - 1
            count, found = np.zeros(n, np.int64), [[] for _ in range(n)]
            for i, j in pieces(off):
                own = off[i : j + 1] - off[i]
                part = buf[off[i] : off[j]]
                start, end = paragraphs(part, own)
                if not len(start):
                    continue
                begin = np.append(start, end[-1])
                row = np.searchsorted(own, start, "right") - 1
                # a line break is a row without words
                line = np.zeros(len(start), np.int64)
                breaks = np.cumsum(part[start] == 10)
                first = np.searchsorted(start, own[:-1])
                before = np.where(first > 0, breaks[np.maximum(first, 1) - 1], 0)
                line = breaks - before[row]
                has = np.zeros(len(start), bool)
                words, _ = runs(IS_WORD[LOWER[part]], begin)
                has[np.searchsorted(begin, words, "right") - 1] = True
                count[i:j] += np.bincount(row[has], minlength=j - i)
                family, chance, confirmed = m.judge(part, begin)
                for a, z, k, p in m.joined(part, begin, has, row):
                    same = np.flatnonzero((family[a : z + 1] == k) | (family[a : z + 1] != none) & ~confirmed[a : z + 1]) + a
                    family[same], confirmed[same] = none, False
                    free = next((r for r in range(a, z + 1) if has[r] and family[r] == none), None)
                    if free is not None:
                        family[free], chance[free], confirmed[free] = k, p, True
                for k in np.flatnonzero(family != none).tolist():
                    found[i + row[k]].append({"line": int(line[k]), "family": names[family[k]], "chance": float(chance[k]), "confirmed": bool(confirmed[k])})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count), pa.array(found, kind)], names=[*b.schema.names, "lic_lines", "lic_found"])

    return docs.mapInArrow(frugal(run), attached(docs, [("lic_lines", T.LongType()), ("lic_found", T.ArrayType(item))]))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train(docs))
    families, sure = (F.array_sort(F.array_distinct(F.transform(x, lambda y: y["family"]))) for x in (F.col("lic_found"), F.filter("lic_found", lambda y: y["confirmed"])))
    return out.select(
        "doc_id",
        F.col("lic_lines").alias("n_paragraphs"),
        F.size("lic_found").cast("long").alias("n_licence"),
        F.size(F.filter("lic_found", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"),
        F.array_join(families, ",").alias("families"),
        F.array_join(sure, ",").alias("confirmed_families"),
        F.round(F.array_max(F.transform("lic_found", lambda x: x["chance"])), 6).alias("chance"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op1_licences": op1_licences}
