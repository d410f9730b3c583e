"""Licence scans: a paragraph classifier trained here, and templates that confirm what it says.

A paragraph is a run of lines with words, so a notice that is wrapped over lines is read
as one. Its windows are judged: a window is `WINDOW_WORDS` words at most, laid around words
of the vocabulary that stand close together; longer stretches are covered by windows that
overlap by half. So a notice inside a very long line is judged with its surroundings
and not with the whole line. Features of a window are the presence of word 1-, 2- and
3-grams that hold at least one word of content (stop words alone are no feature). A
softmax regression over the families and an ``unknown`` class is fitted on the templates
below, on texts made from them by cutting, dropping and wrapping in other words, and on
unrelated sentences that use the same words; `TRAINING_ROWS` bounds that table. Rows
and weights are sparse: a row is the list of its n-grams. On held-out rows a temperature
is fitted, so that probabilities are calibrated, and the least probability is chosen
that keeps the share of wrong families at or below `MAX_WRONG`; whatever is below counts as
unknown. A family is confirmed if the window and one of its templates share enough
2-grams. Of windows of one family that overlap, the most similar one is reported.

Fitting takes some seconds on the driver and gives the same model every time. The
model (some thousand n-grams) goes to the tasks; each text is searched in its own
row, whole, without a shuffle. A window begins and ends with two different places of words
of content, so nearly all paragraphs are decided by looking up their words.

Defined results: null or empty text has no paragraphs and gives no rows; nulls
elsewhere and repeated rows are carried (one answer per row); extra columns are
not carried; empty table in, empty table out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import number, words_of

# Paragraphs of public licences and usual notices, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS',
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Ce programme est un logiciel libre ; vous pouvez le redistribuer ou le modifier suivant les termes de la GNU General Public License telle que publiée par la Free Software Foundation ; soit la version 3 de la licence, soit (à votre gré) toute version ultérieure.",
        "Dieses Programm ist freie Software. Sie können es unter den Bedingungen der GNU General Public License, wie von der Free Software Foundation veröffentlicht, weitergeben und/oder modifizieren.",
        "Este programa es software libre: usted puede redistribuirlo y/o modificarlo bajo los términos de la Licencia Pública General GNU publicada por la Fundación para el Software Libre.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the LGPL.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the AGPL.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
    ),
    "Zlib": (
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution License.",
    ),
    "Public-Domain": (
        "Dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work is in the public domain.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ),
}

# Identifiers that tags name, by family.
TAGS = {
    "MIT": "MIT", "ISC": "ISC", "Apache-2.0": "Apache-2.0", "GPL": "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later", "LGPL": "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only",
    "AGPL": "AGPL-3.0-only AGPL-3.0-or-later", "BSD": "BSD-2-Clause BSD-3-Clause", "MPL-2.0": "MPL-2.0", "EPL": "EPL-1.0 EPL-2.0", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "CC-BY-NC": "CC-BY-NC-4.0 CC-BY-NC-SA-4.0",
    "CC-BY-SA": "CC-BY-SA-4.0 CC-BY-SA-3.0", "CC-BY": "CC-BY-4.0 CC-BY-3.0", "Public-Domain": "CC0-1.0 Unlicense",
}
_TAG_FORMS = ("SPDX-License-Identifier: {}", "License: {}", "Licence: {}", "license = {}", "Released under the {} licence")

# Sentences that use such words and license nothing.
UNRELATED = (
    "She lost her driving license at the public library and had to apply for a new version.",
    "The general asked for permission to use the software in public.",
    "Dogs must have a license under the new law of the city.",
    "The free concert in the park was open to the public and the crowd was creative.",
    "He released the second version of the program last week.",
    "A fishing license costs twelve dollars and is valid for one year.",
    "The copyright debate in parliament lasted for hours without result.",
    "They distributed the copies of the work among all the students.",
    "The source of the river is in the mountains, subject to heavy snow.",
    "The common source of errors is a file in the wrong form.",
    "The foundation published a report about software and education.",
    "Rights and duties of the members are described in the second part.",
    "The domain of the function is the set of real numbers.",
    "An apache helicopter landed at the base in the morning.",
    "MIT and Harvard are universities in Cambridge.",
    "The Berkeley distribution of samples was reserved for later use.",
    "Attribution of the painting to the master remains uncertain.",
    "The publisher granted an interview without charge.",
    "Modification of the plan requires the written notice of the owner.",
    "All seats are reserved for guests with a ticket.",
    "The terms and conditions of the contest are listed below.",
    "License plates are issued by the state.",
    "He may not use this road except in compliance with the rules.",
    "Version 2.0 brings a new menu and fewer errors.",
)

# Words without content, which make no feature on their own.
_STOP = frozenset(
    b"a an and any are as at be by can for from has have if in is it its may no not of on one or shall should that the this to under use was were will with you your all "
    b"ce un vous le ou les de la que par des dans est et soit telle votre und die der den es sie ist von wie oder este es usted o los el por para del bajo y".split()
)
_WRAPS = ("{}", "{}", "Copyright 2019 the authors. {}", "(c) 2021 Example Inc. {}", "Note: {}", "{} See the file for details.", "# {}", "{} Thanks to all.", "{0} {1}", "{1} {0}")

UNKNOWN = "unknown"
#: Rows of the table that the classifier is fitted and calibrated on, at most.
TRAINING_ROWS = 3000
MAX_WRONG = 0.01
LEAST_SIMILARITY = 0.6
#: Words of a window, and words without a feature that end a stretch of windows.
WINDOW_WORDS = 64
_GAP = 6
_SEED = 7


def grams(words: list[bytes]) -> set[bytes]:
    """1- to 3-grams with at least one word of content."""
    out = {w for w in words if w not in _STOP}
    for n in (2, 3):
        for k in range(len(words) - n + 1):
            part = words[k : k + n]
            if not _STOP.issuperset(part):
                out.add(b" ".join(part))
    return out


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:])) or {(w, b"") for w in words}


def similarity(words: list[bytes], template: list[bytes]) -> float:
    """Shared 2-grams over those of the shorter of the two; a fragment of under three words is like nothing."""
    if words == template:
        return 1.0
    a, b = _pairs(words), _pairs(template)
    least = min(len(a), len(b))
    return len(a & b) / least if least >= 2 else 0.0


def notices() -> list[tuple[str, str]]:
    """(text, family) of all templates and tags."""
    tags = [(form.format(tag), family) for family, names in TAGS.items() for tag in names.split() for form in _TAG_FORMS]
    return [(t, family) for family, texts in TEMPLATES.items() for t in texts] + tags


def training_rows(rows: int = TRAINING_ROWS, seed: int = _SEED) -> list[tuple[str, str]]:
    """(text, family) made from the notices and the unrelated sentences, the same for the same seed."""
    dice = random.Random(seed)
    plain = notices()
    whole = [x for x in plain if x[0] not in (tags := {t for t, _ in plain[sum(map(len, TEMPLATES.values())) :]})]
    out = plain + [(t, UNKNOWN) for t in UNRELATED]
    while len(out) < rows:
        if dice.random() < 0.4:
            words = " ".join(dice.sample(UNRELATED, 2)).split()
            if dice.random() < 0.5:  # the words of a notice in no order
                words += dice.choice(whole)[0].split()
                dice.shuffle(words)
            k = dice.randrange(len(words))
            out.append((" ".join(words[k : k + dice.randint(3, WINDOW_WORDS)]), UNKNOWN))
        else:
            text, family = dice.choice(whole if dice.random() < 0.7 else plain)
            words = text.split()
            if len(words) > 12:
                k = dice.randrange(len(words) - 11)
                words = words[k : k + dice.randint(12, 40)]
            kept = words if text in tags else [w for w in words if dice.random() > 0.04]
            out.append((dice.choice(_WRAPS).format(" ".join(kept), dice.choice(UNRELATED)), family))
    return out[:rows]


class _Rows:
    """Sparse rows of ones: the columns of each row, one row behind the other, and the same sorted by column."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.argsort(self.column, kind="stable")
        self.by_column = self.row[order]
        self.columns, self.starts = np.unique(self.column[order], return_index=True)

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), np.float32)
        if len(self.row):
            rows, starts = np.unique(self.row, return_index=True)
            out[rows] = np.add.reduceat(weights[self.column], starts, axis=0)
        return out

    def transposed_times(self, values: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((width, values.shape[1]), np.float32)
        out[self.columns] = np.add.reduceat(values[self.by_column], self.starts, axis=0)
        return out


class Model:
    """Softmax regression over sparse n-grams, with a temperature and a least probability."""

    def __init__(self, rows: int = TRAINING_ROWS, seed: int = _SEED):
        data = training_rows(rows, seed)
        first = len(notices()) + len(UNRELATED)
        cut = max(first, len(data) * 4 // 5)
        rest = data[first:]
        random.Random(seed).shuffle(rest)
        data = data[:first] + rest  # the plain notices are always fitted on
        self.families = [*TEMPLATES, UNKNOWN]
        seen: dict[bytes, int] = {}
        featured = [grams(words_of(t)) for t, _ in data]
        for g in featured[:cut]:
            for f in sorted(g):
                seen.setdefault(f, len(seen))
        y = np.array([self.families.index(f) for _, f in data])
        fitted, held = (_Rows([sorted(seen[f] for f in g if f in seen) for g in part]) for part in (featured[:cut], featured[cut:]))
        self.weights, self.bias = self._fit(fitted, y[:cut], len(seen))
        self.vocabulary = seen
        self.content = frozenset(w for f in seen for w in f.split() if w not in _STOP)
        logits = held.times(self.weights) + self.bias
        self.temperature = min((0.5 * 1.15**k for k in range(20)), key=lambda t: self._loss(logits / t, y[cut:]))
        p = self._softmax(logits / self.temperature)
        best, top = p.argmax(axis=1), p.max(axis=1)
        self.least = 0.5
        while ((top >= self.least) & (best != y[cut:]) & (best != len(self.families) - 1)).mean() > MAX_WRONG and self.least < 0.99:
            self.least += 0.01
        named = (best != len(self.families) - 1) & (top >= self.least)
        best = np.where(named, best, len(self.families) - 1)
        self.held_out_accuracy = float((best == y[cut:]).mean())
        self.templates = {f: [words_of(t) for t, family in notices() if family == f] for f in TEMPLATES}

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @classmethod
    def _loss(cls, z, y) -> float:
        return float(-np.log(cls._softmax(z)[np.arange(len(y)), y] + 1e-12).mean())

    def _fit(self, x: _Rows, y, width: int, steps: int = 80, rate: float = 1.0, decay: float = 1e-4):
        """Gradient descent with momentum; a few hundred thousand weights at most."""
        w, b = np.zeros((width, len(self.families)), np.float32), np.zeros(len(self.families), np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        target = np.eye(len(self.families), dtype=np.float32)[y]
        for _ in range(steps):
            wrong = (self._softmax(x.times(w) + b) - target) / x.n
            vw = 0.9 * vw - rate * (x.transposed_times(wrong, width) + decay * w)
            vb = 0.9 * vb - rate * wrong.sum(axis=0)
            w, b = w + vw, b + vb
        return w, b

    def classify(self, words: list[bytes]) -> tuple[str, float, float, list[bytes]]:
        """(family, probability, similarity to its closest template, that template); ``unknown`` has similarity 0 and no template."""
        if self.content.isdisjoint(words):
            return UNKNOWN, 1.0, 0.0, []
        at = sorted(self.vocabulary[g] for g in grams(words) if g in self.vocabulary)
        p = self._softmax((self.weights[at].sum(axis=0) + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < self.least:
            return UNKNOWN, float(p[-1]), 0.0, []
        like, template = max(((similarity(words, t), t) for t in self.templates[family]), key=lambda x: x[0])
        return family, float(p[best]), like, template


@lru_cache(maxsize=2)
def model(rows: int = TRAINING_ROWS, seed: int = _SEED) -> Model:
    return Model(rows, seed)


FOUND = "doc_id long, paragraph int, start int, end int, family string, probability double, similarity double, confirmed boolean, text string"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("paragraph", pa.int32()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("family", pa.string()),
        ("probability", pa.float64()),
        ("similarity", pa.float64()),
        ("confirmed", pa.bool_()),
        ("text", pa.string()),
    ]
)


def _windows(fitted: Model, words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of words to judge, as (first, last + 1): from a word of content to another, not far from each other."""
    hot = [i for i, w in enumerate(words) if w in fitted.content]
    k = 0
    while k < len(hot):
        j = k
        while j + 1 < len(hot) and hot[j + 1] - hot[j] <= _GAP:
            j += 1
        low, high = hot[k], hot[j] + 1
        if j == k:  # a word alone is no notice
            k += 1
            continue
        for a in range(low, max(low + 1, high - WINDOW_WORDS // 2), WINDOW_WORDS // 2):
            yield a, min(a + WINDOW_WORDS, high)
        k = j + 1


_BLANK = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def scan_text(fitted: Model, text: str | None) -> list[tuple]:
    """(paragraph, start, end, family, probability, similarity, confirmed, text) of what is not unknown, by paragraph and place."""
    if not text or fitted.content.isdisjoint(words_of(text)):
        return []
    out, low = [], 0
    ends = [(m.start(), m.end()) for m in _BLANK.finditer(text)] + [(len(text), len(text))]
    number = 0
    for high, after in ends:
        words = words_of(part := text[low:high])
        if words and not fitted.content.isdisjoint(words):
            spans, best = [], []
            for a, b in _windows(fitted, words):
                if not spans:
                    spans = [m.span() for m in _WORD.finditer(part)]
                # Stop words before it, on its line, belong to the notice.
                first = a
                while a and words[a - 1] in _STOP and first - a < 3 and "\n" not in part[spans[a - 1][1] : spans[a][0]]:
                    a -= 1
                family, p, like, template = fitted.classify(words[a:b])
                if family == UNKNOWN:
                    continue
                if like >= LEAST_SIMILARITY and words[a:b] != template:  # what the template confirms, and not what stands around it
                    pairs = _pairs(template)
                    shared = [i for i in range(a, b - 1) if (words[i], words[i + 1]) in pairs]
                    a, b = shared[0], shared[-1] + 2
                found = (a, b, family, p, like)
                if best and best[-1][2] == family and best[-1][1] > a:  # windows that overlap are about one notice
                    # Probabilities count as they are given, so that the last bits of a sum decide nothing.
                    best[-1] = max(best[-1], found, key=lambda x: (x[4], round(x[3], 4), -x[0]))
                else:
                    best.append(found)
            for a, b, family, p, like in best:
                start, end = low + spans[a][0], low + spans[b - 1][1]
                out.append((number, start, end, family, round(p, 4), round(like, 4), like >= LEAST_SIMILARITY, text[start:end]))
        number += bool(words)
        low = after
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found += [(key, *x) for x in scan_text(shared.value, text.as_py())]
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x)) for x in found], _ARROW)

    return run


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", fitted: Model | None = None) -> DataFrame:
    """One row per notice in which the classifier sees a licence family, confirmed by a template or not."""
    chosen = docs.select(number(docs, key), F.col(f"`{text}`").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted or model())
    return chosen.mapInArrow(_scan(shared), FOUND).withColumnRenamed("doc_id", key)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
