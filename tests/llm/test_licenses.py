import math
import re

import pytest

from papyrion.llm import licenses as L


@pytest.fixture(scope="module")
def fitted():
    return L.model()


# Written apart from the templates: notices as they stand in files and pages, and sentences that license nothing.
APART = [
    ("GPL", "foo is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2, or (at your option)\nany later version."),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL", "This package is licensed under the GNU General Public License v3 or later."), ("MIT", "License: MIT"),
    ("MIT", "The code in this repository is available under the MIT license, see LICENSE."), ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    ("Apache-2.0", "Copyright 2020 Someone. Licensed under the Apache License, Version 2.0"), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer."), ("BSD", "* Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"), ("EPL", "This program and the accompanying materials are made available under\nthe terms of the Eclipse Public License 2.0"),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"), ("AGPL", "Distributed under the terms of the GNU Affero General Public License version 3"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file"), ("CC-BY-SA", "Content is available under Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC", "Photo: CC BY-NC 4.0"), ("Public-Domain", "To the extent possible this work is dedicated to the public domain under CC0 1.0"), ("Proprietary", "Copyright 1999 Foo. All rights reserved."),
    ("Zlib", "Altered source versions must be plainly marked as such, and must not be\nmisrepresented as being the original software."), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)"),
    (None, "The city renewed the license of the restaurant last week."), (None, "Version 3 of the report was published in May."), (None, "My notes on the terms of the contract and the source of the dispute."),
    (None, "Public transport is free of charge for children."), (None, "She is a general practitioner with a foundation degree."), (None, "He gave written permission to enter the building."), (None, "Software engineers modify and merge code all day."),
    (None, "The warranty of the car covers damages to the engine."), (None, "Boost your creative work with these common tricks."), (None, "An eclipse of the sun is visible in the whole country."),
]


def test_texts_written_apart_from_the_generator(fitted):
    got = [[x[3] for x in L.scan_text(fitted, t)] for _, t in APART]
    wrong = [(f, g, t) for (f, t), g in zip(APART, got) if set(g) != ({f} if f else set())]
    assert len(wrong) <= 2, wrong
    named = [(f, x) for f, t in APART for x in L.scan_text(fitted, t)]
    assert sum(x[3] == f for f, x in named) / len(named) >= 0.9
    assert sum(x[6] for f, x in named if x[3] == f) >= 0.8 * len(named)
    # Calibrated: those that are sure are right more often than one that is not.
    assert all(x[3] == f for f, x in named if x[4] > 0.95)


def test_held_out_rows(fitted):
    assert fitted.held_out_accuracy > 0.94
    fresh = L.training_rows(1500, seed=99)[len(L.notices()) + len(L.UNRELATED) :]
    right = sum(fitted.classify(L.words_of(t))[0] == f for t, f in fresh)
    assert len(fresh) > 500 and right / len(fresh) > 0.93


def test_templates_and_unrelated_sentences(fitted):
    for family, texts in L.TEMPLATES.items():
        found = [x for t in texts for x in L.scan_text(fitted, t)]
        assert all(x[3] == family for x in found if x[6]), family
        assert sum(x[6] for x in found) >= 0.6 * len(texts), family
    for t in L.UNRELATED:
        assert not L.scan_text(fitted, t)


def test_scores_against_a_plain_sum_over_the_weights(spark, fitted):
    """Windows of the texts that the query names, scored anew from the weights by name, without the sparse rows."""
    weights = {g: fitted.weights[i].tolist() for g, i in fitted.vocabulary.items()}
    checked = 0
    for r in L.op5_license_scan(spark, "/root/testdata/sf0.001").collect():
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        found = set()
        for n in (1, 2, 3):
            for k in range(len(words) - n + 1):
                if any(w.encode() not in L._STOP for w in words[k : k + n]):
                    found.add(" ".join(words[k : k + n]).encode())
        z = [b + sum(weights[g][f] for g in found if g in weights) for f, b in enumerate(fitted.bias.tolist())]
        e = [math.exp((x - max(z)) / fitted.temperature) for x in z]
        best = max(range(len(e)), key=e.__getitem__)
        family, p, *_ = fitted.classify(L.words_of(r.text))
        assert (fitted.families[best] if e[best] / sum(e) >= fitted.least else L.UNKNOWN) == family
        assert family == L.UNKNOWN or abs(e[best] / sum(e) - p) < 1e-4
        checked += family == r.family
    assert checked > 3


def test_wrapped_buried_and_several_notices(fitted):
    wrapped = "Thuu eran ofa.\nReleased under the\nMIT License.\nOra fuit."
    assert [(x[3], x[7]) for x in L.scan_text(fitted, wrapped)] == [("MIT", "Released under the\nMIT License")]
    buried = "bla " * 20_000 + "Licensed under the Apache License, Version 2.0. " + "bla " * 20_000
    assert [(x[1], x[3]) for x in L.scan_text(fitted, buried)] == [(80_000, "Apache-2.0")]
    both = "All rights reserved.\n\nqqq zzz\n\nDistributed under the LGPL."
    assert [(x[0], x[3]) for x in L.scan_text(fitted, both)] == [(0, "Proprietary"), (2, "LGPL")]


def test_skipping_without_content_changes_nothing(fitted):
    words = [b"of", b"qqq", b"the", b"zzz"]
    assert fitted.content.isdisjoint(words) and not any(g in fitted.vocabulary for g in L.grams(words))


def test_query_finds_every_notice(spark, fitted):
    sf = "/root/testdata/sf0.001"
    notices = {t: f for f, texts in L.TEMPLATES.items() for t in texts}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        start = 0
        for line in r.text.split("\n"):
            if line in notices:
                want.add((r.doc_id, start, notices[line]))
            start += len(line) + 1
    got = {(r.doc_id, r.start, r.family) for r in L.op5_license_scan(spark, sf).collect() if r.confirmed}
    assert want and got == want


def test_odd_rows(spark):
    rows = [(1, "a\n\nReleased under the MIT License.\nb", 0), (1, "Released under the MIT License.", 0), (None, None, 0), (2, "", 0), (3, "x " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family int")
    got = [(r.doc_id, r.paragraph, r.start) for r in L.scan_licenses(docs).collect()]
    assert sorted(got) == [(1, 0, 0), (1, 1, 3)]
    assert L.scan_licenses(docs.limit(0)).count() == 0


class Plain:
    """The whole scan once more, from the weights by name and plain loops over every word: no sparse rows, no look-up of words first."""

    def __init__(self, fitted):
        self.fitted = fitted
        self.weights = {g.decode(): fitted.weights[i].tolist() for g, i in fitted.vocabulary.items()}
        self.stop = {w.decode() for w in L._STOP}
        # Words of content that some n-gram of the model holds.
        self.content = {w for g in self.weights for w in g.split() if w not in self.stop}
        self.templates = {f: [self.words(t)[0] for t, family in L.notices() if family == f] for f in L.TEMPLATES}

    @staticmethod
    def words(text):
        found = [(m[0], *m.span()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w, _, _ in found], [(a, b) for _, a, b in found]

    def family(self, words):
        """(family or None, probability) by adding up the weights of every n-gram there is."""
        found = {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1) if any(w not in self.stop for w in words[k : k + n])}
        z = [b + sum(self.weights[g][f] for g in found if g in self.weights) for f, b in enumerate(self.fitted.bias.tolist())]
        e = [math.exp((x - max(z)) / self.fitted.temperature) for x in z]
        best = max(range(len(e)), key=e.__getitem__)
        name, p = self.fitted.families[best], e[best] / sum(e)
        return (name, p) if name != L.UNKNOWN and p >= self.fitted.least else (None, p)

    @staticmethod
    def like(words, template):
        if words == template:
            return 1.0
        a, b = ({(x, y) for x, y in zip(w, w[1:])} or {(x, "") for x in w} for w in (words, template))
        return len([p for p in a if p in b]) / min(len(a), len(b)) if min(len(a), len(b)) >= 2 else 0.0

    def paragraphs(self, text):
        """(start, text) of runs of lines that are not blank."""
        at, start, held = 0, 0, []
        for line in text.split("\n") + [""]:
            if line.strip(" \t\r"):
                start = start if held else at
                held.append(line)
            elif held:
                yield start, "\n".join(held)
                held = []
            at += len(line) + 1

    def scan(self, text):
        out, number = [], 0
        for low, part in self.paragraphs(text or ""):
            words, spans = self.words(part)
            if not words:
                continue
            groups = []  # places of words of content, no more than the gap apart
            for i, w in enumerate(words):
                if w in self.content:
                    if groups and i - groups[-1][-1] <= L._GAP:
                        groups[-1].append(i)
                    else:
                        groups.append([i])
            best = []
            for group in groups:
                if len(group) < 2:
                    continue
                a, end = group[0], group[-1] + 1
                starts = [a]
                while starts[-1] + L.WINDOW_WORDS // 2 < end - L.WINDOW_WORDS // 2:
                    starts.append(starts[-1] + L.WINDOW_WORDS // 2)
                for a in starts:
                    b = min(a + L.WINDOW_WORDS, end)
                    for _ in range(3):
                        if a and words[a - 1] in self.stop and "\n" not in part[spans[a - 1][1] : spans[a][0]]:
                            a -= 1
                        else:
                            break
                    name, p = self.family(words[a:b])
                    if not name:
                        continue
                    likes = [self.like(words[a:b], t) for t in self.templates[name]]
                    ties = [t for x, t in zip(likes, self.templates[name]) if x == max(likes)]
                    template = ties[0]
                    if max(likes) >= L.LEAST_SIMILARITY and words[a:b] != template:
                        pairs = set(zip(template, template[1:]))
                        shared = [i for i in range(a, b - 1) if (words[i], words[i + 1]) in pairs]
                        a, b = shared[0], shared[-1] + 2
                    found = (a, b, name, p, max(likes))
                    if best and best[-1][2] == name and best[-1][1] > a:
                        best[-1] = max(best[-1], found, key=lambda x: (x[4], round(x[3], 4), -x[0]))
                    else:
                        best.append(found)
            for a, b, name, p, x in best:
                start, stop = low + spans[a][0], low + spans[b - 1][1]
                out.append((number, start, stop, name, p, x, x >= L.LEAST_SIMILARITY, text[start:stop]))
            number += 1
        return out


def test_the_whole_query_against_a_plain_scan(spark, fitted):
    plain, sf = Plain(fitted), "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(key, *x) for key, text in docs for x in plain.scan(text)]
    got = [tuple(r) for r in L.op5_license_scan(spark, sf).collect()]
    exact = lambda rows: sorted((*r[:5], r[7], r[8]) for r in rows)
    assert exact(got) == exact(want) and len(got) > 5
    for g, w in zip(sorted(got), sorted(want)):
        assert g[5:7] == pytest.approx(w[5:7], abs=1e-3)


def test_other_texts_against_a_plain_scan(fitted):
    plain = Plain(fitted)
    texts = [t for _, t in APART] + [t for t, _ in L.notices()] + list(L.UNRELATED)
    texts += ["\n\n".join(texts[k : k + 9]) for k in range(0, len(texts), 9)] + [" ".join(texts[k : k + 7]) for k in range(0, len(texts), 7)]
    texts += ["\n \t\n" + texts[0] + "\r\n\r\n" + texts[3], "", "\n", "the of a", "MIT", "x\n\n\n\ny MIT License"]
    for text in texts:
        got, want = L.scan_text(fitted, text), plain.scan(text)
        assert [(*g[:4], *g[6:]) for g in got] == [(*w[:4], *w[6:]) for w in want], text
        for g, w in zip(got, want):
            assert g[4:6] == pytest.approx(w[4:6], abs=1e-3)
