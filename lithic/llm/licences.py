"""Licence scans by a trained paragraph classifier.

A paragraph (lines up to a blank one) is read line by line and, as notices are wrapped, as a whole; what is
long comes in overlapping windows of words that cover it. A window is a sparse vector of word one- to three-grams, scaled by the root of its words. Logistic regression over licence families
and an unknown class is trained on the templates below, whole and worn (words lost, strange words put in
before and behind), against paragraphs of the corpus. The unknown class is calibrated on corpus
paragraphs that training did not see: a family's probability has to exceed ``LEAST_SURE`` and what all
but one in ``FALSE_RATE`` of them reach. A prediction is confirmed by comparison with the family's templates: the share
of a template's word pairs that the paragraph has must reach ``LEAST_SHARED``. A paragraph has a hit for every
family that has a confirmed notice in it.

Training reads at most ``MOST_WINDOWS`` windows of at most ``SAMPLE`` documents, those of smallest id hash; the
scan is one map over all whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SAMPLE, FALSE_RATE, LEAST_SURE, LEAST_SHARED = 400, 1000, 0.5, 0.5
WINDOW, STEP = 48, 24
WORN, NEGATIVES, STEPS = 24, 4000, 250
MOST_WINDOWS = 4 * NEGATIVES
TOKEN = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

#: Usual notices of each family, a sentence or a paragraph each.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license, see the LICENSE file for details.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This software is distributed under the terms of the Apache License, Version 2.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL version 2.", "Licensed under the GPL v3."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Released under the Unlicense."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
FAMILIES = sorted(TEMPLATES)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    return words + [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(["", *words], words, strict=False))


def cut_up(words: list[str], at: int):
    """(place of the first word, words) of overlapping windows that cover words, which begin at ``at``."""
    for k in range(0, max(1, len(words) - STEP), STEP) if len(words) > WINDOW else (0,):
        yield at + k, words[k : k + WINDOW]


def windows(text: str):
    """(paragraph's number from 0, place of the first word in it, words) of a text's paragraphs that have words:
    of every line, and where a paragraph has several lines, of the whole."""
    n, lines = 0, []
    for line in [*text.split("\n"), ""]:
        if words := tokens(line):
            lines.append(words)
        elif lines and not line.strip():
            at = 0
            for words in lines:
                for place, some in cut_up(words, at):
                    yield n, place, some
                at += len(words)
            if len(lines) > 1:
                for place, some in cut_up([w for words in lines for w in words], 0):
                    yield n, place, some
            n, lines = n + 1, []


def paragraphs(text: str):
    """windows without the places."""
    for n, _, words in windows(text):
        yield n, words


class Classifier:
    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, floor: np.ndarray) -> None:
        self.vocabulary, self.weights, self.bias, self.floor = vocabulary, weights, bias, floor
        self.cues = {w for texts in TEMPLATES.values() for t in texts for w in tokens(t)}
        self.templates = [[pairs(tokens(t)) for t in TEMPLATES[f]] for f in FAMILIES]
        flat = [t for family in self.templates for t in family]
        self.least = [LEAST_SHARED * len(t) for t in flat]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, template in enumerate(flat):
            for pair in template:
                self.holders.setdefault(pair, []).append(k)

    def probabilities(self, words: list[str]) -> np.ndarray:
        columns = [i for g in grams(words) if (i := self.vocabulary.get(g)) is not None]
        z = self.weights[columns].sum(axis=0) / np.sqrt(max(len(words), 1)) + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def promising(self, words: list[str]) -> bool:
        """Whether the words have enough pairs of some template; without, no notice could be confirmed."""
        found: dict[int, int] = {}
        get = self.holders.get
        for pair in {p for p in zip(["", *words], words, strict=False) if p in self.holders}:
            for k in get(pair):
                found[k] = found.get(k, 0) + 1
        return any(n >= self.least[k] for k, n in found.items())

    def judge(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a confirmed licence paragraph, or None: unknown."""
        if sum(w in self.cues for w in words) < 2:  # no template's pairs could be shared
            return None
        p = self.probabilities(words)
        best = int(p[:-1].argmax())
        if p[best] <= max(p[-1], self.floor[best]):
            return None
        have = pairs(words)
        shared = max(len(t & have) / len(t) for t in self.templates[best])
        return (FAMILIES[best], float(p[best]), shared) if shared >= LEAST_SHARED else None

    def span(self, words: list[str], family: int) -> tuple[int, int, float]:
        """(first, end, similarity): where the words are most like a template of the family."""
        have = pairs(words)
        template = max(self.templates[family], key=lambda t: len(t & have) / len(t))
        marks = [p if p in template else None for p in zip(["", *words], words, strict=False)]
        width = len(template) + len(template) // 4 + 1
        best = (0, 0, 0, 0)
        for at in (i for i, m in enumerate(marks) if m):
            seen: set[tuple[str, str]] = set()
            for i in range(at, min(at + width, len(words))):
                if marks[i] and marks[i] not in seen:
                    seen.add(marks[i])
                    end = i + 1
            best = max(best, (len(seen), at - end, -at, end))
        return max(-best[2] - 1, 0), best[3], len(template & have) / len(template)

    def notices(self, words: list[str]) -> list[tuple[str, float, float, int, int]]:
        """(family, probability, similarity, first, end) of every confirmed notice among the words, the surest
        first: what a notice takes is laid aside and the rest judged again. Where notices share the
        probability and none is sure, the words most like each are judged by themselves."""
        places, out = list(range(len(words))), []
        if not self.promising(words):
            return out
        while sum(words[i] in self.cues for i in places) >= 2:
            rest = [words[i] for i in places]
            hit = self.judge(rest)
            if hit:
                first, end, _ = self.span(rest, FAMILIES.index(hit[0]))
            else:
                p = self.probabilities(rest)
                if p[-1] >= 0.5:
                    break
                for family in np.argsort(-p[:-1], kind="stable"):
                    first, end, shared = self.span(rest, family)
                    if shared >= LEAST_SHARED and end - first < len(rest) and (hit := self.judge(rest[first:end])) and hit[0] == FAMILIES[family]:
                        break
                    hit = None
            if not hit or end <= first:
                break
            out.append((*hit, places[first], places[end - 1] + 1))
            del places[first:end]
        return out


def of_paragraph(notices: list[tuple[str, float, float, int, int]]) -> dict[str, tuple[float, float]]:
    """Family to (probability, similarity) of its surest notice. Of notices that claim the same words, as
    overlapping windows see them, the surest counts."""
    kept: dict[str, tuple[float, float]] = {}
    taken: list[tuple[str, int, int]] = []
    for family, p, shared, first, end in sorted(notices, key=lambda h: (-h[1], h[0], h[3])):
        if any(f != family and 2 * (min(end, e) - max(first, b)) > min(end - first, e - b) for f, b, e in taken):
            continue
        taken.append((family, first, end))
        kept.setdefault(family, (p, shared))
    return kept


def fit(corpus: list[list[str]]) -> Classifier:
    """A classifier from the templates and paragraphs of the corpus, as words."""
    rng = np.random.default_rng(10)
    known = [pairs(tokens(t)) for f in FAMILIES for t in TEMPLATES[f]]
    plain = [w for w in corpus if max(len(t & pairs(w)) / len(t) for t in known) < 0.3]
    plain = [plain[i] for i in rng.permutation(len(plain))[: 2 * NEGATIVES]]
    train, rest = plain[: len(plain) // 2], plain[len(plain) // 2 :]
    strange = [w for p in train for w in p] or ["lorem"]
    rows, labels = list(train), [len(FAMILIES)] * len(train)
    for k, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            words = tokens(template)
            for n in range(WORN):
                kept = [w for w in words if n == 0 or len(words) < 4 or rng.random() > 0.08]
                before, behind = (rng.integers(0, 7, 2) if n % 2 else (0, 0))
                rows.append([strange[i] for i in rng.integers(0, len(strange), before)] + kept + [strange[i] for i in rng.integers(0, len(strange), behind)])
                labels.append(k)
    spread: dict[str, int] = {}
    for family in FAMILIES:
        for word in {w for t in TEMPLATES[family] for w in tokens(t)}:
            spread[word] = spread.get(word, 0) + 1
    for family in FAMILIES:  # notices of licences that are no family here
        for template in TEMPLATES[family]:
            for _ in range(WORN // 4):
                rows.append([w if spread[w] > 3 else strange[int(rng.integers(len(strange)))] for w in tokens(template)])
                labels.append(len(FAMILIES))
    vocabulary: dict[str, int] = {}
    for family in FAMILIES:
        for template in TEMPLATES[family]:
            for g in grams(tokens(template)):
                vocabulary.setdefault(g, len(vocabulary))
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for r, words in enumerate(rows):
        for g in grams(words):
            if (i := vocabulary.get(g)) is not None:
                x[r, i] += 1
        x[r] /= np.sqrt(max(len(words), 1))
    y = np.eye(len(FAMILIES) + 1, dtype=np.float32)[labels]
    share = 1 / y.sum(axis=0)[labels]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, STEPS + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y) * share
        for value, slope, m, v in ((w, x.T @ error + 1e-5 * w, 0, 1), (b, error.sum(axis=0), 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * slope
            moments[v] = 0.999 * moments[v] + 0.001 * slope * slope
            value -= 0.1 * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[v] / (1 - 0.999**step)) + 1e-8)
    found = Classifier(vocabulary, w.astype(np.float64), b.astype(np.float64), np.full(len(FAMILIES), LEAST_SURE))
    if rest:
        unseen = np.sort(np.array([found.probabilities(words)[:-1] for words in rest]), axis=0)
        found.floor = np.maximum(LEAST_SURE, unseen[max(0, len(rest) - 1 - len(rest) // FALSE_RATE)])
    return found


def _words(batches):
    for batch in batches:
        for text in batch.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in paragraphs(text or "")], pa.list_(pa.string()))], ["words"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier whose unknown class knows at most ``MOST_WINDOWS`` windows, those of least hash, of the texts of at
    most ``sample`` ids."""
    some = docs.where("doc_id is not null and text is not null").select(F.xxhash64(F.col("doc_id").cast("long")).alias("draw"), F.col("doc_id").cast("long")).orderBy("draw", "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    got = texts.select("text").mapInArrow(_words, "words array<string>").orderBy(F.xxhash64("words"), "words").limit(MOST_WINDOWS).toArrow()
    return fit(got.column("words").to_pylist())


HITS = "array<struct<paragraph:int,family:string,probability:double,similarity:double>>"


def _scan(shared):
    def run(batches):
        classifier = shared.value
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        for batch in batches:
            counts, hits = [], []
            for text in batch.column("text").to_pylist():
                found: dict[int, list] = {}
                n = -1
                for n, at, words in windows(text or ""):
                    for f, p, s, first, end in classifier.notices(words):
                        found.setdefault(n, []).append((f, p, s, at + first, at + end))
                counts.append(n + 1)
                hits.append([{"paragraph": k, "family": f, "probability": p, "similarity": s} for k, them in sorted(found.items()) for f, (p, s) in sorted(of_paragraph(them).items())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array(hits, kind)], ["doc_id", "n_paragraphs", "hits"])

    return run


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, n_paragraphs, families, hits) per row of docs; families are distinct and sorted.

    Null and empty texts have no paragraph and no family; a text of any length is scanned whole. Of families
    that claim the same words the surest counts, the first by name among equals. Repeated rows and null ids
    pass through; other columns are not read. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(shared), f"doc_id long, n_paragraphs int, hits {HITS}")
    return rows.select("doc_id", "n_paragraphs", F.array_sort(F.array_distinct("hits.family")).alias("families"), "hits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"), F.size("hits").alias("n_hits"))
