"""Licence statements found by a trained paragraph classifier.

A paragraph is a run of lines that aren't blank; signs before and between words (comment marks) don't count. It is read
in spans: each of its lines, and, as notices are wrapped and documents put lines without blank ones between them, the lines
around each that nothing was found in (``WRAPPED`` - 1 to either side), and every stretch that holds enough of a template's word pairs. A span becomes a
sparse vector of its word 1- to 3-grams that occur in training paragraphs. A softmax regression, trained in numpy, gives the
probability of each licence family and of ``unknown``. Training paragraphs are the templates below, whole, with words lost or put in,
and set among ordinary words; ``unknown`` learns from ordinary words, from sentences that use licence words without
granting anything and from templates that a ``not`` or ``never`` takes back. A temperature calibrates the probabilities: it is fitted with a model that has seen neither whole
templates and sentences kept apart (one of each family that has two or more) nor every fifth variation of the others,
on both. A family is reported if it is likelier than
``unknown`` and all others and its probability is at least ``MIN_PROBABILITY``; only then are templates compared: it is confirmed if
enough of one template's word pairs stand in the span, one of them in no other family's templates. Word pairs thus propose spans and
confirm what the classifier says of them, but no statement stands on them alone. A span that the words before it turn into
``unknown`` (``not licensed under ...``) is none.

Spans without a word of ``marks`` are not scored: that set is widened until, by a bound over all sets of the n-grams
that remain, no span without such a word could reach ``MIN_PROBABILITY`` for any family.

Several families in one line: each stretch that has enough of a template's word pairs within ``SLACK`` times the
template's length is classified by itself, unless another family's words fill a gap of the match (``gnu [affero] general``) or all of its pairs are
other families' too (``released under the``).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.runtime import ship

UNKNOWN = "unknown"
MIN_PROBABILITY = 0.6
MIN_CONTAINED = 0.6
SLACK = 1.5
#: Lines to either side that a marked line is read with.
WRAPPED = 3
# Short forms and opening sentences of public licences.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "you should have received a copy of the gnu affero general public license along with this program", "spdx license identifier agpl 3.0 or later", "spdx license identifier agpl 3.0 only"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", "spdx license identifier apache 2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd 3 clause license", "use of this source code is governed by a bsd style license", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 2 clause"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related rights to this work", "dedicated to the public domain under cc0 1.0 universal", "spdx license identifier cc0 1.0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "released under cc by 3.0"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0", "released under cc by nc 3.0"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0", "released under cc by sa 3.0"],
    "cddl": ["the contents of this file are subject to the terms of the common development and distribution license", "licensed under the cddl version 1.0", "spdx license identifier cddl 1.0"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license v2.0", "licensed under the eclipse public license version 1.0", "spdx license identifier epl 2.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "released under the gpl version 2", "spdx license identifier gpl 3.0 or later", "spdx license identifier gpl 2.0 only"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license", "spdx license identifier isc"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "spdx license identifier lgpl 2.1 or later", "spdx license identifier lgpl 3.0 only"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the software is provided as is without warranty of any kind express or implied", "spdx license identifier mit"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "proprietary": ["all rights reserved", "copyright the company all rights reserved", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "released under the zlib license", "spdx license identifier zlib"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx license identifier unlicense"],
}
# Sentences that use such words and grant nothing.
NOT_LICENCES = [
    "he lost his driving license last year", "the license of the shop was renewed by the city", "a fishing license is required at the lake", "she is a licensed nurse with version 2 of the form",
    "all seats are reserved for members", "human rights were discussed in the general assembly", "the apache people lived in the plains", "the public may use the path with or without a guide",
    "students at mit built a robot", "the gnu is a large antelope", "a general public meeting was held", "the work is under way and will be released in spring",
    "the creative team won the commons debate", "the software was released under pressure", "permission to enter was granted to all visitors", "the mozilla team moved to a new office",
]
# English function words.
FUNCTION_WORDS = {"the", "a", "this", "under", "and", "or", "of", "to", "in", "is", "for", "with", "by", "it", "you", "at", "that", "are", "on", "as", "any", "from", "an", "be", "may", "can", "only", "no", "not", "will", "use", "without", "have", "was", "also", "been", "which", "who", "its", "their", "these", "those", "has", "had", "were", "but"}
# Words before a grant that take it back.
TAKEN_BACK = ["not", "is not", "was never", "no longer", "is neither", "this project is not", "cannot be"]
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: A blank line (or the beginning) before a line with something in it.
_BREAK = re.compile(r"\n\s*\n(?=\s*\S)")


def _grams(words: list[str]) -> list[str]:
    return words + [" ".join(p) for p in zip(words, words[1:])] + [" ".join(p) for p in zip(words, words[1:], words[2:])]


class LicenceModel:
    """Softmax regression over n-grams; the classes are the families in order, then unknown."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, seed: int = 5, copies: int = 40):
        self.families = sorted(templates)
        self.pairs = {f: [set(zip(w, w[1:])) for w in (_WORD.findall(t) for t in templates[f])] for f in self.families}
        self.shapes = [(f, t, len(_WORD.findall(text))) for f in self.families for t, text in zip(self.pairs[f], templates[f])]
        self.uses: dict[tuple[str, str], list[int]] = {}  # templates of a word pair
        for k, (_, t, _) in enumerate(self.shapes):
            for pair in t:
                self.uses.setdefault(pair, []).append(k)
        self.family_pairs = {f: set().union(*self.pairs[f]) for f in self.families}
        rng = np.random.default_rng(seed)
        plain = sorted({w for s in NOT_LICENCES for w in s.split()} | {"".join(rng.choice(list("abcdeilmnorstu"), rng.integers(2, 9))) for _ in range(400)})
        samples: list[tuple[list[str], int]] = []
        apart: list[bool] = []  # of a template or sentence that the calibration holds out
        for y, f in enumerate(self.families):
            for number, t in enumerate(templates[f]):
                w = _WORD.findall(t)
                apart += [number > 0 and number == len(templates[f]) - 1] * copies
                for k in range(copies):
                    lost = (0.0, 0.08, 0.15, 0.3)[k % 4]
                    x = [v for v in w if k == 0 or len(w) < 5 or rng.random() > lost]
                    for _ in range(rng.integers(0, 3) if k > copies // 2 and len(w) > 6 else 0):
                        x.insert(int(rng.integers(1, len(x) + 1)), str(rng.choice(plain)))
                    around = rng.choice(plain, rng.integers(0, 9)).tolist() if k > copies // 4 else []
                    cut = rng.integers(0, len(around) + 1)
                    samples.append((around[:cut] + x + around[cut:], y))
        n = len(self.families)
        for number, s in enumerate(NOT_LICENCES):
            samples += [(s.split(), n)] * (copies // 2)
            apart += [number % 4 == 0] * (copies // 2)
        short = [t for f in self.families for t in templates[f] if t.split()[0] in ("licensed", "released", "this", "dedicated") and len(t.split()) < 14]
        denials = []
        for number, t in enumerate(short):
            for k, before in enumerate(TAKEN_BACK):
                grant = t.replace("this work is ", "").split()
                denials.append([*rng.choice(plain, rng.integers(0, 4)).tolist(), *before.split(), *grant, *rng.choice(plain, rng.integers(0, 4)).tolist()])
                apart.append(k == number % len(TAKEN_BACK))
        samples += [(x, n) for x in denials]
        words = sorted({w for ts in templates.values() for t in ts for w in _WORD.findall(t)})
        for _ in range(len(samples)):  # licence words out of order, and ordinary words
            mixed = rng.choice(words, rng.integers(0, 3)).tolist() + rng.choice(plain, rng.integers(2, 14)).tolist()
            samples.append(([mixed[i] for i in rng.permutation(len(mixed))], n))
            apart.append(len(apart) % 5 == 0)
        counts = Counter(g for x, _ in samples for g in set(_grams(x)))
        known = {g for ts in templates.values() for t in ts for g in _grams(_WORD.findall(t))}
        known |= {g for x in denials for g in _grams(x) if {"not", "never", "no", "neither", "cannot"} & set(g.split())}
        # N-grams of function words alone say nothing; left out, they can't make a text of such words worth scoring either.
        self.index = {g: i for i, g in enumerate(sorted(g for g in known if counts[g] >= 2 and not FUNCTION_WORDS.issuperset(g.split())))}
        unseen, varied = np.array(apart), np.arange(len(samples)) % 5 == 0
        held = unseen | varied
        x = np.stack([self.vector(w) for w, _ in samples])
        y = np.array([k for _, k in samples])
        self.temperature = 1.0
        self._train(x[~held], y[~held])
        self._calibrate(x[held], y[held])
        self._train(x, y)
        common = {w for s in NOT_LICENCES for w in s.split()} | FUNCTION_WORDS
        marks = {w for w in words if w not in common and not w[0].isdigit() and len(w) > 2} | {"license", "licensed", "rights", "mit", "gnu", "mozilla", "apache", "cc", "gpl", "permission"}
        self.marked_words = self._widened(marks)
        self.marks = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(self.marked_words))) + r")(?![a-z0-9])")

    def unmarked_odds(self, marks: set[str]) -> list[tuple[float, str, list[str]]]:
        """For each family a bound of its log odds against unknown over all sets of n-grams without a mark, and the n-grams that reach it."""
        rest = [g for g in self.index if not any(w in marks for w in g.split())]
        at = [self.index[g] for g in rest]
        out = []
        for f, family in enumerate(self.families):
            gain = (self.weights[at, f] - self.weights[at, -1]) / self.temperature
            order = np.argsort(-gain)
            order = order[gain[order] > 0]
            reach = np.cumsum(gain[order]) / np.sqrt(np.arange(1, len(order) + 1))
            best = int(reach.argmax()) if len(reach) else 0
            bias = (self.bias[f] - self.bias[-1]) / self.temperature
            out.append((float(max(0.0, reach[best]) if len(reach) else 0.0) + float(bias), family, [rest[k] for k in order[: best + 1]]))
        return out

    def _widened(self, marks: set[str]) -> set[str]:
        """Marks, with words added until no family can be reported without one of them."""
        marks = set(marks)
        while True:
            odds, _, grams = max(self.unmarked_odds(marks))
            if odds < math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY)):
                return marks
            marks.add(min((w for w in grams[0].split()), key=lambda w: (w in FUNCTION_WORDS, -len(w), w)))

    def vector(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.index))
        found = [self.index[g] for g in set(_grams(words)) if g in self.index]
        out[found] = 1
        return out / max(1.0, np.sqrt(out.sum()))

    def _train(self, x: np.ndarray, y: np.ndarray, steps: int = 150) -> None:
        self.weights, self.bias = np.zeros((len(self.index), len(self.families) + 1)), np.zeros(len(self.families) + 1)
        target = np.eye(self.weights.shape[1])[y]
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        mb, vb = np.zeros_like(self.bias), np.zeros_like(self.bias)
        for t in range(1, steps + 1):
            d = (self._softmax(x @ self.weights + self.bias) - target) / len(x)
            g, gb = x.T @ d + 1e-6 * self.weights, d.sum(axis=0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            self.weights -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            self.bias -= 0.15 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = x @ self.weights + self.bias
        loss = [(-np.log(self._softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)]
        self.temperature = min(loss)[1]

    def predicted(self, words: list[str]) -> tuple[str, float, float]:
        """The likeliest class of a span, its probability and that of unknown."""
        grams = [self.index[g] for g in set(_grams(words)) if g in self.index]
        if not grams:
            return UNKNOWN, 1.0, 1.0
        z = (self.weights[grams].sum(axis=0) / np.sqrt(len(grams)) + self.bias)[None] / self.temperature
        p = self._softmax(z)[0]
        best = int(p.argmax())
        return [*self.families, UNKNOWN][best], float(p[best]), float(p[-1])

    def classify(self, line: str) -> tuple[str, float, bool] | None:
        """Family, probability and whether a template confirms it, of a lower-case line; None: unknown."""
        words = _WORD.findall(line)
        family, p, _ = self.predicted(words)
        if family == UNKNOWN or p < MIN_PROBABILITY:
            return None
        have = set(zip(words, words[1:]))
        fits = any(len(t & have) >= MIN_CONTAINED * len(t) and any(not self._shared(pair, family) for pair in t & have) for t in self.pairs[family])
        return family, p, fits

    def _shared(self, pair: tuple[str, str], family: str) -> bool:
        return any(pair in p for f, p in self.family_pairs.items() if f != family)

    def confirmed(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, family, probability) of every stretch that fits a template and that the classifier gives to its family.

        A family's stretches don't overlap. The classifier judges the stretch by itself; with the three words before it, it must
        not become unknown.
        """
        hits: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            for k in self.uses.get(pair, ()):
                hits.setdefault(k, []).append(i)
        out: list[tuple[int, int, str, float]] = []
        for k, at in sorted(hits.items()):
            family, pairs, size = self.shapes[k]
            need, reach = MIN_CONTAINED * len(pairs), int(SLACK * size) + 2
            for a, b in self._windows(words, at, need, reach):
                inside = at[a:b]
                if not self._own(words, inside, family):
                    continue
                first, end = inside[0], inside[-1] + 2
                said, p, _ = self.predicted(words[first:end])
                if said == family and p >= MIN_PROBABILITY and self.predicted(words[max(0, first - 3) : end])[2] < MIN_PROBABILITY:
                    out.append((first, end - 1, family, p))
        kept: list[tuple[int, int, str, float]] = []
        for m in sorted(out):
            if not any(m[2] == o[2] and m[0] <= o[1] for o in kept):
                kept.append(m)
        return kept

    @staticmethod
    def _windows(words: list[str], at: list[int], need: float, reach: int) -> list[tuple[int, int]]:
        """Ranges of ``at`` within reach that hold enough distinct pairs, fullest first, without overlap."""
        if len(at) < need:
            return []
        have: Counter = Counter()
        full, b = [], 0
        for a in range(len(at)):
            while b < len(at) and at[b] < at[a] + reach:
                have[words[at[b]], words[at[b] + 1]] += 1
                b += 1
            if len(have) >= need:
                end, spare = b, Counter(have)  # without the pairs at the end that stand in the range before
                while spare[last := (words[at[end - 1]], words[at[end - 1] + 1])] > 1:
                    spare[last] -= 1
                    end -= 1
                full.append((-len(have), at[end - 1] - at[a], a, end))
            first = words[at[a]], words[at[a] + 1]
            have[first] -= 1
            if not have[first]:
                del have[first]
        taken = np.zeros(len(at), bool)
        out = []
        for _, _, a, b in sorted(full):
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((a, b))
        return out

    def _own(self, words: list[str], inside: list[int], family: str) -> bool:
        return not all(self._shared((words[i], words[i + 1]), family) for i in inside) and not self._filled(words, inside, family)

    def _filled(self, words: list[str], inside: list[int], family: str) -> bool:
        """Whether another family's words stand in a gap of the match."""
        for i, j in zip(inside, inside[1:]):
            gap = list(zip(words[i + 1 : j], words[i + 2 : j + 1]))
            if j > i + 1 and any(all(g in p for g in gap) for f, p in self.family_pairs.items() if f != family):
                return True
        return False

    def mistaken(self, line: str, family: str) -> bool:
        """Whether the family's best template fits the line only around another family's words."""
        words = _WORD.findall(line)
        pairs = max(self.pairs[family], key=lambda t: len(t & set(zip(words, words[1:]))) / max(1, len(t)))
        return self._filled(words, [i for i, p in enumerate(zip(words, words[1:])) if p in pairs], family)


def paragraphs(lines: list[str]):
    """(first, end) of each run of lines that aren't blank."""
    first = None
    for k, line in enumerate([*lines, ""]):
        blank = not line or line.isspace()
        if blank and first is not None:
            yield first, k
            first = None
        elif not blank and first is None:
            first = k


def statements(model: LicenceModel, low: str) -> list[dict]:
    """Licence statements of a lower-case text by line; a match over several lines stands at its first."""
    lines = low.split("\n")
    out = []
    for first, end in paragraphs(lines):
        marked = [k for k in range(first, end) if model.marks.search(lines[k])]
        if not marked:
            continue
        words, line_of = [], []
        for k in range(first, end):
            mine = _WORD.findall(lines[k])
            words += mine
            line_of += [k] * len(mine)
        matches = [(line_of[a], line_of[b], family, p) for a, b, family, p in model.confirmed(words)]
        sure = set()
        for k in marked:
            if got := model.classify(lines[k]):
                here = [m for m in matches if m[0] <= k <= m[1]]
                # A line cut off by wrapping, or with a word in a gap, can look like another family's statement.
                if here and got[0] not in {m[2] for m in here} and (any(m[0] < m[1] for m in here) or model.mistaken(lines[k], got[0])):
                    continue
                out.append({"paragraph": k, "family": got[0], "probability": got[1], "confirmed": got[2]})
                if got[2]:
                    sure.add((k, got[0]))
        taken = {k for a, b, *_ in matches for k in range(a, b + 1)} | {x["paragraph"] for x in out if x["paragraph"] >= first}
        for k in marked:  # a notice wrapped over lines that fits no template well enough
            here = range(max(first, k - WRAPPED + 1), min(end, k + WRAPPED))
            if len(here) > 1 and taken.isdisjoint(here):
                joined = " ".join(lines[j] for j in here)
                if (got := model.classify(joined)) and not model.mistaken(joined, got[0]):
                    out.append({"paragraph": here[0], "family": got[0], "probability": got[1], "confirmed": got[2]})
                    taken.update(here)
        for a, b, family, p in matches:
            if not any((k, family) in sure for k in range(a, b + 1)):
                out.append({"paragraph": a, "family": family, "probability": p, "confirmed": True})
    return sorted(out, key=lambda x: x["paragraph"])


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per input row: doc_id, n_paragraphs (runs of lines that aren't blank), and ``found``: array of (paragraph,
    family, probability, confirmed), where ``paragraph`` is the number of the line a statement begins in.

    A null or empty text has no paragraph. A very long text is read whole. Rows that repeat stay rows; a null doc_id
    stays null. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or LicenceModel())  # fixed size: the templates' n-grams
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            for i in range(0, len(batch), 512):
                count, found = [], []
                for text in batch.column(1).slice(i, 512).to_pylist():
                    low = (text or "").lower()
                    mine = statements(model, low) if model.marks.search(low) else []
                    count.append(len(_BREAK.findall("\n\n" + low)))
                    found.append(mine)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 512), pa.array(count, pa.int64()), pa.array(found, kind)], ["doc_id", "n_paragraphs", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences (confirmed statements), licences (families, sorted, by commas), score (largest probability; 0: none)."""
    sure = F.filter("found", lambda x: x["confirmed"])
    return result.select(
        "doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["probability"])), F.lit(0.0)).alias("score"),
    )
