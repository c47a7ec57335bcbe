"""Licence scan: a trained paragraph classifier with templates.

A paragraph is a line, or a run of lines without an empty one between them, as in wrapped notices; longer ones are looked at in windows of WINDOW words, half a window apart.
Its word uni- and bigrams are sparse binary features of a multinomial logistic regression over licence families and an unknown class. The model is trained here, on
paragraphs generated from TEMPLATES (words dropped, repeated, framed by corpus words) against three kinds of unknown: lines of a bounded sample of the corpus (SAMPLE_LINES
lines of at most LINE_CHARS characters from SAMPLE documents, those with the least hashes), shuffled template words, and sentences about licences that grant nothing. One half of
each kind is held back to calibrate: the temperature that makes its probabilities honest, then the least probability at which at most FALSE of its unknown paragraphs pass.
A passing paragraph is confirmed only if it holds SHARED of the distinct word pairs of a template of its family, so that the closest template names the licence.

A paragraph without any known bigram shares no pair with a template, so it is passed over, which changes no result. What single lines show is reported by line; a run of lines adds the
families that none of its lines shows, at the line where the most probable window begins.

Edge cases: null and empty texts have no paragraphs. Repeated rows give repeated findings. Windows of one line that find the same family give one finding, the most probable. An empty table trains without
corpus lines and gives no findings. Other columns are ignored. The model depends on the sample and the seed alone.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import table

#: Notices by which the licences are usually named, and sentences of their bodies, of WINDOW words at most.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Distributed under the terms of the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied.", "Each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display and distribute the Work."],
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.", "Including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Distributed under the GNU General Public License, version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "mpl": ["This file is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "You may not use the material for commercial purposes."],
    "cc0": ["To the extent possible under law, the author has waived all rights under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law."],
    "proprietary": ["Copyright. All rights reserved.", "Confidential and proprietary. Unauthorized copying is prohibited."],
}
NOT_GRANTS = [
    "The driver renewed the license of the car last week.", "A fishing licence is required under the law of the state.",
    "The public library has a general version of the book.", "He attended MIT and worked on the project in public.",
    "The court reserved the right to all further terms.", "The copying of files is permitted with modification in the office.",
    "An international work of creative attribution was distributed."
]
SAMPLE = 300
SAMPLE_LINES = 6000
LINE_CHARS = 4000
#: Sampled lines whose words frame the training paragraphs.
FRAME_LINES = 400
WINDOW = 40
FALSE = 0.001
SHARED = 0.6
UNKNOWN = "unknown"
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def _words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def _pairs(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w[:-1], w[1:], strict=True))


class Model:
    """Sparse weights, temperature and cut; picklable."""

    def __init__(self, lines: list[str], seed: int = 5):
        rnd = random.Random(seed)
        self.families = [*TEMPLATES, UNKNOWN]
        self.pairs = {f: [_pairs(_words(t)) for t in ts] for f, ts in TEMPLATES.items()}
        known = {w for ts in TEMPLATES.values() for t in ts for w in _words(t)}
        rows = self._paragraphs(lines, rnd)
        self.ids: dict = {}
        for w, f in rows:
            if f != UNKNOWN:
                for g in (*w, *sorted(_pairs(w))):
                    if isinstance(g, tuple) or g in known:
                        self.ids.setdefault(g, len(self.ids))
        half = len(rows) // 2
        self._fit(rows[:half])
        self._calibrate(rows[half:])

    def _paragraphs(self, lines: list[str], rnd: random.Random) -> list[tuple[list[str], str]]:
        """Noisy copies of every template, and the three kinds of unknown; shuffled."""
        known = [w for ts in TEMPLATES.values() for t in ts for w in _words(t)]
        lines = [x for x in lines if not any(self._shared(_words(x), f) >= 0.3 for f in TEMPLATES)]
        filler = [w for x in lines[:FRAME_LINES] for w in _words(x)] or known
        framed = lambda w: rnd.choices(filler, k=rnd.choice((0, 0, 0, 3, 10))) + w + rnd.choices(filler, k=rnd.choice((0, 0, 0, 3, 10)))
        rows = []
        for f, ts in TEMPLATES.items():
            for t in ts:
                for _ in range(60):
                    rows.append((framed([x for x in _words(t) for _ in range(rnd.choices((0, 1, 2), (6, 90, 4))[0])]), f))
        rows += [(w, UNKNOWN) for w in map(_words, lines) if w]
        for _ in range(600):
            rows.append((framed(rnd.sample(known, min(len(known), rnd.randrange(3, 14)))), UNKNOWN))
            rows.append((framed(_words(rnd.choice(NOT_GRANTS))), UNKNOWN))
        rnd.shuffle(rows)
        return rows

    def measured(self, lines: list[str], seed: int) -> dict[str, float]:
        """On paragraphs of another seed: the share of licences confirmed with their family, of unknowns left alone, and the expected calibration error in ten bins."""
        rows = self._paragraphs(lines, random.Random(seed))
        found = [self.judged(w) for w, _ in rows]
        grants = [x is not None and x[0] == f for x, (_, f) in zip(found, rows, strict=True) if f != UNKNOWN]
        others = [x is None for x, (_, f) in zip(found, rows, strict=True) if f == UNKNOWN]
        p = [self.probabilities(w) for w, _ in rows]
        top = np.array([x.max() for x in p])
        right = np.array([self.families[int(x.argmax())] == f for x, (_, f) in zip(p, rows, strict=True)])
        place = np.minimum((top * 10).astype(int), 9)
        error = sum(
            abs(float(top[place == k].mean() - right[place == k].mean())) * float((place == k).mean()) for k in range(10) if (place == k).any()
        )
        return {"recall": sum(grants) / len(grants), "left_alone": sum(others) / len(others), "calibration_error": error}

    def _shared(self, w: list[str], family: str) -> float:
        own = _pairs(w)
        return max(len(p & own) / len(p) if p else 0.0 for p in self.pairs[family])

    def _row(self, w: list[str]) -> np.ndarray:
        return np.array(sorted({self.ids[g] for g in (*w, *_pairs(w)) if g in self.ids}), np.int64)

    def _fit(self, rows: list[tuple[list[str], str]]) -> None:
        x = np.zeros((len(rows), len(self.ids)), np.float32)
        for i, (w, _) in enumerate(rows):
            x[i, self._row(w)] = 1
        y = np.array([self.families.index(f) for _, f in rows])
        hot = np.eye(len(self.families), dtype=np.float32)[y]
        self.w, self.b = np.zeros((len(self.ids), len(self.families)), np.float32), np.zeros(len(self.families), np.float32)
        for _ in range(150):
            s = x @ self.w + self.b
            p = np.exp(s - s.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - hot) / len(rows)
            self.w -= 4 * (x.T @ d + 1e-4 * self.w)
            self.b -= 4 * d.sum(0)

    def scores(self, w: list[str]) -> np.ndarray:
        return self.w[self._row(w)].sum(0) + self.b

    def _calibrate(self, rows: list[tuple[list[str], str]]) -> None:
        s = np.array([self.scores(w) for w, _ in rows])
        y = np.array([self.families.index(f) for _, f in rows])

        def loss(t: float) -> float:
            z = s / t
            z -= z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

        self.heat = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        best = np.sort([self.probabilities(w)[:-1].max() for w, f in rows if f == UNKNOWN])[::-1]
        self.cut = max(0.5, float(best[math.floor(FALSE * len(best))])) if len(best) else 0.5

    def probabilities(self, w: list[str]) -> np.ndarray:
        z = self.scores(w) / self.heat
        p = np.exp(z - z.max())
        return p / p.sum()

    def judged(self, w: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, share of the template) of a window that is confirmed."""
        if not any(g in self.ids for g in zip(w[:-1], w[1:], strict=True)):
            return None
        p = self.probabilities(w)
        k = int(p.argmax())
        family = self.families[k]
        if family == UNKNOWN or p[k] < self.cut:
            return None
        share = self._shared(w, family)
        return (family, float(p[k]), share) if share >= SHARED else None

    def findings(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, share of the template) in a text."""
        out, block = [], []

        def windows(w: list) -> Iterator[int]:
            return iter(range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2))

        def close() -> None:
            """What the lines of a block show, each alone, and then all in a row."""
            seen = set()
            for n, w in block:
                best: dict[str, tuple[float, float]] = {}
                for a in windows(w):
                    if x := self.judged(w[a : a + WINDOW]):
                        best[x[0]] = max(best.get(x[0], (0.0, 0.0)), x[1:])
                seen |= best.keys()
                out.extend((n, f, *v) for f, v in sorted(best.items()))
            if len(block) > 1:
                w, at = [x for _, y in block for x in y], [n for n, y in block for _ in y]
                more: dict[str, tuple[float, float, int]] = {}
                for a in windows(w):
                    part = at[a : a + WINDOW]
                    if part and part[0] != part[-1] and (x := self.judged(w[a : a + WINDOW])) and x[0] not in seen:
                        more[x[0]] = max(more.get(x[0], (0.0, 0.0, 0)), (x[1], x[2], -part[0]))
                out.extend((-n, f, p, share) for f, (p, share, n) in sorted(more.items()))
            block.clear()

        for n, line in enumerate(text.split("\n")):
            if line.strip():
                block.append((n, _words(line)))
            else:
                close()
        close()
        return sorted(out)


def _scanner(model: Model):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *x) for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True) if t for x in model.findings(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "family", "probability", "shared"])

    return run


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, line, family, probability, shared: a row for each licence notice found."""
    hashed = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("_h"))
    # hashes alone are ordered first: a task hands on SAMPLE numbers, not SAMPLE texts
    cut = hashed.select("_h").orderBy("_h").limit(SAMPLE).agg(F.max("_h")).first()[0]
    lines: list[str] = []
    if cut is not None:
        every = hashed.where(F.col("_h") <= F.lit(cut)).select(F.explode(F.split("text", "\n")).alias("line")).where(f"length(line) <= {LINE_CHARS}")
        lines = [r["line"] for r in every.distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _scanner(Model(lines)), "doc_id long, line int, family string, probability double, shared double"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
