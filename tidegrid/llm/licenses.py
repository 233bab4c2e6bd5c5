"""License scan: sparse TF-IDF cosine of header lines and whole texts to templates, then inheritance from the nearest ancestor directory by path joins.

Headers are found around words like "licence" and "copyright": every window of a template's length there is compared with that template, so words around a notice cost nothing and words within it that the template
doesn't have count against it. Whole texts are compared with whole licences (license_texts), copyright lines left out. Weights are inverse frequencies over the templates; a word that no template has weighs as much as the rarest of theirs.
A document has the licence whose whole text it is (cosine FULL or more), else that of its best header window (LEAST or more, the earliest of equals); what is like none of them, such as a licence unknown here, has none.

A document is a licence file of its directory if it is a whole licence or if its name says so and it has a licence. A document without one of its own takes that of the nearest directory at or above its own that has such a file.

Defined cases: null or empty text has no header; a null path lies in the root directory; of several licence files in a directory the best, then the smallest licence name, counts; repeated rows and ids get a row each; a null doc_id stays. No rows: no rows.
Only doc_id, text and the path are read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import chunks, staged, texts

#: The usual header sentences.
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"],
    "GPL-2.0": ["GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "GNU General Public License, version 2.0", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU General Public License, version 3.0", "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", "BSD 2-Clause Simplified License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause New or Revised License"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
}
TRIGGER = re.compile(r"licen[cs]|copyright|spdx|permission|public domain|creative commons", re.I)
#: The same as beginnings of words: around these, windows are compared, so far on each side as the longest template is.
LEADS = ("licens", "licenc", "unlicens", "spdx", "permission", "domain", "commons")
WORD = re.compile(r"[a-z]+\d*|\d+(?:\.\d+)*")
OWNER = re.compile(r"^\W*(?:copyright|\(c\)|©).*$", re.I | re.M)
LEAST, FULL = 0.8, 0.85
#: Base names of licence files.
NAME = r"(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def whole_texts() -> dict[str, str]:
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


class Library:
    """Templates as vectors: (name, words, {word: weight} of length 1)."""

    def __init__(self, headers: dict[str, list[str]], wholes: dict[str, str]):
        self.headers = self._vectors([(k, words(t)) for k, ts in headers.items() for t in ts])
        self.wholes = self._vectors([(k, words(OWNER.sub(" ", t))) for k, t in wholes.items()])
        self.longest = max(len(w) for _, w, _ in self.headers[0])

    def _vectors(self, rows: list[tuple[str, list[str]]]) -> tuple[list, dict[str, float], float]:
        df = Counter(w for _, ws in rows for w in set(ws))
        top = math.log(len(rows) + 1) + 0.1
        idf = {w: math.log((len(rows) + 1) / (n + 1)) + 0.1 for w, n in df.items()}
        return [(k, ws, self.vector(Counter(ws), idf, top)) for k, ws in rows], idf, top

    @staticmethod
    def vector(counts: Counter, idf: dict[str, float], top: float) -> dict[str, float]:
        v = {w: (1 + math.log(c)) * idf.get(w, top) for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def whole(self, text: str) -> tuple[str | None, float]:
        """The whole licence that a text is most like."""
        rows, idf, top = self.wholes
        v = self.vector(Counter(words(OWNER.sub(" ", text))), idf, top)
        return max(((k, sum(x * v.get(w, 0.0) for w, x in t.items())) for k, _, t in rows), key=lambda r: r[1], default=(None, 0.0))

    def header(self, text: str) -> tuple[str | None, float]:
        """The template that some window of a text is most like; the earliest of equals."""
        found = words(text)
        near = sorted({j for i, w in enumerate(found) if w.startswith(LEADS) for j in range(max(0, i - self.longest), min(len(found), i + self.longest + 1))})
        rows, idf, top = self.headers
        best: tuple[float, int, int, str | None] = (0.0, 0, 0, None)
        for i in near:
            for k, ws, t in rows:
                if found[i] not in t:  # the window that begins with a word of the template is as good
                    continue
                v = self.vector(Counter(found[i : i + len(ws)]), idf, top)
                score = round(sum(x * t.get(w, 0.0) for w, x in v.items()), 9)
                # of equals the earliest, then the longest template: it says more
                best = max(best, (score, -i, len(ws), k), key=lambda r: r[:3])
        return best[3], best[0]

    def of(self, text: str) -> tuple[str | None, float, bool]:
        """licence (None below the thresholds), its cosine, and whether the text is a whole licence."""
        if not TRIGGER.search(text):
            return None, 0.0, False
        whole, cosine = self.whole(text)
        if cosine >= FULL:
            return whole, cosine, True
        name, score = self.header(text)
        return (name if score >= LEAST else None), score, False


@functools.cache
def library() -> Library:
    return Library(TEMPLATES, whole_texts())


def licenses(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, license, score, origin: 'own', 'inherited' or 'none'."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library()
        for batch in batches:
            for b in chunks(batch):
                got = [known.of(t) for t in texts(b.column("text"))]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), *columns], ["doc_id", "path", "own", "score", "file"])

    own = staged(rows.mapInArrow(scan, "doc_id long, path string, own string, score double, file boolean").withColumn("score", F.round("score", 6)), "own-licences")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))
    own = own.withColumns({"dirs": above, "dir": F.element_at(above, -1)})
    files = own.where(F.col("own").isNotNull() & (F.col("file") | F.element_at(parts, -1).rlike(NAME)))
    granted = files.groupBy("dir").agg(F.min_by(F.struct("own", "score"), F.struct(-F.col("score"), F.col("own"))).alias("g"))
    dirs = own.select("dir", "dirs").distinct().select(F.col("dir").alias("of"), F.posexplode("dirs").alias("depth", "dir"))
    nearest = dirs.join(granted, "dir").groupBy(F.col("of").alias("dir")).agg(F.max_by("g", "depth").alias("g"))  # one row for each directory, not for each document
    out = own.join(nearest, "dir", "left")
    has = F.col("own").isNotNull()
    origin = F.when(has, "own").when(F.col("g").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "g.own").alias("license"), F.when(has, F.col("score")).otherwise(F.coalesce("g.score", F.lit(0.0))).alias("score"), origin.alias("origin"))
