"""License scans: sparse TF-IDF cosine of lines to templates, then inheritance from the nearest directory.

Every line of a text, the whole text, and every window of as many terms as a template has are compared; windows go
over line breaks, begin with a term of the template and end with the text at the latest.  Terms are runs of ASCII letters and digits in lower case; a
term's weight is its count times log(1 + documents / (1 + documents that hold it)), with counts over the whole
corpus for the terms of the templates; any other term weighs as much as one that a single document holds.  A file's own license is that of the best of these
(by cosine, then lines before the text before windows, then by template order) that reaches ``THRESHOLD``.  A file without one takes the license of the
nearest directory above it that has one; a directory's license is that of its license files.

What holds none of the distinctive terms, or too little of a template's weight, cannot reach the threshold
(Cauchy-Schwarz over the terms in common) and is not weighed.  Null and empty texts have no license of their own; null paths inherit nothing; of several
license files in a directory the one with the best score counts, then the least path, then the least license;
repeated rows each keep their own row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.base import cut, slices

THRESHOLD = 0.6
#: Names of license files.
FILES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"

#: Usual license notices, as they stand in headers.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole licence texts, as they stand in licence files.
FILE_TEXTS = (
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. " + _AS_IS
    )),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission. " + _BSD_END
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    )),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    )),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )),
)
TEMPLATES = (*NOTICES, *FILE_TEXTS)

#: ASCII letters in lower case and digits stay; all other bytes become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms(text: str | bytes) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


class Matcher:
    """Templates as vectors, given how many documents there are and hold each term."""

    def __init__(self, templates: list[tuple[str, str]], documents: int, holding: dict[bytes, int], threshold: float = THRESHOLD):
        self.documents, self.holding, self.threshold = documents, holding, threshold
        self.rare = math.log(1 + documents / 2)
        self.vectors, self.lengths = [], []
        for name, text in templates:
            v = self.vector(text)
            norm = math.sqrt(sum(x * x for x in v.values()))
            if norm:
                self.vectors.append((name, {t: x / norm for t, x in v.items()}))
                self.lengths.append(len(terms(text)))
        # Terms of little weight are left out while no template can be reached with them alone.
        weak: set[bytes] = set()
        left = [0.0] * len(self.vectors)
        for t in sorted({t for _, v in self.vectors for t in v}, key=lambda t: (max(v.get(t, 0) for _, v in self.vectors), t)):
            more = [x + v.get(t, 0) ** 2 for x, (_, v) in zip(left, self.vectors, strict=True)]
            if max(more) < (threshold * 0.999) ** 2:
                weak.add(t)
                left = more
        self.known = {t for _, v in self.vectors for t in v}
        self.strong = self.known - weak

    def idf(self, term: bytes) -> float:
        return math.log(1 + self.documents / (1 + self.holding[term])) if term in self.holding else self.rare

    def vector(self, text: str | list[bytes]) -> dict[bytes, float]:
        return {t: n * self.idf(t) for t, n in Counter(terms(text) if isinstance(text, str) else text).items()}

    def _weighed(self, words: list[bytes], found: tuple[str | None, float]) -> tuple[str | None, float]:
        """The better of ``found`` and the best template for a unit of text."""
        if self.strong.isdisjoint(words):
            return found
        v = self.vector(words)
        norm = math.sqrt(sum(x * x for x in v.values()))
        for name, t in self.vectors:
            score = sum(x * v.get(k, 0.0) for k, x in t.items()) / norm
            if score >= self.threshold and score > found[1] + 1e-12:
                found = (name, score)
        return found

    def best(self, text: str | bytes) -> tuple[str | None, float]:
        """License and cosine of the best line, or (None, 0.0)."""
        found: tuple[str | None, float] = (None, 0.0)
        for line in (text.encode() if isinstance(text, str) else text).split(b"\n"):
            found = self._weighed(terms(line), found)
        return found

    def notice(self, text: str | bytes) -> tuple[str | None, float]:
        """License and cosine of the best line, whole text or window, or (None, 0.0)."""
        words = terms(text)
        if self.strong.isdisjoint(words):
            return None, 0.0
        found = self._weighed(words, self.best(text))
        least = (self.threshold * 0.999) ** 2
        places = [(i, w) for i, w in enumerate(words) if w in self.known]
        for (name, t), length in zip(self.vectors, self.lengths, strict=True):
            hits = [i for i, w in places if w in t]
            mass = [t[words[i]] ** 2 for i in hits]
            after, inside = 0, 0.0
            for k, i in enumerate(hits):
                while after < len(hits) and hits[after] < i + length:
                    inside += mass[after]
                    after += 1
                # A term that comes twice counts twice here, so this is no less than the weight in common.
                if inside >= least:
                    v = Counter(words[i : i + length])
                    if sum(t[w] ** 2 for w in v if w in t) >= least:
                        v = {w: n * self.idf(w) for w, n in v.items()}
                        score = sum(x * v.get(w, 0.0) for w, x in t.items()) / math.sqrt(sum(x * x for x in v.values()))
                        if score >= self.threshold and score > found[1] + 1e-12:
                            found = (name, score)
                inside -= mass[k]
        return found


def counts(texts: DataFrame, templates: list[tuple[str, str]]) -> tuple[int, dict[bytes, int]]:
    """Documents in all, and those that hold each term of the templates: one number a term comes to the driver."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = set(vocabulary), Counter()
        for _, raws in slices(batches, "text"):
            seen[b""] += len(raws)
            for raw in raws:
                seen.update(known.intersection(terms(raw)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    rows = texts.select("text").mapInArrow(go, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    holding = {bytes(r["term"]): r["n"] for r in rows}
    return holding.pop(b"", 0), {t: holding.get(t, 0) for t in vocabulary}


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, license_file: Column | None = None) -> DataFrame:
    """doc_id, path, own_license, own_score, license, inherited_from: one row for each row of ``files`` (doc_id, path, text).

    ``license_file`` tells, over doc_id, path, own_license and own_score, which licensed files stand for their directory.
    """
    chosen = list(TEMPLATES if templates is None else templates)
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    documents, holding = counts(rows, chosen)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chosen, documents, holding)
        for batch, raws in slices(batches, "text"):
            found = [matcher.notice(raw) for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("path"), pa.array([n for n, _ in found], pa.string()), pa.array([round(s, 9) for _, s in found], pa.float64())],
                ["doc_id", "path", "own_license", "own_score"],
            )

    own = cut(rows.mapInArrow(go, "doc_id long, path string, own_license string, own_score double"))  # read four times, without texts
    is_file = F.regexp_extract("path", r"[^/]*$", 0).rlike(FILES) if license_file is None else license_file
    folder = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    first = F.min(F.struct(-F.col("own_score"), "path", "own_license"))
    folders = own.where("own_license is not null and path is not null").where(is_file).groupBy(folder.alias("dir")).agg(first["own_license"].alias("dir_license"))
    # Each file without a license meets the directories above it; the longest path that has one wins.
    parts = F.split(F.col("folder"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    bare = own.where("own_license is null and path is not null").select(folder.alias("folder")).distinct()
    met = bare.select("folder", F.explode(F.array_distinct(above)).alias("dir")).join(folders, "dir")
    nearest = met.groupBy("folder").agg(F.max_by(F.struct("dir", "dir_license"), F.length("dir")).alias("x")).select("folder", "x.*")
    joined = own.withColumn("of", F.when(F.col("own_license").isNull(), folder)).join(nearest, F.col("of") == F.col("folder"), "left")
    return joined.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.col("dir").alias("inherited_from")
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text of ``documents``, which have no paths: source / language / 64 neighbouring ids / ... / id.

    Every third id lies in that folder itself, the next in its folder of 16 ids, the next in the folder of 4 ids in
    that one, so that licenses above leaf folders are inherited.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    shelf = F.floor(F.col("doc_id") / 64).cast("string")
    deep = F.pmod(F.col("doc_id"), F.lit(3))
    below = [F.when(deep >= k, F.floor(F.col("doc_id") / n).cast("string")) for k, n in ((1, 16), (2, 4))]  # concat_ws leaves nulls out
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce(shelf, F.lit("none")), *below, F.concat(part("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")
