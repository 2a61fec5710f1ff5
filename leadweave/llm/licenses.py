"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Every run of ``gram`` words of a template is hashed; of each ``window`` neighbouring hashes the least is kept (winnowing) in
an inverted index hash -> (template, place). All runs of a text are looked up in it, whole batches at a time, so that any
passage that shares gram + window - 1 words with a template is met. The places met give diagonals; neighbouring ones
make one candidate, and a local alignment of words (match 1, mismatch and gap -1) in a band that follows them from hit to
hit, so that a passage with many small insertions stays in it, gives the words that match, in order, and where the passage starts and ends. Alignments of one template that follow one another in the text and
in the template, with less than the template's length between them, are chained into one passage, so that a long insertion
or a missing paragraph does not cut it in two.

The index is as large as the templates, which the caller gives on the driver and which may hold ``MAX_TEMPLATE_WORDS`` words.

Cases: null and empty texts, and texts without a passage like a template's, give no rows. Repeated rows each give theirs. A
passage that fits several templates is reported for each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, byte_chunks, shingles, table

GRAM, WINDOW = 3, 3
MIN_COVERAGE = 0.6
MAX_TEMPLATE_WORDS = 5_000_000
#: Licenses and notices, whole, and short lines that name a license.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "all-rights-reserved": "All rights reserved.",
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, the last of equal ones; all of them if there is less than a window."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    frames = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(frames)) + window - 1 - frames.argmin(axis=1))


class Index:
    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.gram, self.words, self.names = gram, Words(), sorted(templates)
        self.tokens: list[np.ndarray] = []
        keys, owners, places = [], [], []
        for k, name in enumerate(self.names):
            tokens, _, _, before = self._hashed(templates[name])
            runs, _ = shingles(tokens, before, gram)
            kept = winnow(runs, window)
            self.tokens.append(tokens)
            keys.append(runs[kept])
            owners.append(np.full(len(kept), k))
            places.append(kept)
        if sum(map(len, self.tokens)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates hold more than {MAX_TEMPLATE_WORDS} words")
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owners, self.places = (np.concatenate(c)[order] if c else np.zeros(0, np.int64) for c in (owners, places))

    def _hashed(self, text: str):
        body = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.words(body, np.array([0, len(body)]))

    def candidates(self, runs: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(template, its diagonal at each word) of each group of hits; a diagonal is text place - template place."""
        lo, hi = np.searchsorted(self.keys, runs, side="left"), np.searchsorted(self.keys, runs, side="right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        at = np.repeat(hit, (hi - lo)[hit])
        entry = np.concatenate([np.arange(a, b) for a, b in zip(lo[hit], hi[hit], strict=True)])
        owner, diagonal = self.owners[entry], at - self.places[entry]
        out = []
        for k in np.unique(owner):
            mine = owner == k
            order = np.lexsort((at[mine], diagonal[mine]))
            d, p = diagonal[mine][order], at[mine][order]
            band, length = self.band(k), len(self.tokens[k])
            cut = np.flatnonzero((np.diff(d) > band) | (np.abs(np.diff(p)) > length + band)) + 1
            for ds, ps in zip(np.split(d, cut), np.split(p, cut), strict=True):
                out.append((int(k), self.followed(ds, ps - ds, length)))
        return out

    @staticmethod
    def followed(diagonals: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """The diagonal at each of a template's words: that of the last hit up to it, of the most hits that follow one another in both."""
        order = np.lexsort((-diagonals, places))
        hits = list(zip(places[order].tolist(), (places + diagonals)[order].tolist(), strict=True))
        ends: list[int] = []  # least text place that a run of so many hits can end with
        last: list[int] = []  # and the hit that it is
        before = []
        for i, (_, at) in enumerate(hits):
            n = bisect.bisect_left(ends, at)
            before.append(last[n - 1] if n else -1)
            ends[n : n + 1], last[n : n + 1] = [at], [i]
        path, i = [], last[-1]
        while i >= 0:
            path.append(hits[i])
            i = before[i]
        place, at = np.array(path[::-1]).T
        return (at - place)[np.maximum(np.searchsorted(place, np.arange(length), side="right") - 1, 0)]

    def band(self, k: int) -> int:
        return min(8, max(1, len(self.tokens[k]) // 4))

    def align(self, k: int, diagonal: int | np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, int]:
        """Best local alignment of template k in the band around a diagonal, or around one for each of its words: words matched, first and last + 1 word of the text, and of the template."""
        template, band = self.tokens[k].tolist(), self.band(k)
        centres = np.broadcast_to(diagonal, len(template)).tolist()
        best = (0, 0, 0, 0, 0, 0)
        row: dict[int, tuple[int, int, int, int]] = {}  # text place -> (score, matches, start in text, in template)
        for t, word in enumerate(template):
            new: dict[int, tuple[int, int, int, int]] = {}
            lo, hi = max(0, t + centres[t] - band), min(len(text), t + centres[t] + band + 1)
            for p in range(lo, hi):
                score, matched, *start = row.get(p - 1, (0, 0, p, t))
                same = int(text[p]) == word
                cell = (score + 1, matched + 1, *start) if same else (score - 1, matched, *start)
                for other in (row.get(p), new.get(p - 1)):
                    if other and other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                if cell[0] > 0:
                    new[p] = cell
                    if same and (cell[0], cell[1]) > best[:2]:
                        best = (cell[0], cell[1], cell[2], p + 1, cell[3], t + 1)
            row = new
        return best[1:]

    def passages(self, runs: np.ndarray, text: np.ndarray, min_coverage: float) -> list[tuple[int, int, int, int]]:
        """(first word, last + 1, template, words matched) of each passage, in order; of those of a template that overlap, the best."""
        aligned: dict[int, list[tuple]] = {}
        for k, diagonal in self.candidates(runs):
            matched, a, b, ta, tb = self.align(k, diagonal, text)
            if matched:
                aligned.setdefault(k, []).append((a, b, ta, tb, matched))
        out = []
        for k, parts in aligned.items():
            length, parts = len(self.tokens[k]), sorted(set(parts))
            chains: list[tuple] = []  # the best that ends with each part
            for i, (a, b, ta, tb, matched) in enumerate(parts):
                before = (a, 0)
                for j in range(i - 1, -1, -1):
                    if parts[j][0] < a - 2 * length:
                        break
                    if parts[j][1] <= a and parts[j][3] <= ta and a - parts[j][1] < length:
                        before = max(before, (chains[j][0], chains[j][4]), key=lambda c: c[1])
                chains.append((before[0], b, ta, tb, before[1] + matched))
            kept: list[tuple[int, int]] = []  # passages so far, disjoint
            for a, b, _, _, matched in sorted(chains, key=lambda c: (-c[4], c[0])):
                if matched < min_coverage * length:
                    break
                at = bisect.bisect_left(kept, (a, a))
                if not (at and kept[at - 1][1] > a) and not (at < len(kept) and kept[at][0] < b):
                    kept.insert(at, (a, b))
                    out.append((a, b, k, matched))
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, license, coverage, matched_words, start, end) of each passage; start and end count code points. In place, without a shuffle."""
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType

    def run(batches):
        index = Index(templates, gram, window)
        for batch in batches:
            ids, out = batch.column(0), []
            for row, data, offsets in byte_chunks(batch.column(1)):
                tokens, first, last, before = index.words(data, offsets)
                runs, starts = shingles(tokens, before, gram)
                met = np.isin(runs, index.keys)
                for j in np.unique(np.searchsorted(starts, np.flatnonzero(met), side="right") - 1):
                    own = tokens[before[j] : before[j + 1]]
                    found = index.passages(runs[starts[j] : starts[j + 1]], own, min_coverage)
                    if found:
                        points = np.concatenate([[0], np.cumsum((data[offsets[j] : offsets[j + 1]] & 0xC0) != 0x80)])
                    for a, b, k, matched in found:
                        span = (first[before[j] + a] - offsets[j], last[before[j] + b - 1] - offsets[j])
                        out.append((row + int(j), index.names[k], matched / len(index.tokens[k]), matched, int(points[span[0]]), int(points[span[1]])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())], names=["id", "license", "coverage", "matched_words", "start", "end"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, license string, coverage double, matched_words int, start long, end long").withColumnRenamed("id", id_col)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
