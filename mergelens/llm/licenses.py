"""License scan: patience alignment of texts with license templates.

Words that occur once in a stretch of the text and once in the template anchor the alignment;
the longest increasing subsequence of the anchors is kept and the gaps between them are aligned
in the same way, down to equal words at either end of a gap. The share of a template's words
that are aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

# License notices as their publishers word them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "BSD-line": "Distributed under the terms of the BSD license.",
    "CC-BY-SA-4.0-line": "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."
    ),
    "BSD-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}

#: Share of a template's words that has to be aligned.
COVERAGE = 0.8
#: An aligned stretch of the text may be this many times as long as its template.
STRETCH = 1.5

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by first) whose seconds increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k] = b
            at[k] = i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text index, template index) pairs, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        n, m = Counter(text[a0:a1]), Counter(template[b0:b1])
        place = {template[j]: j for j in range(b0, b1)}
        anchors = _increasing([(i, place[text[i]]) for i in range(a0, a1) if n[text[i]] == 1 and m[text[i]] == 1])
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            work += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


class Scanner:
    """Finds the templates in a text.

    Stretches that can hold a template are cut first: a template whose words appear in too few
    numbers anywhere in the text cannot reach the coverage, and neither can a stretch.
    """

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE, stretch: float = STRETCH):
        self.coverage, self.stretch = coverage, stretch
        self.templates = {k: [w for w, *_ in words_of(v)] for k, v in (TEMPLATES if templates is None else templates).items()}
        self.templates = {k: v for k, v in self.templates.items() if v}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.vocabulary = set().union(*self.counts.values()) if self.counts else set()

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) by start; code points, end exclusive."""
        found: list[tuple[str, int, int, float]] = []
        low = text.lower() if text else ""
        present = self.vocabulary.intersection(_WORD.findall(low)) if low else ()
        live = [k for k, n in self.counts.items() if sum(c for w, c in n.items() if w in present) >= self.coverage * len(self.templates[k])]
        if not live:
            return found
        words = words_of(text)
        for name in live:
            found += self._of(name, words)
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))

    def chosen(self, found: list[tuple[str, int, int, float]]) -> list[bool]:
        """For each finding, in the order of ``scan``, whether none that overlaps it aligns more words.

        Of as many words the larger coverage is chosen, then the earlier name and place.
        """
        rank = [(-round(f[3] * len(self.templates[f[0]])), -f[3], f[0], i) for i, f in enumerate(found)]
        out = [True] * len(found)
        for i, (_, _, end, _) in enumerate(found):
            for j in range(i + 1, len(found)):
                if found[j][1] >= end:
                    break
                out[max(i, j, key=rank.__getitem__)] = False
        return out

    def _of(self, name: str, words: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        template, n = self.templates[name], self.counts[name]
        size, need = len(template), self.coverage * len(template)
        hits = [i for i, (w, *_) in enumerate(words) if w in n]
        reach = int(self.stretch * size + 1)
        out, at = [], 0
        while at < len(hits):
            # words of the template within reach of this one; too few: no stretch starts here
            to = at
            have = Counter()
            while to < len(hits) and hits[to] < hits[at] + reach:
                have[words[hits[to]][0]] += 1
                to += 1
            if sum(min(c, n[w]) for w, c in have.items()) < need:
                at += 1
                continue
            a, b = hits[at], hits[to - 1] + 1
            pairs = patience([w for w, *_ in words[a:b]], template)
            if len(pairs) >= need:
                first, last = a + pairs[0][0], a + pairs[-1][0]
                out.append((name, words[first][1], words[last][2], len(pairs) / size))
                while at < len(hits) and hits[at] <= last:
                    at += 1
            else:
                at += 1
        return out


FOUND = "doc_id long, template array<string>, start array<long>, end array<long>, coverage array<double>, chosen array<boolean>"


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each input row with arrays of the licenses found in its whole text.

    Null and empty texts have none; equal and overlapping notices of different templates are
    all reported, and ``chosen`` marks those that no overlapping one outdoes in aligned words (a
    notice of the LGPL holds nearly all words of the GPL's). Notices of one template do not
    overlap: the next is looked for behind the one before. Repeated rows give a row each.
    """

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in (part for whole in batches for part in text_slices(whole)):
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            cols = [[[f[i] for f in fs] for fs in found] for i in range(4)]
            cols.append([scanner.chosen(fs) for fs in found])
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds, strict=True)]],
                names=["doc_id", "template", "start", "end", "coverage", "chosen"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
