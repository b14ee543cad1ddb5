"""License scans by patience alignment.

A window is looked at where it shares ``LEAST`` of a template's words, counted with repeats
and in any order; every window that could pass does so. Where such windows overlap they make
one region. In it, windows that hold that many in order are cut out one behind the other, by
lengths of longest common subsequences, so each of several copies in a row is a window of its
own. Text and template are aligned in a window by anchoring on words that occur once in both,
taking the longest increasing subsequence of their places, and aligning the gaps between
anchors in the same way; where a gap has no such words, equal words at its two ends are
matched. Coverage is the matched share of the template's words; where anchors are too few for
``LEAST``, that of the common subsequence. A window has at most ``WIDE`` times the template's
words. Longer occurrences are found where they share three-word runs with the template: runs
closer than its length, with no window among them, are aligned once as a whole.

Where regions of several templates overlap, the one with most matched words stays, of equal
ones that of the higher coverage: a notice is reported as what it is, not as each of the
notices that it resembles, and a whole license not also as the header it ends with.

Words are lower-cased runs of letters and digits. Nulls: a null text has no words, a null
doc_id is kept. Repeated rows give a row for each region of each. An empty table gives no
row. Other columns are ignored. Long texts are scanned whole, in time linear in their length
and in the regions found.
"""

from __future__ import annotations

import functools
import math
import os
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.tokens import steps
from ctxloom.llm.words import mix, word_hashes

LEAST, RUN, WIDE, BITS = 0.8, 3, 4, 22
WORD = re.compile(r"[^\W_]+")

#: Public license texts and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Whole public licenses, a file each.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


@functools.cache
def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the whole licenses, by name."""
    whole = {}
    for name in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, name), encoding="utf-8") as text:
            whole[name.removesuffix(".txt")] = text.read()
    return TEMPLATES | whole


_OTHER = np.array([not chr(i).isalnum() if i < 128 else False for i in range(256)])
_PLACES = np.random.default_rng(40).integers(0, 2**64, RUN, dtype=np.uint64) | np.uint64(1)


def rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(x), piles.append(i)
        else:
            tops[k], piles[k] = x, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def _once(words: list, lo: int, hi: int) -> dict:
    """Word to place, for words that occur once in the range."""
    found: dict = {}
    for i in range(lo, hi):
        found[words[i]] = -1 if words[i] in found else i
    return {w: i for w, i in found.items() if i >= 0}


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places (text, template), rising in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = _once(text, a, b), _once(template, c, d)
        both = sorted((i, there[w]) for w, i in here.items() if w in there)
        anchors = [both[k] for k in rising([j for _, j in both])]
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if p + 1 < r and q + 1 < s]
    return sorted(out)


def common(words: list, places: dict, size: int) -> Iterator[int]:
    """Longest common subsequence of a template and each prefix of ``words``, bit-parallel.

    ``places`` holds the template's places by word, as bits of a number.
    """
    full = rest = (1 << size) - 1
    n = 0
    for word in words:
        if at := places.get(word):
            here = rest & at
            rest = ((rest + here) | (rest - here)) & full
            n = size - rest.bit_count()
        yield n


def _reach(lengths: Iterator[int]) -> int:
    """Words of the prefix that is worth most, a match counting ``WIDE`` and each word minus one."""
    return max(((WIDE * n - k, k) for k, n in enumerate(lengths, 1)), default=(0, 0))[1]


def windows(words: list, template: list) -> Iterator[tuple[int, int, int]]:
    """Begin, end and common subsequence of each occurrence, one behind the other."""
    size = len(template)
    least, wide = math.ceil(LEAST * size), WIDE * size
    ahead: dict = {}
    for i, word in enumerate(template):
        ahead[word] = ahead.get(word, 0) | 1 << i
    back = {word: int(f"{at:0{size}b}"[::-1], 2) for word, at in ahead.items()}
    floor = at = 0
    while size:
        # the first end of a window with enough words, and the last begin of one with that end
        end = next((k for k, n in enumerate(common((words[i] for i in range(at, len(words))), ahead, size), at + 1) if n >= least), None)
        if end is None:
            return
        begin = next(end - k for k, n in enumerate(common(words[at:end][::-1], back, size), 1) if n >= least)
        if end - begin > wide:
            at = begin + 1
            continue
        end = max(end, begin + _reach(common(words[begin : begin + wide], ahead, size)))
        lengths = list(common(words[max(floor, end - wide) : end][::-1], back, size))
        k = _reach(iter(lengths))
        yield end - k, end, lengths[k - 1]
        floor = at = end


def _runs(words: np.ndarray) -> np.ndarray:
    n = max(len(words) - RUN + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(RUN if n else 0):
        out += words[k : k + n] * _PLACES[k]
    return mix(out)


def _bits(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(texts.fill_null("")), fold=False, separator=_OTHER)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words, counts = _hashes(pa.array(list(templates.values()), pa.string()))
        ends = np.cumsum(counts)
        self.words = [words[a:b] for a, b in zip(ends - counts, ends, strict=True)]
        self.runs = [np.unique(_runs(w)) for w in self.words]
        self.all = np.unique(np.concatenate(self.runs))
        self.vocabulary = np.unique(words)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[_bits(self.vocabulary)] = True
        #: Times that a template holds each word of the vocabulary.
        self.times = [np.bincount(np.searchsorted(self.vocabulary, w), minlength=len(self.vocabulary)) for w in self.words]

    def spans(self, words: np.ndarray, counts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By document, (template, begin, end) of the regions that share enough words with a template."""
        hits = np.flatnonzero(self.bits[_bits(words)])
        word = np.minimum(np.searchsorted(self.vocabulary, words[hits]), len(self.vocabulary) - 1)
        same = self.vocabulary[word] == words[hits]
        hits, word = hits[same], word[same]
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, hits, "right")
        # documents lie so far apart that no window reaches from one to the next
        apart = WIDE * max(map(len, self.words)) + 1
        place = hits + doc * apart
        order = np.argsort(word, kind="stable")
        all_words, all_places = word[order], place[order]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for t, (template, times) in enumerate(zip(self.words, self.times, strict=True)):
            wide, own = WIDE * len(template), times[word] > 0
            # a document with fewer of its words than a window needs has no window
            enough = np.bincount(doc[own], minlength=len(counts)) >= LEAST * len(template)
            if not enough.any():
                continue
            own &= enough[doc]
            at, own_doc = place[own], doc[own]
            by_word, by_place = all_words[own[order]], all_places[own[order]]
            # a word at p counts for begins b with p - wide < b <= p that leave fewer of the same between than the template has
            several, after = times[by_word], []
            for n in np.unique(times[times > 0]).tolist():
                k = np.flatnonzero(several == n)
                before = np.where((k >= n) & (by_word[np.maximum(k - n, 0)] == by_word[k]), by_place[k - n * (k >= n)], -1)
                after.append(np.maximum(before, by_place[k] - wide))
            shared = np.searchsorted(np.sort(np.concatenate(after)), at, "left") - np.arange(len(at))
            good = np.flatnonzero(shared >= LEAST * len(template))
            if not len(good):
                continue
            for some in np.split(good, np.flatnonzero(np.diff(at[good]) > wide) + 1):
                d = int(own_doc[some[0]])
                first = int(ends[d] - counts[d])
                lo, hi = (int(at[i]) - d * apart - first for i in (some[0], some[-1]))
                out.setdefault(d, []).append((t, lo, min(hi + wide, int(counts[d]))))
        return out

    def regions(self, words: np.ndarray, places: np.ndarray, runs: np.ndarray, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
        """(license, matched, template words, first and last + 1 word) of one text, whose runs that any template has stand at ``places``."""
        for t, (name, template, own) in enumerate(zip(self.names, self.words, self.runs, strict=True)):
            if len(words) < LEAST * len(template):
                continue
            found = [x for k, lo, hi in spans if k == t for x in self._windows(words, template, lo, hi)]
            yield from ((name, matched, len(template), a, b) for matched, a, b in found)
            at = places[np.isin(runs, own)]
            if not len(at):
                continue
            for hits in np.split(at, np.flatnonzero(np.diff(at) > len(template)) + 1):
                first, last = int(hits[0]), int(hits[-1]) + RUN
                lo, hi = max(0, first - len(template)), min(len(words), last + len(template))
                if any(a < hi and b > lo for _, a, b in found):
                    continue
                # the region's own words first: what is around them only where they don't reach
                for a, b in ((first, last), (lo, hi)):
                    pairs = align(words[a:b].tolist(), template.tolist())
                    if len(pairs) >= LEAST * len(template):
                        yield name, len(pairs), len(template), a + pairs[0][0], a + pairs[-1][0] + 1
                        break

    @staticmethod
    def _windows(words: np.ndarray, template: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        for a, b, n in windows(words[lo:hi].tolist(), template.tolist()):
            pairs = align(words[lo + a : lo + b].tolist(), template.tolist())
            if len(pairs) >= LEAST * len(template):
                yield len(pairs), lo + a + pairs[0][0], lo + a + pairs[-1][0] + 1
            else:
                yield n, lo + a, lo + b

    def rows(self, texts: pa.Array) -> list[tuple[int, str, int, int, int, int]]:
        """The regions of all texts, each with the text's place before it."""
        words, counts = _hashes(texts)
        ends = np.cumsum(counts)
        runs = _runs(words)
        spans = self.spans(words, counts)
        hits = np.flatnonzero(np.isin(runs, self.all))
        hits = hits[hits + RUN <= ends[np.searchsorted(ends, hits, "right")]]
        out = []
        for doc in sorted({*np.searchsorted(ends, hits, "right").tolist(), *spans}):
            a, b = int(ends[doc] - counts[doc]), int(ends[doc])
            own = hits[np.searchsorted(hits, a) : np.searchsorted(hits, b)]
            out += [(doc, *x) for x in best(self.regions(words[a:b], own - a, runs[own], spans.get(doc, [])))]
        return out


def best(regions: Iterable[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Of overlapping (license, matched, template words, begin, end) the best, by begin."""
    kept: list[tuple[str, int, int, int, int]] = []
    begins: list[int] = []
    for one in sorted(regions, key=lambda r: (-r[1], r[2], r[3], r[0])):
        at = bisect_left(begins, one[4])
        if not at or kept[at - 1][4] <= one[3]:
            kept.insert(at, one)
            begins.insert(at, one[3])
    return kept


FOUND = "doc_id long, license string, n_matched long, coverage double, start_word long, end_word long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each region of a document that a license template covers, ``all_templates`` if none are given."""
    held = docs.sparkSession.sparkContext.broadcast(templates or all_templates())
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held.value)
        for batch in batches:
            for some in steps(batch):
                rows = [(doc, name, matched, matched / size, start, end) for doc, name, matched, size, start, end in scanner.rows(some["text"])]
                if rows:
                    doc, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([some["doc_id"].take(pa.array(doc)), *(pa.array(x) for x in rest)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
