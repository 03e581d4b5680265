"""License scans by patience alignment.

Words that are unique to both the text's region and the template are anchors; the longest increasing subsequence of
their places is kept, and the gaps between kept anchors are aligned in the same way. A gap without anchors gets a longest
common subsequence, of any size, computed on bit vectors. Coverage is the share of the template's words that are aligned.

What is aligned is a window. A text is passed over for a template unless, within two lengths of the template, it has the
wanted share of the template's words in any order, and then in their order: both are exact conditions of a hit. Windows
are taken in the order in which they end; each is stretched to where more words of the template stop paying for the
words between them, and the scan goes on behind it. So repeated copies, and copies amid words of the template, are all
met, and hits of a template don't overlap.

Defined results: null, empty and wordless texts, and rows without an id, are scanned like any other; very long texts are
scanned whole; of windows that end together the shortest is taken; rows that repeat an id are scanned one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices as the licenses' publishers word them, and the usual one-line references.
TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT (full text)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC (full text)": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause (full text)": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "MIT (reference)": "Released under the MIT License.",
    "Apache-2.0 (reference)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (reference)": "This work is licensed under the GNU General Public License, version 3.",
    "BSD (reference)": "Distributed under the BSD License.",
    "CC-BY-4.0 (reference)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (reference)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (reference)": "Licensed under CC BY-NC 4.0.",
}

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: What a word between aligned words costs a window, in aligned words.
BETWEEN = 0.25


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    ends, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        back[i] = at[k - 1] if k else -1
        ends[k:k + 1], at[k:k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _masks(words: list[str]) -> dict[str, int]:
    """For each word the bits of its places."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, in `a` as early as can be. Bit j of row i is 0 where b's place j adds to the length over the first i words of `a`."""
    masks, full = _masks(b), (1 << len(b)) - 1
    rows = [full]
    for w in a:
        v = rows[-1]
        u = v & masks.get(w, 0)
        rows.append((v + u | v - u) & full)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _common_late(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, in `a` as late as can be."""
    return [(len(a) - 1 - i, len(b) - 1 - j) for i, j in reversed(_common(a[::-1], b[::-1]))]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned word places (in text, in template), increasing in both."""
    pairs, stack = [], [(0, len(text), 0, len(template))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_b = {w for w, n in Counter(template[b0:b1]).items() if n == 1}
        places: dict[str, int] = {}
        for i in range(a0, a1):
            if text[i] in once_b:
                places[text[i]] = -1 if text[i] in places else i
        anchors = [(places[template[j]], j) for j in range(b0, b1) if places.get(template[j], -1) >= 0]
        anchors = [anchors[k] for k in _increasing([i for i, _ in anchors])]
        if anchors:
            pairs += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            stack += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
        else:
            common = _common if b1 == len(template) else _common_late  # close to what is aligned already
            pairs += [(a0 + i, b0 + j) for i, j in common(text[a0:a1], template[b0:b1])]
    return sorted(pairs)


class Template:
    """A template's words, and what finding them takes."""

    def __init__(self, name: str, text: str, min_coverage: float):
        self.name, self.words = name, _WORD.findall(text.lower())
        self.size, self.counts = len(self.words), Counter(self.words)
        self.need = max(1, math.ceil(min_coverage * self.size - 1e-9))
        self.forward, self.backward = _masks(self.words), _masks(self.words[::-1])
        self.full = (1 << self.size) - 1

    def lengths(self, words: Iterable[str], masks: dict[str, int]) -> Iterator[int]:
        """Length of the longest common subsequence after each word."""
        v, full = self.full, self.full
        for w in words:
            u = v & masks[w]
            v = (v + u | v - u) & full
            yield self.size - v.bit_count()

    def regions(self, words: list[str], at: list[int]) -> list[tuple[int, int]]:
        """Ranges of the words that, in any order, hold enough words of the template within two lengths; `at` has their places in the text."""
        have, matched, lo, out = Counter(), 0, 0, []
        for hi, w in enumerate(words):
            have[w] += 1
            matched += have[w] <= self.counts[w]
            while at[hi] - at[lo] >= 2 * self.size:
                matched -= have[words[lo]] <= self.counts[words[lo]]
                have[words[lo]] -= 1
                lo += 1
            if matched >= self.need:
                if out and lo <= out[-1][1]:
                    out[-1] = (out[-1][0], hi + 1)
                else:
                    out.append((lo, hi + 1))
        return out

    def window(self, words: list[str], at: list[int], a: int, b: int) -> tuple[int, int] | None:
        """The first-ending range in a..b that holds enough words of the template in order within two lengths; of those the shortest.

        What starts in a quarter of a length lies in the two lengths and a quarter from there, so these are searched one after the other, and the
        work is in proportion to the text."""
        step = max(1, self.size // 4)
        while a < b:
            stop = bisect_left(at, at[a] + 2 * self.size + step, a, b)
            if found := self._window_in(words, at, a, stop):
                return found
            if stop >= b:
                return None
            a = bisect_left(at, at[a] + step, a, b)
        return None

    def _window_in(self, words: list[str], at: list[int], a: int, b: int) -> tuple[int, int] | None:
        while True:
            end = next((a + k for k, n in enumerate(self.lengths(words[a:b], self.forward)) if n >= self.need), None)
            if end is None:
                return None
            start = next(end - k for k, n in enumerate(self.lengths(reversed(words[a : end + 1]), self.backward)) if n >= self.need)
            if at[end] - at[start] < 2 * self.size:
                return start, end
            a = start + 1  # a window that ends later, within two lengths, starts later

    def stretch(self, words: list[str], at: list[int], a: int, b: int, start: int, end: int) -> tuple[int, int]:
        """The window with the words after and before it that pay; it stays in a..b and within two lengths."""
        stop = next((k for k in range(end + 1, b) if at[k] - at[start] >= 2 * self.size), b)
        worth = [n - BETWEEN * (at[start + k] - at[start]) for k, n in enumerate(self.lengths(words[start:stop], self.forward))]
        end = max(range(end, stop), key=lambda k: (worth[k - start], -k))
        first = next((k + 1 for k in range(start - 1, a - 1, -1) if at[end] - at[k] >= 2 * self.size), a)
        worth = [n - BETWEEN * (at[end] - at[end - k]) for k, n in enumerate(self.lengths(reversed(words[first : end + 1]), self.backward))]
        # The stretched window may need less of its beginning.
        latest = next(end - k for k, n in enumerate(self.lengths(reversed(words[first : end + 1]), self.backward)) if n >= self.need)
        return max(range(first, latest + 1), key=lambda k: (worth[end - k], k)), end


def scan(text: str | None, templates: list[Template]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first, last, words aligned) of every hit, offsets in code points."""
    low = (text or "").lower()
    if len(low) != len(text or ""):  # a few letters change length; offsets must not
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = _WORD.findall(low)
    known = set(found)
    hits: list[tuple[str, float, int, int, int]] = []
    spans = None
    for t in templates:
        if sum(n for w, n in t.counts.items() if w in known) < t.need:
            continue
        at = [i for i, w in enumerate(found) if w in t.counts]
        words = [found[i] for i in at]
        for a, b in t.regions(words, at):
            while window := t.window(words, at, a, b):
                start, end = t.stretch(words, at, a, b, *window)
                pairs = patience(words[start : end + 1], t.words)
                if len(pairs) < t.need:  # anchors that were out of order can cost more than they give
                    pairs = _common(words[start : end + 1], t.words)
                spans = spans or [m.span() for m in _WORD.finditer(low)]
                first, last = at[start + pairs[0][0]], at[start + pairs[-1][0]]
                hits.append((t.name, len(pairs) / t.size, spans[first][0], spans[last][1], len(pairs)))
                a = end + 1
    return hits


def license_hits(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None, min_coverage: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, first, last, n_words: a row per hit."""
    wanted = dict(templates or TEMPLATES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [Template(name, t, min_coverage) for name, t in wanted.items()]
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in scan(t, compiled)]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "coverage", "first", "last", "n_words"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(task, "doc_id long, license string, coverage double, first int, last int, n_words int")
