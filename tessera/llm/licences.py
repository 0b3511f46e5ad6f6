"""License scans (operator 10): patience alignment of license templates with documents.

A finding is a stretch of text, at most `STRETCH` times as long as a template, whose words match `LEAST_COVERAGE` of the
template's in order; words strewn wider are no notice.  The template's three-word runs point at places that may hold it.
Where words were put in or changed, so that no run is left, places come from single words: a finding matches all but a
fifth of the template's, so it holds one of the longest fifth + 1 (the gate), enough of them stand within a stretch (the
density), and enough of the template's neighbours stand near each other in their order, since only so many can be parted
by what a stretch holds besides.  None of the three loses a finding.  In a place, words that occur once in the
text part and once in the template part are anchors; the longest increasing subsequence of anchors is kept, equal words
next to them are taken along, and the gaps between are aligned the same way.  Matched template words by all template
words is the coverage.  Where findings overlap, the one with most matched words
stays (then higher coverage, then the template's name).  A finding also needs its template's distinguishing words (a
version, Lesser, Affero) among the matched ones, and none that tells another license (`OTHERS`) put in between.

Defined results: a null text has no words and no findings; equal texts get equal findings; a template without words is
never found; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T

LEAST_COVERAGE = 0.8
SEED_WORDS = 3
#: How many times as long as its template a finding may be; how far apart a template's neighbours count as near.
STRETCH, NEAR = 2, 4
#: Templates of more words are first held against the words of the place, whatever their order, and are looked for at every
#: half of their length instead of every word.
SMALL = 50

#: License notices as their publishers word them (fixed values).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
}


_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(what: str, name: str, version: str, end: str) -> str:
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {what}{end}"


_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_GPL, _LESSER, _LIBRARY, _AFFERO = "GNU General Public License", "GNU Lesser General Public License", "GNU Library General Public License", "GNU Affero General Public License"
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": TEMPLATES["ISC"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause": f"{_BSD}{_ENDORSE} {_AS_IS}",
    "GPL-2.0-or-later": _gnu("program", _GPL, "2", _WRITE),
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.0-or-later": _gnu("library", _LIBRARY, "2", _WRITE),
    "LGPL-2.1-or-later": _gnu("library", _LESSER, "2.1", _WRITE),
    "LGPL-3.0-or-later": _gnu("library", _LESSER, "3", _SEE),
    "AGPL-3.0-or-later": _gnu("program", _AFFERO, "3", _SEE),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Words of which a template needs one match each, besides its coverage.
REQUIRED = {
    "Apache-2.0-line": "2", "Apache-2.0": "2", "GPL-2.0-line": "2", "GPL-3.0-line": "3", "GPL-2.0-only": "2", "GPL-2.0-or-later": "2 later", "GPL-3.0-or-later": "3 later", "LGPL-2.0-or-later": "library 2 later", "LGPL-2.1-or-later": "lesser 2 1 later",
    "LGPL-3.0-or-later": "lesser 3 later", "AGPL-3.0-or-later": "affero 3 later", "BSD-3-Clause": "neither endorse", "MPL-2.0": "mozilla 2", "EPL-1.0": "eclipse v1", "EPL-2.0": "eclipse 2", "CC-BY-4.0-line": "attribution 4", "CC-BY-NC-4.0-line": "nc 4", "BSL-1.0-line": "boost 1",
}
_LONG = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _s in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"):
    _parts = _s.split("-")
    for _name, _text, _words in ((f"CC-{_s}-4.0-line" if _s != "BY" else "CC-BY-4.0-short", f"Licensed under CC {_s} 4.0.", _parts), (f"CC-{_s}-4.0-notice" if _s != "BY" else "CC-BY-4.0-line", f"This work is licensed under a Creative Commons {'-'.join(_LONG[x] for x in _parts)} 4.0 International License.", [_LONG[x] for x in _parts])):
        TEMPLATES[_name], REQUIRED[_name] = _text, " ".join(_words).lower() + " 4"
#: Whole license texts; their findings end in -text.
for _path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[f"{_path.stem}-text"] = _path.read_text(encoding="utf-8")
#: Words that, put in between a template's, tell another license of its family.
OTHERS = {"GPL": "lesser affero", "LGPL": "affero", "CC-": "sa nc nd sharealike noncommercial noderivatives", "BSD-2": "endorse"}


class Finding(NamedTuple):
    license: str
    start: int
    end: int
    matched: int
    coverage: float


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list, b: list, open_ends: bool = False, least: int = 0) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both.  Equal words at an end are taken along, unless the end is
    open: a may then go on into other text there.  Nothing, as soon as fewer than `least` can be matched: what is matched
    and what the shorter sides of the gaps hold."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    can = min(len(a), len(b))
    while todo:
        if can < least:
            return []
        a0, a1, b0, b1 = todo.pop()
        can -= min(a1 - a0, b1 - b0)
        done = len(pairs)
        left, right = not (open_ends and a0 == 0), not (open_ends and a1 == len(a))
        while left and a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while right and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 < a1 and b0 < b1:
            once = Counter(a[a0:a1])
            in_b = Counter(b[b0:b1])
            place = {w: j for j, w in enumerate(b[b0:b1], b0)}
            anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once[w] == 1 and in_b.get(w) == 1]
            kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
            pairs += kept
            if kept:
                for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
                    if i + 1 < k and j + 1 < m:
                        todo.append((i + 1, k, j + 1, m))
                        can += min(k - i, m - j) - 1
        can += len(pairs) - done
    return sorted(pairs) if can >= least else []


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return T.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


class Scanner:
    """Templates and the hashes of their seeds."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE) -> None:
        self.names, self.least = sorted(templates), least
        self.number = {n: t for t, n in enumerate(self.names)}
        w = T.words(pa.array([templates[n] for n in self.names], pa.large_string()), T.ALNUM, lower=True)
        self.words = [w.hash[a:b].tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        self.sizes, self.vocabulary = w.counts(), [np.unique(w.hash[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        code = lambda words: T.words(pa.array([words], pa.large_string()), T.ALNUM, lower=True).hash.tolist()
        known = [n if templates[n] == TEMPLATES.get(n) else "" for n in self.names]
        self.required = [code(REQUIRED.get(n, "")) for n in known]
        self.others = [set(code(" ".join(v for k, v in OTHERS.items() if n.startswith(k)))) for n in known]
        width = np.minimum(SEED_WORDS, w.counts())
        seeds = []
        for t, (a, n, k) in enumerate(zip(w.bounds, w.counts(), width)):
            at = np.arange(a, a + n - k + 1) if n else np.zeros(0, np.int64)
            own = T.grams(w.hash, int(k), at)
            # A run that the template repeats would point at wrong places.
            values, count = np.unique(own, return_counts=True)
            once = np.isin(own, values[count == 1])
            use = once if once.any() else ~once
            seeds += [(int(h), t, int(i - a), int(k)) for h, i in zip(own[use], at[use])]
        seeds.sort()
        self.seed = np.array([s[0] for s in seeds], np.uint64)
        self.entry = np.array([s[1:] for s in seeds], np.int64).reshape(-1, 3)
        self.widths = sorted({s[3] for s in seeds})
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.seed & np.uint64(0xFFFFF)] = True
        # A finding lacks at most `spare` words, so it holds one of any spare + 1: the longest, here, words that the
        # template has once before others.
        self.most = [int(np.ceil(self.least * n - 1e-9)) for n in self.sizes]
        gates = []
        for t, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
            times = Counter(w.hash[a:b].tolist())
            rare = sorted(range(a, b), key=lambda i: (times[int(w.hash[i])], w.start[i] - w.end[i], i))[: b - a - self.most[t] + 1]
            gates += sorted({(int(w.hash[i]), t) for i in rare})
        gates.sort()
        # Of a template's pairs of neighbours at most two are lost with each word that a finding lacks, and of the others those
        # that stand apart fill the stretch between them.
        self.pairs = [np.unique(_pair(w.hash[a : b - 1], w.hash[a + 1 : b])) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
        self.near = [int(n) - 1 - 2 * (int(n) - m) - (STRETCH * int(n) - 1) // (NEAR + 1) for n, m in zip(self.sizes, self.most)]
        self.gate, self.gated = np.array([g for g, _ in gates], np.uint64), np.array([t for _, t in gates], np.int64)
        self.open = np.zeros(1 << 20, bool)
        self.open[self.gate & np.uint64(0xFFFFF)] = True

    def dense(self, w: T.Words, found: dict[tuple[int, int], list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, int]]:
        """(row, template, first word, end) of the stretches that may hold a template beside what is found already: (row,
        template) to places."""
        at = np.flatnonzero(self.open[w.hash & np.uint64(0xFFFFF)])
        low, high = np.searchsorted(self.gate, w.hash[at]), np.searchsorted(self.gate, w.hash[at], "right")
        n = high - low
        t = self.gated[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for row, t in np.unique(np.column_stack([np.repeat(w.rows()[at], n), t]), axis=0).tolist():
            a, b = int(w.bounds[row]), int(w.bounds[row + 1])
            size, most = int(self.sizes[t]), self.most[t]
            if b - a < most:
                continue
            mine = np.isin(w.hash[a:b], self.vocabulary[t])
            for x, y in found.get((row, t), ()):
                mine[x - a : y - a] = False
            held = np.flatnonzero(mine)
            if len(held) < most:
                continue
            # How much each stretch holds, by its first word: a stretch is as long as a finding may be.
            ends = np.minimum(np.arange(b - a) + STRETCH * size, b - a)
            within = lambda flags: (sums := np.concatenate([[0], np.cumsum(flags)]))[ends] - sums[:-1]
            full = within(mine) >= most
            if self.near[t] > 0 and full.any():
                near = np.zeros(b - a, bool)
                for d in range(1, NEAR + 1):
                    one = held[held + d < b - a]
                    one = one[mine[one + d]]
                    near[one] |= np.isin(_pair(w.hash[a + one], w.hash[a + one + d]), self.pairs[t])
                full &= within(near) >= self.near[t]
            # Longer templates are tried once a step, with room for what starts within it.
            step = 1 if size <= SMALL else size // 2
            before = -step
            for x in np.flatnonzero(full).tolist():
                if x - before >= step:
                    before = x
                    yield row, t, a + x, min(a + x + STRETCH * size + step - 1, b)

    def regions(self, w: T.Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, template, first word, end) of the places that seeds point at, seeds near each other as one."""
        rows = w.rows()
        found = []
        for width in self.widths:
            at = T.starts(w.bounds, width)
            h = T.grams(w.hash, width, at)
            near = self.maybe[h & np.uint64(0xFFFFF)]
            at, h = at[near], h[near]
            low, high = np.searchsorted(self.seed, h), np.searchsorted(self.seed, h, "right")
            n = high - low
            e = self.entry[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at, ok = np.repeat(at, n), e[:, 2] == width
            found.append(np.column_stack([rows[at], e[:, 0], at - e[:, 1]])[ok])
        hits = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
        if not len(hits):
            return
        size = self.sizes[hits[:, 1]]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, :2] != hits[:-1, :2]).any(1) | (hits[1:, 2] - hits[:-1, 2] > np.maximum(2, size[1:] // 4))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(hits)) - 1
        row, t, start, end, size = hits[at, 0], hits[at, 1], hits[at, 2], hits[last, 2] + size[at], size[at]
        # Places that hold fewer words than a finding needs matched.
        room = np.minimum(end + 2 + size // 4, w.bounds[row + 1]) - np.maximum(start - 2 - size // 4, w.bounds[row])
        for i in np.flatnonzero(room >= self.least * size).tolist():
            yield int(row[i]), int(t[i]), int(start[i]), int(end[i])

    def _enough(self, t: int, a: list[int], pairs: list[tuple[int, int]]) -> bool:
        """Whether the matches of a place are a finding."""
        return len(pairs) >= max(1, self.most[t]) and pairs[-1][0] - pairs[0][0] < STRETCH * len(self.words[t]) and self._tells(t, a, pairs)

    def _tells(self, t: int, a: list[int], pairs: list[tuple[int, int]]) -> bool:
        """Whether the template's distinguishing words are matched, and no other license's stand in between."""
        if not self.required[t] and not self.others[t]:
            return True
        matched = {self.words[t][j] for _, j in pairs}
        own = {i for i, _ in pairs}
        return all(x in matched for x in self.required[t]) and not any(a[i] in self.others[t] for i in range(pairs[0][0], pairs[-1][0]) if i not in own)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[Finding]]]:
        """Words of each text, and its findings in order."""
        w = T.words(texts, T.ALNUM, lower=True)
        all_found: list[list[Finding]] = [[] for _ in range(len(texts))]
        for row, t, start, end in self.regions(w):
            low, high, size = int(w.bounds[row]), int(w.bounds[row + 1]), len(self.words[t])
            slack = 2 + size // 4
            inside = w.hash[max(start - slack, low) : min(end + slack, high)]
            if size > SMALL and np.isin(inside, self.vocabulary[t]).sum() < self.least * size:
                continue
            # With some room around, where words may have been put in; or just the place, whose ends are the template's.
            for room in (slack, 0):
                a, b = max(start - room, low), min(end + room, high)
                part = w.hash[a:b].tolist()
                pairs = align(part, self.words[t], room > 0, self.most[t])
                if self._enough(t, part, pairs):
                    all_found[row].append(Finding(self.names[t], a - low + pairs[0][0], a - low + pairs[-1][0] + 1, len(pairs), len(pairs) / size))
        places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for row, found in enumerate(all_found):
            for f in found:
                places.setdefault((row, self.number[f.license]), []).append((f.start + int(w.bounds[row]), f.end + int(w.bounds[row])))
        for row, t, start, end in self.dense(w, places):
            low, size = int(w.bounds[row]), len(self.words[t])
            part = w.hash[start:end].tolist()
            pairs = align(part, self.words[t], True, self.most[t])
            if self._enough(t, part, pairs):
                all_found[row].append(Finding(self.names[t], start - low + pairs[0][0], start - low + pairs[-1][0] + 1, len(pairs), len(pairs) / size))
        for row, found in enumerate(all_found):
            kept: list[Finding] = []
            starts: list[int] = []
            for f in sorted(set(found), key=lambda f: (-f.matched, -f.coverage, f.license, f.end - f.start, f.start)):
                at = bisect_left(starts, f.start)
                if (not at or kept[at - 1].end <= f.start) and (at == len(kept) or f.end <= kept[at].start):
                    kept.insert(at, f)
                    starts.insert(at, f.start)
            all_found[row] = kept
        return w.counts(), all_found


def scan(documents: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, n_words and findings (license, first word, end, matched words, coverage) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))
        for batch in batches:
            for part in T.slices(batch, "text"):
                counts, found = shared.value.scan(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array([[f._asdict() for f in x] for x in found], kind)], ["doc_id", "n_words", "findings"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, findings array<struct<license:string,start:long,end:long,matched:long,coverage:double>>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings of every document: how many, which, the words they cover and the best coverage."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_words", F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"]))), ",").alias("licenses"),
        F.aggregate("findings", F.lit(0).cast("long"), lambda s, f: s + f["matched"]).alias("matched_words"),
        F.round(F.coalesce(F.array_max(F.transform("findings", lambda f: f["coverage"])), F.lit(0.0)), 6).alias("coverage"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"))), ",").alias("places"),
    )
