"""License scans by template-markup matching.

A template is a whole license, its granting sentence, or the line by which a work names it, with markup:
``<<beginOptional>> ... <<endOptional>>`` around words
that may be absent, and ``<<var;most=N>>`` for a region of up to N words that may be replaced.  It is
compiled to an automaton over words; the automaton is started at every place of a text where one of
its possible first words stands, and accepts where all mandatory words have matched exactly in order.

Beside that the base phrases are found wherever their words stand consecutively.

Defined cases: a null or wordless text has no words, no places (first_word and last_word are null),
no labels and score 0; repeated rows are judged each on its own; an empty table gives an empty
result; further columns are not read; whole texts are searched, whatever their length.  Words beside a
license change nothing in what is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, LOWER, no_null, pieces, utf8, word_hashes, word_spans

_LOW = {c: c + 32 for c in range(65, 91)}

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: The whole wording of licenses and of the notices that are to stand in files, with the markup above.
LICENSES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;most=8>> to deal in the <<var;most=3>> without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;most=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;most=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL <<var;most=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0bsd", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND
<<var;most=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;most=8>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;most=1>> Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;most=1>> Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;most=1>> Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;most=1>> Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<var;most=1>> Neither the name of <<var;most=12>> may be used to endorse or promote
products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will <<var;most=8>> be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var;most=1>> The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. <<var;most=1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var;most=1>> This notice may not be removed or altered from
any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE
IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL <<var;most=8>> BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;most=4>> except in compliance with the License. You may obtain a copy of the License at <<var;most=8>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <<var;most=1>>
of the License, or (at your option) any later version. <<var;most=8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version
<<var;most=2>> of the License, or (at your option) any later version. <<var;most=8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl", """is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version
<<var;most=1>> of the License, or (at your option) any later version. <<var;most=8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""),
)

#: The sentence in which a license grants its rights, and the lines by which a work names its license.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;most=8>> to deal in the <<var;most=3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    ("isc", "Permission to use, copy, modify, and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "Licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Released under the Apache License <<beginOptional>>Version<<endOptional>> 2.0"),
    ("apache-2.0", "Apache License <<beginOptional>>Version<<endOptional>> 2.0"),
    ("gpl", "Licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>, version <<var;most=1>><<endOptional>>"),
    ("gpl", "under the terms of the GNU General Public License"),
    ("lgpl", "GNU <<beginOptional>>Library or<<endOptional>> Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "Mozilla Public License <<beginOptional>>Version<<endOptional>> <<beginOptional>>v<<endOptional>> 2.0"),
    ("cc-by-nc", "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<var;most=2>>"),
    ("cc-by-nc", "Creative Commons Attribution <<beginOptional>>Non-Commercial<<endOptional>> <<beginOptional>>NonCommercial<<endOptional>> <<var;most=2>> License"),
    ("cc-by-sa", "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA <<var;most=2>>"),
    ("cc-by", "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY 4.0"),
    ("cc0", "CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    ("all-rights-reserved", "All rights reserved"),
)
TEMPLATES = LICENSES + NOTICES

#: Fewer mandatory words than that are no evidence of an incomplete template: "all of us" is not a third of a notice.
LEAST = 2

_MARK = re.compile(r"<<(beginoptional|endoptional|var;most=(\d+))>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")


class Automaton:
    """States 0 .. end, held as bits: from a state, a word leads on (``on``), any word does (``any``), or nothing is
    read (``open``: all states that are reached so)."""

    def __init__(self, markup: str) -> None:
        step: list[str | None] = []
        skip: list[list[int]] = [[]]
        opened: list[int] = []
        self.need = [0]

        def add(word: str | None) -> None:
            step.append(word)
            skip.append([])
            self.need.append(self.need[-1] + (word is not None and not opened))

        low, at = markup.translate(_LOW), 0
        for m in _MARK.finditer(low):
            if "<<" in low[at : m.start()]:
                raise ValueError(f"unknown mark: {markup[at : m.end()]}")
            at = m.end()
            if m[3]:
                add(m[3])
            elif m[2]:
                start = len(step)
                for _ in range(int(m[2])):
                    add(None)
                for k in range(start, len(step)):
                    skip[k].append(len(step))
            elif m[1] == "beginoptional":
                opened.append(len(step))
            elif opened:
                skip[opened.pop()].append(len(step))
            else:
                raise ValueError(f"unbalanced markup: {markup}")
        if opened:
            raise ValueError(f"unbalanced markup: {markup}")
        self.end = len(step)
        self.open = [1 << s for s in range(self.end + 1)]
        for s in range(self.end, -1, -1):
            for t in skip[s]:
                self.open[s] |= self.open[t]
        self.skips = sum(1 << s for s in range(self.end + 1) if skip[s])
        self.any = sum(1 << s for s, w in enumerate(step) if w is None)
        self.on: dict[str, int] = {}
        for s, w in enumerate(step):
            if w is not None:
                self.on[w] = self.on.get(w, 0) | 1 << s
        if self.open[0] & (self.any | 1 << self.end):
            raise ValueError(f"a template must begin with a word: {markup}")
        self.first = {w for w, states in self.on.items() if states & self.open[0]}

    def run(self, words: list[str], at: int) -> tuple[bool, int]:
        """Whether the template matches from there, and how many of its mandatory words do."""
        states, top = self.open[0], 0
        while states:
            top = max(top, states.bit_length() - 1)  # no later state has fewer mandatory words behind it
            if states >> self.end:
                return True, self.need[-1]
            if at == len(words):
                break
            states = (states & (self.on.get(words[at], 0) | self.any)) << 1
            more = states & self.skips
            while more:
                low = more & -more
                states |= self.open[low.bit_length() - 1]
                more ^= low
            at += 1
        return False, self.need[top]


@cache
def automata() -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(markup)) for label, markup in TEMPLATES)


def _hash(words: list[str]) -> np.ndarray:
    data, off = utf8(pa.array(words, pa.string()))
    return word_hashes(data, off[:-1], off[1:])


@cache
def _gate() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of which a text to look at has one: the phrases' last words and the templates' possible first
    ones.  Where none is, no phrase stands, no automaton is ever started, and :func:`scan` gives nothing and 0."""
    need = {p.split()[-1] for p, _ in PHRASES}.union(*(a.first for _, a in automata()))
    value = np.sort(_hash(sorted(need)))
    gate = np.zeros(1 << 16, bool)
    gate[(value & np.uint64(0xFFFF)).astype(np.int64)] = True
    return value, gate


def scan(words: list[str]) -> tuple[list[int], set[str], set[str], float]:
    """Starts of the base phrases, their labels, the templates' labels, and the score: 1 with a template's label, else the
    best share of a template's mandatory words, of which ``LEAST`` must stand in order."""
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    places, base, more, best = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        p = phrase.split()
        found = [i for i in where.get(p[0], ()) if words[i : i + len(p)] == p]
        places += found
        if found:
            base.add(label)
    for label, a in automata():
        if label in more:
            continue
        for i in sorted(i for w in a.first for i in where.get(w, ())):
            full, matched = a.run(words, i)
            if full:
                more.add(label)
                best = 1.0
                break
            if matched >= LEAST:
                best = max(best, matched / a.need[-1])
    return sorted(places), base, more, best


def scan_texts(texts: pa.Array) -> tuple[np.ndarray, list]:
    """The number of words of each text, and :func:`scan`'s result for those with a word that any match, whole or in part, needs."""
    data, off = utf8(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, ALNUM)
    found: list = [None] * len(texts)
    h = word_hashes(data, starts, ends)
    value, gate = _gate()
    maybe = np.flatnonzero(gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
    maybe = maybe[np.isin(h[maybe], value)]
    for r in np.unique(np.searchsorted(first, maybe, "right") - 1).tolist():
        raw = data[off[r] : off[r + 1]].tobytes()
        spans = zip((starts[first[r] : first[r + 1]] - off[r]).tolist(), (ends[first[r] : first[r + 1]] - off[r]).tolist())
        found[r] = scan([raw[a:b].decode() for a, b in spans])
    return np.diff(first), found


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, places (word starts of base phrases, ascending), base (labels), templates (labels
    of accepted templates), score (1 where a template is accepted, else the best share of mandatory words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            n_words, found = scan_texts(part.column("text"))
            found = [x or ([], set(), set(), 0.0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(n_words, pa.int64()), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([sorted(x[1]) for x in found], pa.list_(pa.string())), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())), pa.array([x[3] for x in found], pa.float64())],
                ["key", "n_words", "places", "base", "templates", "score"],
            )

    return no_null(docs, key, text).mapInArrow(run, "key bigint, n_words bigint, places array<bigint>, base array<string>, templates array<string>, score double")
