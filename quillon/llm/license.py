"""License scans by template markup.

Templates are written in the markup of the public SPDX matching guidelines: optional regions between
``<<beginOptional>>`` and ``<<endOptional>>``, which may be nested, and replaceable ones, ``<<var;name="n";original="o";
match="pattern">>``. Each is compiled to an automaton over words; a text is accepted where the mandatory wording occurs
exactly, in order, whatever case, punctuation and spacing. A replaceable region takes any words that, with single spaces
between them, match its pattern as a whole, regardless of case; patterns that count characters only (``.+``, ``.*``,
``.{m,n}``) are decided by lengths. Markup that is unknown, not closed or not opened is an error, never wording.

A template can only match where its longest run of mandatory words occurs, so the automaton runs on a text only if that
run is found in it, and starts only at words that can begin the template.

Words are maximal runs of a-z, 0-9 and characters outside ASCII, after lower-casing A-Z. The plan is one scan and one map
stage without a shuffle. Null text is the empty text: no words, no labels, score 0. Repeated rows give repeated results,
empty tables empty ones. Only id and text are read.

The score is 1 if a template matches, else 0.5 if only a base phrase occurs, else 0.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, raw_texts, read

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";
original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,300}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";original="this software
and associated documentation files";match=".{1,120}">> (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<var;name="bullet1";original="1.";match=".{0,3}">> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<var;name="bullet2";original="2.";match=".{0,3}">> Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_NAMES = """<<var;name="bullet3";original="3.";match=".{0,3}">> Neither the name of <<var;name="organization";original="the
copyright holder";match=".+">> nor the names of <<var;name="contributors";original="its";match="its|his|her|their|the">> contributors may be
used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name="provider";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted<<beginOptional>>, provided that the above copyright notice and this permission notice appear in all
copies<<endOptional>>."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var;name="author2";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL = """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU <<var;name="kind";original="";match=".{0,10}">> General
Public License <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version """

# Notices, and whole licence texts (names without "notice" or "grant"). The wording is that of the licences.
TEMPLATES = {
    "apache-2.0-notice": "<<beginOptional>>This work is<<endOptional>> Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at <<var;name="url";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,80}">>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "gpl-notice": _GPL + '<<var;name="version";original="3";match="[0-9][0-9 .]{0,6}">>',
    "gpl-3.0-notice": _GPL + "3",
    "gpl-2.0-notice": _GPL + "2",
    "mit-notice": "under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-grant": _GRANT,
    "mit-text": _GRANT + " " + _WARRANTY,
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": _BSD + " " + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD + " " + _BSD_NAMES + " " + _BSD_DISCLAIMER,
    "isc-grant": _ISC_GRANT,
    "isc-text": _ISC_GRANT + " " + _ISC_DISCLAIMER,
    "cc-by-notice": 'licensed under a Creative Commons Attribution <<var;name="kind";original="";match=".{0,40}">> License',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-grant": "This is free and unencumbered software released into the public domain",
}

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_TABLE = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MARK = re.compile(r"<<(?:(beginOptional|endOptional)|var((?:;\s*[a-z]+=(?:\"[^\"]*\"|[^;\">]*))*))>>")
_FIELD = re.compile(r";\s*([a-z]+)=(?:\"([^\"]*)\"|([^;\">]*))")
_LENGTHS = re.compile(r"\.(?:([+*])|\{(\d+),(\d*)\})")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Region:
    """What a replaceable region takes: the words between two places of a text."""

    def __init__(self, match: str):
        counted = _LENGTHS.fullmatch(match)
        self.pattern = None if counted else regex.compile(match, regex.I | regex.S)
        self.least, self.most = 0, None
        if counted and counted[1]:
            self.least = int(counted[1] == "+")
        elif counted:
            self.least, self.most = int(counted[2]), int(counted[3]) if counted[3] else None

    def may_grow(self, text: list[bytes], begin: int, end: int, length: int) -> bool:
        """Whether these words may begin what the region takes."""
        if self.pattern is None:
            return self.most is None or length <= self.most
        return self.pattern.fullmatch(b" ".join(text[begin:end]).decode("utf-8", "replace"), partial=True) is not None

    def takes(self, text: list[bytes], begin: int, end: int, length: int) -> bool:
        """length: characters of the words and the spaces between them."""
        if self.pattern is None:
            return self.least <= length and (self.most is None or length <= self.most)
        return self.pattern.fullmatch(b" ".join(text[begin:end]).decode("utf-8", "replace")) is not None


class Automaton:
    """A template as a graph over word positions.

    States are numbers; ``steps[s]`` has (word, next), ``skips[s]`` the states reached without a word, ``regions[s]`` the
    replaceable region that begins at a state and the state behind it. The last state accepts.
    """

    def __init__(self, template: str):
        self.steps: list[list[tuple[bytes, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.regions: dict[int, tuple[Region, int]] = {}
        runs: list[list[bytes]] = [[]]  # of mandatory words
        opened: list[int] = []
        at = 0
        for m in [*_MARK.finditer(template), None]:
            plain = template[at : m.start() if m else len(template)]
            if "<<" in plain or ">>" in plain:
                raise ValueError(f"unknown markup in {plain[:80]!r}")
            for w in words(plain.encode()):
                self.steps[-1].append((w, self._state()))
                if not opened:
                    runs[-1].append(w)
            if m is None:
                break
            at = m.end()
            runs.append([])
            if m[1] == "beginOptional":
                opened.append(len(self.steps) - 1)
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError("an optional region is closed that wasn't opened")
                self.skips[opened.pop()].append(len(self.steps) - 1)
            else:
                fields = {k: a or b for k, a, b in _FIELD.findall(m[2])}
                if "match" not in fields:
                    raise ValueError(f"a replaceable region without a pattern: {m[0][:80]}")
                own = len(self.steps) - 1
                if own in self.regions:  # two regions in a row
                    self.skips[own].append(own := self._state())
                self.regions[own] = (Region(fields["match"]), self._state())
        if opened:
            raise ValueError("an optional region isn't closed")
        self.final = len(self.steps) - 1
        self.key = b" " + b" ".join(max(runs, key=lambda r: sum(map(len, r)))) + b" "
        first = self._closed({(0, -1, 0)}, [], 0)
        self.begins = None if any(r >= 0 for _, r, _ in first) else {w for s, _, _ in first for w, _ in self.steps[s]}

    def _state(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def _closed(self, threads: set[tuple[int, int, int]], text: list[bytes], at: int) -> set[tuple[int, int, int]]:
        """All threads (state, place where its region began or -1, length) that are reached without a further word."""
        out, todo = set(threads), list(threads)
        while todo:
            state, begin, length = todo.pop()
            new = []
            if begin < 0:
                new += [(s, -1, 0) for s in self.skips[state]]
                if state in self.regions:
                    new.append((state, at, 0))
            else:
                region, behind = self.regions[state]
                if region.takes(text, begin, at, length):
                    new.append((behind, -1, 0))
            for t in new:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def accepts(self, text: list[bytes], at: int) -> int:
        """Where the longest match that begins at this word ends, or -1."""
        threads, end = self._closed({(0, -1, 0)}, text, at), -1
        for k in range(at, len(text) + 1):
            if any(s == self.final and b < 0 for s, b, _ in threads):
                end = k
            if k == len(text) or not threads:
                break
            word, following = text[k], set()
            size = len(word.decode("utf-8", "replace"))
            for s, begin, length in threads:
                if begin < 0:
                    following.update((n, -1, 0) for w, n in self.steps[s] if w == word)
                elif self.regions[s][0].may_grow(text, begin, k + 1, grown := length + size + (k > begin)):
                    following.add((s, begin, grown))
            threads = self._closed(following, text, k + 1)
        return end

    def found(self, text: list[bytes], joined: bytes) -> bool:
        """Whether a match begins anywhere: one pass, in which a thread begins at every word.

        Of the threads in a region without an upper length, the one that began first takes all that the others take, so
        it alone goes on; a counted region holds as many as fit its length.
        """
        if self.key not in joined:
            return False
        threads: set[tuple[int, int, int]] = set()
        for k, word in enumerate(text):
            if not threads and self.begins is not None and word not in self.begins:
                continue
            threads.add((0, -1, 0))
            threads = self._closed(threads, text, k)
            if self.accepted(threads):
                return True
            threads = self._stepped(threads, text, k)
        return self.accepted(self._closed(threads, text, len(text)))

    def accepted(self, threads: set[tuple[int, int, int]]) -> bool:
        return (self.final, -1, 0) in threads

    def _stepped(self, threads: set[tuple[int, int, int]], text: list[bytes], k: int) -> set[tuple[int, int, int]]:
        """The threads behind word k."""
        word, size = text[k], None
        following, first = set(), {}
        for s, begin, length in threads:
            if begin < 0:
                following.update((n, -1, 0) for w, n in self.steps[s] if w == word)
                continue
            size = len(word.decode("utf-8", "replace")) if size is None else size
            region, grown = self.regions[s][0], length + size + (k > begin)
            if region.pattern is None and region.most is None:
                if s not in first or begin < first[s][1]:
                    first[s] = (s, begin, grown)
            elif region.may_grow(text, begin, k + 1, grown):
                following.add((s, begin, grown))
        return following.union(first.values())


AUTOMATA = {name: Automaton(t) for name, t in TEMPLATES.items()}


def places(joined: bytes, phrase: str) -> list[int]:
    """Numbers of the words at which the phrase begins; joined: the words, each with a space before and one at the end."""
    key, out, at, n, before = b" " + phrase.encode() + b" ", [], 0, 0, 0
    while (at := joined.find(key, at)) >= 0:
        n += joined.count(b" ", before, at)
        out.append(n)
        before = at
        at += 1
    return out


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    found = words(text)
    joined = b" " + b" ".join(found) + b" "
    at = {p: places(joined, p) for p in PHRASES}
    starts = [x for xs in at.values() for x in xs]
    base = {PHRASES[p] for p, xs in at.items() if xs}
    own = {name for name, a in AUTOMATA.items() if a.found(found, joined)}
    score = 1.0 if own else 0.5 if base else 0.0
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases and matching templates of every whole text."""

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [(i, *scan(t)) for i, t in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True)]
        return dict(zip(RESULT.names, zip(*rows, strict=True) if rows else [[]] * len(RESULT), strict=True))

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), RESULT, make)


def op3_license_template_automata(spark, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))
