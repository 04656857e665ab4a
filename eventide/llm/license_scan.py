"""License notices found by patience alignment of texts with templates.

Words are lower-cased and stripped of punctuation.  A stretch of a text is aligned with a template
like this: words that occur once in both are anchors; the longest run of anchors that
ascends in both (a longest increasing subsequence) is kept; the gaps between kept anchors
are aligned in the same way, and in a gap without anchors equal words at its ends are
matched.  Coverage is the share of the template's words that are matched.

A stretch that is covered must also carry the template's ``IDENTITY``, the words that tell
its license from others: each phrase's words are matched and nothing foreign stands between
them, so another license or version in the same sentence is not taken for this one.  Version
numbers are read alike with and without "v" and ".0" at their ends.

A notice is a stretch of at most ``spread`` times the template's length, so words scattered
over a long text do not add up to one; widen it for texts with comment marks that are words.  A stretch begins and ends with words of the template.
All such stretches are considered, by what they could cover at most: the longest common subsequence with the template, which no alignment
passes.  It is found for all stretches at once, from each first word on, in bit vectors.  Those that have the identifying
words are aligned, in order of this bound, shorter and then earlier ones first, until no other could cover more than the best.
Each text is read whole, in one pass; memory is bounded by the text.

Defined cases: a null or empty text has no notice; a notice that repeats, or several
notices, are all reported: of each template the best stretch (of equals that of the largest bound, the shortest, the first), then in
the same way the best before it and the best after it; a template that is ``WITHIN`` others is left
out where one of these is found; a sentence that names only a family, as "the BSD License",
is no notice;
rows that repeat an id are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

THRESHOLD, SPREAD = 0.8, 1.5
#: Stretches whose bounds are computed at once.
AT_ONCE = 1 << 15
VERSION = re.compile(rb"v?(\d{1,3}(?:\.\d{1,3})*?)(?:\.0)*")
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Parts of notices as their publishers word them.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_X11_END = "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."
_GPL_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

#: Whole notices by name; what comes after the license's identifier tells its wordings apart.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-family": _BSD,
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} {_BSD_THIRD} {_BSD_END}",
    "MIT": "Released under the MIT License.",
    "MIT-permission": _MIT,
    "MIT-text": f"{_MIT} {_MIT_END}",
    "X11": f"{_MIT} {_MIT_END} {_X11_END}",
}

#: The words that tell a license from others, by template.  Words with "?" may be missing; they are
#: the template's own, or extra ones that are not foreign here.
IDENTITY: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("the? apache license version? 2",),
    "Apache-2.0-header": ("the? apache license version? 2",),
    "BSD-2-Clause": ("with? the? distribution this software is provided",),
    "BSD-3-Clause": ("with? the? distribution 3? c? iii? neither the name", "endorse or? promote products", "written? permission this software is provided"),
    "MIT": ("the? mit license",),
    "MIT-permission": ("subject to the following conditions", "shall be included in all copies"),
    "MIT-text": ("subject to the following conditions", "portions? of? the? software the software is provided"),
    "X11": ("subject to the following conditions", "portions? of? the? software the software is provided", "except as contained in this notice"),
}

#: Templates that are part of others, whose notices are reported instead.
WITHIN = {"BSD-family": ("BSD-2-Clause", "BSD-3-Clause"), "MIT-permission": ("MIT-text", "X11"), "MIT-text": ("X11",)}

for _short, _long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    # the plain names are as in earlier results: BY-NC is the short wording, the others the long one
    _plain, _other = ("", "-full") if _short == "BY-NC" else ("-short", "")
    TEMPLATES[f"CC-{_short}-4.0{_plain}"] = f"Licensed under CC {_short} 4.0."
    TEMPLATES[f"CC-{_short}-4.0{_other}"] = f"This work is licensed under a Creative Commons {_long} 4.0 International License."
    IDENTITY[f"CC-{_short}-4.0{_plain}"] = (f"cc {_short} 4",)
    IDENTITY[f"CC-{_short}-4.0{_other}"] = (f"creative? commons? {_long} 4",)

for _id, _kind, _version in [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]:
    _name = f"GNU {_kind}General Public License"
    _header = _GPL_HEADER.replace("GNU General Public License", _name).replace("version 3", f"version {_version}")
    TEMPLATES[_id] = f"This work is licensed under the {_name}, version {_version}."
    TEMPLATES[f"{_id}-header"] = _header
    TEMPLATES[f"{_id}-only-header"] = _header.replace(f"as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version", f"version {_version} as published by the Free Software Foundation")
    IDENTITY[_id] = (f"the? {_name} {_id.split('-')[0]}? version? {_version}",)
    IDENTITY[f"{_id}-header"] = (f"the? {_name}", f"version {_version}")
    IDENTITY[f"{_id}-only-header"] = (f"the? {_name} {_id.split('-')[0]}? version? {_version}",)


def words(data: bytes) -> list[bytes]:
    """Lower-cased words without punctuation at their ends; marks that stand alone are left out."""
    return [w for w in (x.strip(STRIP) for x in data.lower().split()) if w]


def alike(word: bytes) -> bytes:
    """The word, or a version number without "v" and ".0"."""
    return m[1] if (m := VERSION.fullmatch(word)) else word


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(tails[at - 1] if at else -1)
        tails[at : at + 1] = [i]
        tops[at : at + 1] = [v]
    found, i = [], tails[-1] if tails else -1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text, template) positions, ascending in both."""
    matches: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matches.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matches.append((b, d))
        if a == b or c == d:
            continue
        once_text, once_template = _once(text, a, b), _once(template, c, d)
        pairs = sorted((i, once_template[w]) for w, i in once_text.items() if w in once_template)
        kept = [pairs[i] for i in increasing([j for _, j in pairs])]
        if not kept:
            continue
        matches += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(matches)


def _once(seq: list, lo: int, hi: int) -> dict:
    count = Counter(seq[lo:hi])
    return {w: i for i, w in enumerate(seq[lo:hi], lo) if count[w] == 1}


class Template:
    def __init__(self, name: str, text: str, identity: tuple[str, ...] = (), spread: float = SPREAD):
        self.name, self.words = name, [alike(w) for w in words(text.encode())]
        self.counts = Counter(self.words)
        self.reach = max(len(self.words) + 2, int(spread * len(self.words)))
        self.ids = {w: k for k, w in enumerate(self.counts, 1)}
        #: by the word's number, where it stands in the template, a bit a place; number 0 is a foreign word
        self.bits = np.zeros((len(self.ids) + 1, -(-len(self.words) // 64) or 1), np.uint64)
        for i, w in enumerate(self.words):
            self.bits[self.ids[w], i // 64] |= np.uint64(1) << np.uint64(i % 64)
        self.phrases = [self._phrase(p) for p in identity]

    def _phrase(self, phrase: str) -> tuple[int, int, set[int], set[bytes]]:
        """The phrase's first place and the one after its last, the places that must be matched, and the extra words."""
        parts = [(alike(w.removesuffix("?").lower().encode()), w.endswith("?")) for w in phrase.split()]
        own = [(w, free) for w, free in parts if not free or w in self.counts]
        for at in range(len(self.words) - len(own) + 1):
            if self.words[at : at + len(own)] == [w for w, _ in own]:
                return at, at + len(own), {at + i for i, (_, free) in enumerate(own) if not free}, {w for w, free in parts if free and w not in self.counts}
        raise ValueError(f"{self.name}: no {phrase!r} in the template")

    def named(self, text: list[bytes], matches: list[tuple[int, int]]) -> bool:
        """Whether the words that identify the license are matched with nothing foreign between them."""
        for start, end, needed, extra in self.phrases:
            inside = {j: i for i, j in matches if start <= j < end}
            if not needed <= inside.keys():
                return False
            hit = set(inside.values())
            if any(i not in hit and text[i] not in extra for i in range(min(hit), max(hit))):
                return False
        return True

    def found(self, text: list[bytes], at: dict[bytes, list[int]], threshold: float) -> list[tuple[float, int, int]]:
        """(coverage, first word, word after the last) of disjoint stretches that reach the threshold, best first."""
        need = threshold * len(self.words)
        if sum(min(n, len(at.get(w, ()))) for w, n in self.counts.items()) < need:
            return []
        bound, start, end = self.stretches(len(text), at, need)
        for phrase in self.phrases:
            if len(bound):
                near = self.carrying(phrase, text, start, end)
                bound, start, end = bound[near], start[near], end[near]
        order = np.lexsort((start, end - start, -bound))
        firsts: list[int] = []
        ends: list[int] = []
        kept: list[tuple[float, int, int]] = []
        open_: list[tuple[int, int, int, int, int, int]] = []

        def free(lo: int, hi: int) -> bool:
            k = bisect_left(firsts, lo)
            return (k == 0 or ends[k - 1] <= lo) and (k == len(firsts) or firsts[k] >= hi)

        # what is aligned waits until no other stretch has a larger bound; -1 stands for the end
        for place, (most, lo, hi) in enumerate([*zip(bound[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True), (-1, 0, 0)]):
            while open_ and -open_[0][0] >= most:
                less, _, s, e, first, last = heappop(open_)
                if free(s, e):
                    k = bisect_left(firsts, first)
                    firsts.insert(k, first)
                    ends.insert(k, last)
                    kept.append((-less / len(self.words), first, last))
            if most > 0 and free(lo, hi):
                matched, first, last = self.align(text, lo, hi, need)
                if matched:
                    heappush(open_, (-matched, place, lo, hi, first, last))
        return sorted(kept, key=lambda x: (-x[0], x[1]))

    def align(self, text: list[bytes], start: int, end: int, need: float) -> tuple[int, int, int]:
        """(words matched, first place, place after the last); zeros if it isn't a notice."""
        stretch = text[start:end]
        matches = patience(stretch, self.words)
        if len(matches) < need or not self.named(stretch, matches):
            return 0, 0, 0
        return len(matches), start + matches[0][0], start + matches[-1][0] + 1

    def starts(self, places: list[tuple[int, bytes]], need: float) -> list[int]:
        """Places from which on enough words of the template stand in reach, in whatever order."""
        have, total, hi, found = Counter(), 0, 0, []
        for start, word in places:
            while hi < len(places) and places[hi][0] < start + self.reach:
                w = places[hi][1]
                have[w] += 1
                total += have[w] <= self.counts[w]
                hi += 1
            if total >= need:
                found.append(start)
            total -= have[word] <= self.counts[word]
            have[word] -= 1
        return found

    def stretches(self, size: int, at: dict[bytes, list[int]], need: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bound, start, end) of all stretches in reach whose longest common subsequence with the template is long enough."""
        places = sorted((i, w) for w in self.counts for i in at.get(w, ()))
        begin = np.array(self.starts(places, need), np.int64)
        ids = np.zeros(size + self.reach, np.int32)
        ids[[i for i, _ in places]] = [self.ids[w] for _, w in places]
        limbs, top = self.bits.shape[1], np.uint64((1 << len(self.words) % 64) - 1 if len(self.words) % 64 else 2**64 - 1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.array_split(begin, -(-len(begin) // AT_ONCE)) if len(begin) else []:
            rows = [np.full(len(part), 2**64 - 1, np.uint64) for _ in range(limbs)]  # a place that is matched is a 0
            for step in range(self.reach):
                word = ids[part + step]
                hit = word > 0
                if not hit.any():
                    continue
                carry = np.zeros(len(part), np.uint64)
                length = np.full(len(part), len(self.words), np.int64)
                for k in range(limbs):
                    v = rows[k]
                    u = v & self.bits[word, k]
                    low = v + u
                    both = low + carry
                    carry = ((low < v) | (both < low)).astype(np.uint64)
                    rows[k] = both | (v & ~u)
                    length -= np.bitwise_count(rows[k] & top if k == limbs - 1 else rows[k]).astype(np.int64)
                good = np.flatnonzero(hit & (length >= need))
                if len(good):
                    found.append((length[good], part[good], part[good] + step + 1))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]

    def carrying(self, phrase: tuple[int, int, set[int], set[bytes]], text: list[bytes], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which stretches have the phrase's words that must be there, in order and with none but its words between them."""
        first, after, needed, extra = phrase
        wanted = [self.words[j] for j in sorted(needed)]
        allowed = {*self.words[first:after], *extra}
        latest = [-1] * len(wanted)  # where the words up to this one begin, as late as can be
        begins, ends = [], []
        for i in range(int(start.min()), int(end.max())):
            w = text[i]
            if w not in allowed:
                latest = [-1] * len(wanted)
                continue
            for k in range(len(wanted) - 1, -1, -1):
                if w == wanted[k]:
                    latest[k] = i if k == 0 else latest[k - 1]
            if w == wanted[-1] and latest[-1] >= 0:
                begins.append(latest[-1])
                ends.append(i)
        if not begins:
            return np.zeros(len(start), bool)
        # begins and ends both rise, so the next window that begins in the stretch is the one that ends first
        at = np.searchsorted(begins, start)
        return np.append(np.array(ends), np.iinfo(np.int64).max)[at] < end


def scan(data: bytes, templates: list[Template], vocabulary: set[bytes], threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, word after the last) of each notice found, best first."""
    text = [alike(w) for w in words(data)]
    at: dict[bytes, list[int]] = {}
    for i, w in enumerate(text):
        if w in vocabulary:
            at.setdefault(w, []).append(i)
    found = [(t.name, *hit) for t in templates for hit in t.found(text, at, threshold)]
    wider = {n: [(a, b) for m, _, a, b in found if m in outer] for n, outer in WITHIN.items()}
    return sorted((x for x in found if not any(a < x[3] and x[2] < b for a, b in wider.get(x[0], ()))), key=lambda x: (-x[1], x[0], x[2]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, spread: float = SPREAD) -> DataFrame:
    """(id_col, n_words, license, coverage, first_word, end_word, notices): one row per document.

    ``license`` is the template with the best coverage, null if none reaches the
    threshold; ``notices`` holds all that do, best first.  Templates of the caller's have no identity to carry.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = [Template(k, v, spread=spread) for k, v in templates.items()] if templates else [Template(k, v, IDENTITY.get(k, ()), spread) for k, v in TEMPLATES.items()]
    vocabulary = {w for t in known for w in t.counts}
    notice = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes()
                counts.append(len(data.split()))
                found.append([dict(zip(("license", "coverage", "first_word", "end_word"), x, strict=True)) for x in scan(data, known, vocabulary, threshold)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(notice))], names=["id", "n_words", "notices"])

    raw = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("data"))
    out = raw.mapInArrow(run, f"id {kind}, n_words long, notices array<struct<license:string,coverage:double,first_word:bigint,end_word:bigint>>")
    first = F.get("notices", F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_words", *[first[k].alias(k) for k in ("license", "coverage", "first_word", "end_word")], "notices")
