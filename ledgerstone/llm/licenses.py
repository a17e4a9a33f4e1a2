"""Op 4: license scan.

Templates are cut into k-grams of words; winnowing keeps the smallest hash of every few
neighbours, and an inverted index maps those fingerprints to the templates that have them.  A
document's own winnowed fingerprints look up candidates: equal runs of words of a guaranteed
length share a fingerprint.  A banded alignment of the template with the neighbourhood of the
hits then says how much of the template the document holds, and where.

Licenses of one family differ in a word or a number, so an alignment is judged twice: by its
identity, the matched words over all words of template and span together, and by the words that
tell licenses apart (`TELLING` and versions), of which template and span must have the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerstone.llm.blocks import Rolling, chunks, sliding_min, word_hashes
from ledgerstone.llm.quality import _runs

K, WINNOW = 3, 2  # words of a fingerprint; fingerprints of which the smallest is kept
COVERAGE = 0.8
BAND = 8

# Words that tell licenses of one family apart, and words after which a number is a version.
TELLING = ["academic", "affero", "derivatives", "lesser", "library", "nc", "nd", "non", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike", "v1", "v2", "v3"]
VERSIONED = ["apache", "attribution", "bsd", "by", "cc", "gpl", "license", "licence", "nc", "nd", "noderivatives", "noncommercial", "public", "sa", "sharealike", "v", "version"]

# Notices and short texts of public licenses.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_MIT_REST = ', and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "MIT": "Released under the MIT License",
    "MIT-grant": _MIT_GRANT,
    "MIT-text": _MIT_GRANT + _MIT_REST,
    "BSD-redistribution": _BSD_HEAD,
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "BSD-2-Clause-text": _BSD_HEAD + _BSD_TWO + _BSD_END,
    "BSD-3-Clause-text": _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_END,
    "ISC": _ISC_GRANT,
    "ISC-text": _ISC_GRANT + _ISC_REST,
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-2.0-or-later-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-3.0": "Licensed under CC BY 3.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0-name": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0-name": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0-name": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, text) of runs of letters and digits, in lower case."""
    start, end, text, word = _runs(buf, offs)
    start, end, text = start[word], end[word], text[word]
    return word_hashes(buf, start, end, lower=True), start, end, text


def _grams(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it lies in one text) of each k words."""
    g = Rolling(h).windows(k)
    return g, text[: len(g)] == text[k - 1 :] if len(g) else np.zeros(0, bool)


def winnow(g: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Places whose fingerprint is the smallest of some w neighbours; a shorter run keeps its smallest."""
    v = np.where(whole, g, np.uint64(2**64 - 1))
    padded = np.concatenate([np.full(w - 1, 2**64 - 1, np.uint64), v, np.full(w - 1, 2**64 - 1, np.uint64)])
    low = sliding_min(padded, w)  # low[i]: of the w values ending at i
    least = np.zeros(len(v), bool)
    for j in range(w):
        least |= v == low[j : j + len(v)]
    return np.flatnonzero(least & whole)


class Index:
    """Fingerprint -> (template, place); templates themselves keep every k-gram, so any kept one of a text can hit."""

    def __init__(self, templates: dict[str, str], k: int = K) -> None:
        self.names = sorted(templates)
        self.words, self.telling = [], []
        post: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.tell, self.before = (np.sort(_tokens(np.frombuffer(" ".join(x).encode(), np.uint8), np.array([0, len(" ".join(x))]))[0]) for x in (TELLING, VERSIONED))
        for t, name in enumerate(self.names):
            buf = np.frombuffer(templates[name].encode(), np.uint8)
            h, start, end, text = _tokens(buf, np.array([0, len(buf)]))
            self.words.append(h)
            self.telling.append(np.sort(h[self.tells(h, buf, start, end)]))
            g, _ = _grams(h, text, k)
            for i, x in enumerate(g.tolist()):
                post[x].append((t, i))
        self.post = dict(post)
        self.keys = np.array(sorted(self.post), np.uint64)

    def tells(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words tell licenses apart: those of TELLING, and numbers that are versions or go on with one after a point."""
        among = lambda known: known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        if not len(h):
            return np.zeros(0, bool)
        digit = (buf[start] >= 48) & (buf[start] <= 57)
        version, joined = digit.copy(), digit.copy()
        version[0] = joined[0] = False
        version[1:] &= among(self.before)[:-1]
        joined[1:] &= (start[1:] == end[:-1] + 1) & (buf[end[:-1]] == 46)
        for _ in range(3):
            version[1:] |= joined[1:] & version[:-1]
        return version | among(self.tell)


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of a with b inside a band: (matched, first and last + 1 place in b).

    Place i of a may match places shift + i - band .. shift + i + band of b; of equally long ones
    the one of the shortest span counts, then the first.
    """
    b = b.tolist()
    chain = [(0, -1)] * (len(b) + 1)  # [p]: (matched, first place) of the best chain before place p
    best = (0, 0, 0)
    for i, x in enumerate(a.tolist()):
        lo, hi = max(0, shift + i - band), min(len(b), shift + i + band + 1)
        if lo >= hi:
            continue
        diagonal = chain[lo]
        for j in range(lo, hi):
            old = max(chain[j + 1], diagonal)
            here = max(old, chain[j])
            if b[j] == x:
                found = (diagonal[0] + 1, diagonal[1] if diagonal[0] else j)
                here = max(here, found)
                if (found[0], found[1] - j - 1, -j) > (best[0], best[1] - best[2], 1 - best[2]):
                    best = (*found, j + 1)
            chain[j + 1], diagonal = here, old
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, template, coverage, identity, matched_words, start_byte, end_byte: one row per place of a template.

    coverage is the share of the template's words the document has there, in order; identity is
    those words over the template's and the other words of the span.  Reported are places whose
    identity is at least `coverage` and that have the same telling words and versions as the
    template, a number after the span, joined to it by a point, included; a template's
    overlapping places once, the one of most matched words, then the shortest, then the first.
    Whole texts of any length are scanned.  A null or empty text has no rows, nor has an empty
    table; rows of one doc_id, null included, are scanned each for itself; other columns are
    ignored.  Templates of fewer than 3 words match nowhere.  The index is in each task, so its
    size is that of the list of templates, not of the corpus.
    """
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, _, buf, offs in chunks(batch["text"]):
                if not len(buf) or not len(index.keys):
                    continue
                h, start, end, text = _tokens(buf, offs)
                g, whole = _grams(h, text, K)
                kept = winnow(g, whole, WINNOW)
                if not len(kept):
                    continue
                at = np.minimum(np.searchsorted(index.keys, g[kept]), len(index.keys) - 1)
                hits: dict[tuple[int, int], set[int]] = defaultdict(set)
                for place in kept[index.keys[at] == g[kept]].tolist():
                    for t, i in index.post[int(g[place])]:
                        hits[int(text[place]), t].add(place - i)
                if not hits:
                    continue
                tells = index.tells(h, buf, start, end)
                places: dict[int, list[tuple]] = defaultdict(list)
                for (row, t), shifts in sorted(hits.items()):
                    lo, hi = (int(x) for x in np.searchsorted(text, [row, row + 1]))
                    words, last, mine = index.words[t], None, h[lo:hi].copy()
                    for shift in sorted(shifts):
                        if last is not None and shift - last <= BAND // 2:
                            continue  # the band around the last one covers it
                        last = shift
                        left = max(0, shift - lo - BAND)
                        near = mine[left : max(left, shift - lo + len(words) + BAND)]  # a view: what goes, goes from mine
                        while True:  # what was found is taken out, so each place of many in a row is seen
                            n, x, y = align(words, near, shift - lo - left)
                            if not n or n < coverage * len(words):
                                break
                            near[x:y] = 0
                            x, y = left + x, left + y
                            if n < coverage * (len(words) + y - x - n):
                                continue
                            upto = y
                            while lo + upto < hi and buf[start[lo + upto]] in b"0123456789" and end[lo + upto - 1] + 1 == start[lo + upto] and buf[end[lo + upto - 1]] == 46:
                                upto += 1
                            span = slice(lo + x, lo + upto)
                            if np.array_equal(np.sort(h[span][tells[span]]), index.telling[t]):
                                places[row].append((n, lo + x, lo + y, t))
                for row, found in places.items():
                    used: list[tuple[int, int]] = []
                    for n, x, y, t in sorted(found, key=lambda v: (-v[0], v[2] - v[1], len(index.words[v[3]]), v[1], v[3])):
                        if all(y <= p or x >= q for p, q in used):
                            used.append((x, y))
                            size = len(index.words[t])
                            out.append((batch["doc_id"][a + row].as_py(), index.names[t], n / size, n / (size + y - x - n), n, int(start[x] - offs[row]), int(end[y - 1] - offs[row])))
            types = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "template", "coverage", "identity", "matched_words", "start_byte", "end_byte"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, template string, coverage double, identity double, matched_words long, start_byte long, end_byte long")
