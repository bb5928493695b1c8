"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Grams of three words of every template are winnowed into an inverted index. All grams of a text
are looked up there, as a notice may be shorter than what winnowing a text is sure to keep. Hits on neighbouring diagonals form a candidate, which is aligned with its template in a
band around them; matched coverage and character spans come from the alignment. Names and versions
that tell licenses apart have to agree, and of matches that overlap the one with more words counts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 3, 2
#: How far an alignment may leave the diagonal of its hits, in words; at most a quarter of the template.
BAND = 12
COVERAGE = 0.8
#: Templates of more words differ by more than names and versions: the one that matches best is enough.
NOTICE_WORDS = 200
_WORD = re.compile(rb"[a-z0-9]+")
#: Words that tell licenses apart, under one spelling each. Numbers do too.
TELLING = {
    word: kind.split()[0].encode()
    for kind in (
        "sa sharealike alike", "nc noncommercial commercial", "nd noderivatives noderivs derivatives derivs", "zero cc0",
        "lesser lgpl", "affero agpl", "gpl", "apache", "mit", "bsd", "isc", "mozilla", "mpl", "boost", "eclipse", "artistic",
    )
    for word in map(str.encode, kind.split())
}

# Notices and short texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"
    ),
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation"
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "All-rights-reserved": "All rights reserved.",
}
# Whole texts of public licenses.
TEMPLATES |= {f"{p.stem}-full": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def words_of(text: str | None) -> tuple[list[bytes], bytes]:
    """Words in A-Z, a-z and 0-9, and the bytes they were found in."""
    data = (text or "").encode("utf-8", "replace").lower()
    return _WORD.findall(data), data


def _mixed(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(31))


def winnowed(codes: np.ndarray) -> np.ndarray:
    """Places of the grams with the least hash of some window; a gram of -1 never wins."""
    hashes = np.where(codes < 0, np.uint64(2**64 - 1), _mixed(np.maximum(codes, 0)))
    if len(hashes) <= WINDOW:
        best = np.array([len(hashes) - 1 - int(hashes[::-1].argmin())] if len(hashes) else [], dtype=np.int64)
    else:
        views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
        best = np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(axis=1))
    return best[codes[best] >= 0]


def telling(data: bytes, offsets: list[tuple[int, int]], begin: int, end: int) -> tuple[set[bytes], set[bytes]]:
    """Telling words and numbers from word ``begin`` to ``end``.

    ``2.1`` is one number, read to its end, and ``2.0`` is ``2``. ``library`` tells only in the name of a license.
    """
    names, numbers, place = set(), set(), begin
    while place < end:
        low, high = offsets[place]
        word = data[low:high]
        place += 1
        if word.isdigit():
            while place < len(offsets) and data[high : offsets[place][0]] == b"." and data[slice(*offsets[place])].isdigit():
                high = offsets[place][1]
                place += 1
            number = data[low:high]
            while number.endswith(b".0"):
                number = number[:-2]
            numbers.add(number)
        elif word in TELLING:
            names.add(TELLING[word])
        elif word == b"library" and place < len(offsets) and data[slice(*offsets[place])] == b"general":
            names.add(word)
    return names, numbers


class Index:
    """Words, grams and fingerprints of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.vocabulary: dict[bytes, int] = {}
        known = self.vocabulary
        self.words = [[known.setdefault(w, len(known)) for w in words_of(t)[0]] for t in templates.values()]
        self.telling = []
        for text in templates.values():
            data = words_of(text)[1]
            places = [m.span() for m in _WORD.finditer(data)]
            self.telling.append(telling(data, places, 0, len(places)))
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template needs {GRAM} words at least")
        postings = defaultdict(list)
        for number, words in enumerate(self.words):
            codes = self.grams(np.array(words))
            for place in winnowed(codes).tolist():
                postings[int(codes[place])].append((number, place))
        self.codes = np.array(sorted(postings), dtype=np.int64)
        self.postings = [postings[c] for c in self.codes.tolist()]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """One number for each gram, exact; -1 if it has an unknown word."""
        if len(ids) < GRAM:
            return np.empty(0, dtype=np.int64)
        base, count = len(self.vocabulary) + 1, len(ids) - GRAM + 1
        codes = np.zeros(count, dtype=np.int64)
        known = np.ones(count, dtype=bool)
        for i in range(GRAM):
            part = ids[i : i + count]
            codes, known = codes * base + part, known & (part >= 0)
        return np.where(known, codes, -1)

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(diagonal, place in the text) of the shared fingerprints, by template."""
        codes = self.grams(ids)
        if not (codes >= 0).any():
            return {}
        chosen = np.flatnonzero(codes >= 0)
        at = np.searchsorted(self.codes, codes[chosen])
        same = self.codes[np.minimum(at, len(self.codes) - 1)] == codes[chosen]
        found = defaultdict(list)
        for place, slot in zip(chosen[same].tolist(), at[same].tolist()):
            for template, begin in self.postings[slot]:
                found[template].append((place - begin, place))
        return found


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment inside the band: matched words, and where it begins and ends in the text.

    A match counts 2, a word that differs, is missing or is extra costs 1. The band has the places
    ``row + diagonal - band`` to ``row + diagonal + band`` of the text for every template word.
    """
    nothing = (0, 0, -1, -1)  # score, matches, begin, end
    best, above = nothing, [nothing] * (2 * band + 3)
    for row, word in enumerate(template):
        current = [nothing] * (2 * band + 3)
        first = row + diagonal - band
        for slot in range(1, 2 * band + 2):
            place = first + slot - 1
            if not 0 <= place < len(text):
                continue
            score, matches, begin, _ = above[slot]  # the diagonal neighbour
            if text[place] == word:
                cell = (score + 2, matches + 1, place if matches == 0 else begin, place + 1)
            else:
                cell = (score - 1, matches, begin, above[slot][3])
            for other in (above[slot + 1], current[slot - 1]):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            current[slot] = cell if cell[0] > 0 else nothing
            if cell[0] > best[0]:
                best = cell
        above = current
    return best[1:]


def scan(text: str | None, index: Index, least: float) -> list[tuple[str, float, int, int, list[tuple[int, int]]]]:
    """License, coverage, matched and template words, and character spans of every license found."""
    words, data = words_of(text)
    find = index.vocabulary.get
    ids = np.array([find(w, -1) for w in words], dtype=np.int64)
    found = index.hits(ids)
    if not found:
        return []
    listed, offsets = ids.tolist(), None
    passed: list[tuple[int, int, tuple[int, int]]] = []
    for template, hits in sorted(found.items()):
        hits.sort()
        wanted, matches = index.words[template], {}
        band = max(1, min(BAND, len(wanted) // 4))  # copies of a short notice may be neighbours
        cuts = [i for i in range(1, len(hits)) if hits[i][0] - hits[i - 1][0] > band]
        for begin, end in zip([0, *cuts], [*cuts, len(hits)]):
            if end - begin < fewest_hits(len(wanted), least):
                continue
            middle = hits[(begin + end) // 2][0]
            low = max(0, middle - band)
            part = listed[low : max(0, middle) + len(wanted) + band + 1]
            matched, first, last = align(wanted, part, middle - low, band)
            if matched >= least * len(wanted):
                if offsets is None:
                    offsets = [m.span() for m in _WORD.finditer(data)]
                names, numbers = telling(data, offsets, low + first, low + last)
                same = names == index.telling[template][0] and numbers >= index.telling[template][1]
                if same or len(wanted) > NOTICE_WORDS:
                    span = (low + first, low + last)
                    matches[span] = max(matched, matches.get(span, 0))
        passed += [(template, matches[span], span) for span in _separate(matches)]
    taken, kept = np.zeros(len(words), dtype=bool), defaultdict(list)
    for template, matched, (first, last) in sorted(passed, key=lambda p: (-p[1], len(index.words[p[0]]), p[0], p[2])):
        if not taken[first:last].any():
            taken[first:last] = True
            kept[template].append((first, last, matched))
    out = []
    for template, spans in sorted(kept.items()):
        chars = [(_chars(data, offsets[a][0]), _chars(data, offsets[b - 1][1])) for a, b, _ in sorted(spans)]
        most, size = max(m for *_, m in spans), len(index.words[template])
        out.append((index.names[template], most / size, most, size, chars))
    return out


def fewest_hits(size: int, least: float) -> int:
    """Fingerprints on near diagonals that a copy of a template of ``size`` words shares at least.

    At most ``(1 - least) * size`` of its words differ and about ``2 * BAND`` are extra. They cut
    the copy into one run more than that, and a run of ``n`` words has ``(n - GRAM) / WINDOW`` at least.
    """
    runs = (1 - least) * size + 2 * BAND + 1
    return max(1, int((least * size - GRAM * runs) / WINDOW))


def _separate(matches: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Spans in order; of overlapping ones that with more matches."""
    kept: list[tuple[int, int]] = []
    for span in sorted(matches):
        if kept and span[0] < kept[-1][1]:
            if matches[span] > matches[kept[-1]]:
                kept[-1] = span
        else:
            kept.append(span)
    return kept


def _chars(data: bytes, at: int) -> int:
    return len(data[:at].decode("utf-8"))


FOUND = (
    "doc_id long, license string, coverage double, matched_words int, template_words int, "
    "spans array<struct<start: long, end: long>>"
)


def licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """A row for every document and license of which it holds at least ``coverage`` of the words.

    ``spans`` are character ranges of the matches, in order and apart from each other; the figures
    are those of the best one. Up to ``NOTICE_WORDS`` words the telling words of a match are those
    of the template and all the template's numbers occur in it. Of matches that overlap, also of
    different licenses, the one with more words is kept. Any run of ``GRAM + WINDOW - 1`` words
    that a text shares with a template is found there; long templates ask for ``fewest_hits``. NULL and empty texts give no rows, repeated rows give repeated
    rows, NULL ids stay NULL, and an empty table gives no rows. Documents are not shuffled.
    """
    index = Index(TEMPLATES if templates is None else templates)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), spans]
    names = ["doc_id", "license", "coverage", "matched_words", "template_words", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, content in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for *values, found in scan(content, index, coverage):
                    rows.append((key, *values, [{"start": a, "end": b} for a, b in found]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, FOUND)
