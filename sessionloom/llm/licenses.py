"""License scans: winnowed template fingerprints pick candidates, a banded alignment measures them.

Texts are compared as lower-case runs of letters and digits. A template's
fingerprints are the smallest hashes of its word grams in each window of
``window`` grams; an inverted index maps them to templates and positions. Every
gram of a document is looked up in it (so a shared run of gram + window - 1 words
cannot be missed), hits on about the same diagonal make a candidate, and a local
alignment within a band around that diagonal counts the template's matched words.
Gram and window of a template are small enough for the run that is left when as
many of its words change as ``min_coverage`` allows and one place more is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: License notices to look for (fixed public wording).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
                "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation",
}

_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
             "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
             "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
             "documentation and/or other materials provided with the distribution. ")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission. ")
_BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
             "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
             "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
             "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
             "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
             "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Whole license texts without their copyright lines (fixed public wording).
FULL_TEXTS = {
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
                "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
                "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
                "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
                "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
                "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
                "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
                "THIS SOFTWARE.",
    "BSD-2-Clause-full": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause-full": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
                 "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
                 "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
                 "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
                 "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
                 "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                      "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
                      "by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
                      "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment "
                      "of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
                      "rights to this software under copyright law.",
    "GPL-notice-full": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                       "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
                       "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
                       "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
                       "License along with this program.",
}
ALL_TEMPLATES = TEMPLATES | FULL_TEXTS
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
FOUND = "license string, coverage double, matched long, start_word long, end_word long, start_char long, end_char long"


def words_of(text: str) -> np.ndarray:
    raw = _PLAIN[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = T.cut_words(raw, np.array([0, len(raw)]))
    return T.hash_words(raw, starts, ends)


@dataclass(frozen=True)
class Part:
    """Fingerprints of the templates with grams of one length."""

    gram: int
    codes: np.ndarray  # sorted fingerprints, one entry for each place
    template: np.ndarray
    place: np.ndarray


@dataclass(frozen=True)
class Index:
    names: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    parts: tuple[Part, ...]


def sure_run(n: int, min_coverage: float) -> int:
    """Words of the longest run that a variant of n words with this coverage and one insertion shares at least."""
    kept = max(1, math.ceil(min_coverage * n - 1e-9))
    return -(-kept // (n - kept + 2))


def build_index(templates: Mapping[str, str], gram: int = 3, window: int = 3, min_coverage: float = 0.8) -> Index:
    """``gram`` and ``window`` at most; templates shorter than ``gram`` are refused."""
    names = tuple(sorted(templates))
    words = tuple(words_of(templates[n]) for n in names)
    rows: dict[int, list] = {}
    for t, w in enumerate(words):
        if len(w) < gram:
            raise ValueError(f"template {names[t]} has fewer than {gram} words")
        run = sure_run(len(w), min_coverage)
        size = min(gram, run)
        codes = T.Rolling(w, "word").windows(size)
        span = min(window, run - size + 1, len(codes))
        keep = {i + int(np.argmin(codes[i: i + span])) for i in range(len(codes) - span + 1)}
        rows.setdefault(size, []).extend((codes[i], t, i) for i in sorted(keep))
    parts = []
    for size, found in sorted(rows.items()):
        found.sort()
        parts.append(Part(size, np.array([r[0] for r in found], np.uint64), np.array([r[1] for r in found]), np.array([r[2] for r in found])))
    return Index(names, words, tuple(parts))


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best local alignment (match 2, mismatch and gap -1) of template a with words b, b position within ``band`` of a position + shift.

    Returns (matched words, first and end position in b); of equal scores the one that ends first in a, then in b.
    """
    width = 2 * band + 1
    none = np.iinfo(np.int32).min // 2
    score, hits, start = np.full(width + 1, none), np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
    best = (0, 0, 0, 0)
    for i, word in enumerate(a):
        first = i + shift - band  # position in b of the first cell
        lo, hi = max(0, -first), min(width, len(b) - first)
        old, score = score, np.full(width + 1, none)
        if lo >= hi:
            continue
        cell = np.arange(lo, hi)
        same = b[first + lo: first + hi] == word
        live = old[lo:hi] > 0
        s = np.where(live, old[lo:hi], 0) + np.where(same, 2, -1)
        h, p = np.where(live, hits[lo:hi], 0) + same, np.where(live, start[lo:hi], first + cell)
        above = old[lo + 1: hi + 1] - 1
        up = above > s
        s, h, p = np.where(up, above, s), np.where(up, hits[lo + 1: hi + 1], h), np.where(up, start[lo + 1: hi + 1], p)
        reach = np.maximum.accumulate(s + cell)  # gaps along the row: the best cell to the left, less its distance
        source = np.maximum.accumulate(np.where(s + cell == reach, cell - lo, 0))
        s, h, p = reach - cell, h[source], p[source]
        score[lo:hi], hits, start = np.maximum(s, 0), np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
        hits[lo:hi], start[lo:hi] = h, p
        k = int(s.argmax())
        if s[k] > best[0]:
            best = (int(s[k]), int(h[k]), int(p[k]), int(first + lo + k) + 1)
    return best[1], best[2], best[3]


def scan_text(index: Index, words: np.ndarray, hits: list[tuple[int, int]], band: int, min_coverage: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched, start, end) of the candidates among ``hits`` (template, word where it would start), best first per place.

    The band is at least half of the words that ``min_coverage`` lets a template lose, so
    whole licenses may shift further. A stretch that lacks too many of the
    template's words is not aligned: it cannot reach the coverage.
    """
    out, i = [], 0
    while i < len(hits):
        t, at = hits[i]
        last, w = i, index.words[t]
        reach = max(band, math.ceil((1 - min_coverage) * len(w) / 2))
        while last + 1 < len(hits) and hits[last + 1][0] == t and hits[last + 1][1] - at <= reach:
            last += 1
        lo, hi = max(0, at - reach), min(len(words), hits[last][1] + len(w) + reach + 1)
        if np.isin(w, words[lo:hi]).sum() >= min_coverage * len(w):
            matched, start, end = align(w, words[lo:hi], at - lo, 2 * reach)
            if matched >= min_coverage * len(w):
                out.append((t, matched / len(w), matched, lo + start, lo + end))
        i = last + 1
    kept: list[tuple[int, float, int, int, int]] = []
    for m in sorted(out, key=lambda m: (m[0], -m[1], m[3])):  # of overlapping finds of one template the best
        if not any(k[0] == m[0] and m[3] < k[4] and k[3] < m[4] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[3], m[4], m[0]))


def scan(docs: DataFrame, templates: Mapping[str, str] = ALL_TEMPLATES, id_col: str = "doc_id", text_col: str = "text", gram: int = 3,
         window: int = 3, band: int = 4, min_coverage: float = 0.8) -> DataFrame:
    """One row per template found: id, license, coverage, matched words, and the span in words and characters of the text.

    A document may give no row or several. Null and empty texts give none; equal
    rows give equal results. The index holds the given templates only.
    """
    kind = dict(docs.dtypes)[id_col]
    index = build_index(templates, gram, window, min_coverage)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for first, raw, off in T.chunks(b.column("text")):
                plain = _PLAIN[raw]
                ws, we, wo = T.cut_words(plain, off)
                words = T.hash_words(plain, ws, we)
                met: dict[int, set[tuple[int, int]]] = {}
                for p in index.parts:
                    codes = T.Rolling(words, "word").windows(p.gram)
                    lo, hi = np.searchsorted(p.codes, codes, "left"), np.searchsorted(p.codes, codes, "right")
                    where = np.flatnonzero(hi > lo)
                    owner = np.searchsorted(wo, where, "right") - 1
                    whole = where + p.gram <= wo[owner + 1]
                    for s, doc in zip(where[whole].tolist(), owner[whole].tolist()):
                        met.setdefault(doc, set()).update((int(p.template[k]), int(s - wo[doc] - p.place[k])) for k in range(lo[s], hi[s]))
                for doc in sorted(met):
                    base, hits = wo[doc], sorted(met[doc])
                    text = raw[off[doc]: off[doc + 1]]
                    for t, cover, matched, s, e in scan_text(index, words[base: wo[doc + 1]], hits, band, min_coverage):
                        byte = (int(ws[base + s] - off[doc]), int(we[base + e - 1] - off[doc]))
                        chars = [int(((text[:x] & 0xC0) != 0x80).sum()) for x in byte]
                        at.append(first + int(doc))
                        rows.append((index.names[t], cover, matched, s, e, *chars))
            kinds = [pa.string(), pa.float64(), *[pa.int64()] * 5]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *cols], ["id", *[c.split()[0] for c in FOUND.split(", ")]])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)
