"""Find license texts: winnowed fingerprints pick candidates, banded alignment measures coverage and spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lodestar.llm.common import Memo, claim
from lodestar.llm.words import shingles

# Notices as their publishers word them.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-clause-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-clause-2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-clause-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "EPL-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    # Without its first word (released, licensed): with it, those of another license would be four of its five words.
    "MIT-notice": "under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved.",
}

#: Words of a fingerprint, fingerprints of a window, how far an alignment may drift, words aligned at a time.
GRAM, WINDOW, BAND = 3, 4, 8
_EDGES = b".,;:!?()[]\"'*#-"


def _hashes(memo: Memo, text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def _memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w.strip(_EDGES) or w))


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window (the last of equal ones); of less than two windows, all."""
    if len(grams) < 2 * window:
        return np.arange(len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


class Index:
    """Fingerprint to (template, position), over all templates."""

    def __init__(self, templates: dict[str, str]):
        memo = _memo()
        self.names = sorted(templates)
        self.words = [_hashes(memo, templates[n]) for n in self.names]
        self.at: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            if len(words) >= GRAM:
                grams = shingles(words, GRAM)
                for j in winnow(grams):
                    self.at.setdefault(int(grams[j]), []).append((t, int(j)))
        self.known = np.array(sorted(self.at), dtype=np.uint64)

    def matches(self, words: np.ndarray, coverage: float) -> Iterator[tuple[str, int, float, int, int]]:
        """(template, matched words, coverage, first word, word past the last) of every template found in a text's words."""
        if len(words) < GRAM or not len(self.known):
            return
        grams = shingles(words, GRAM)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == grams)
        if not len(hits):
            return
        starts: dict[int, list[tuple[int, int]]] = {}
        for i in hits:
            for t, j in self.at[int(grams[i])]:
                starts.setdefault(t, []).append((int(i) - j, int(i)))
        for t, found in sorted(starts.items()):
            own = self.words[t]
            spans: list[tuple[int, int]] = []  # of the alignments reported, in order; they don't overlap
            tried: set[tuple[int, int, int]] = set()
            for start, i in sorted(set(found)):
                while True:
                    k = bisect_right(spans, (i, len(words)))
                    low, high = spans[k - 1][1] if k else 0, spans[k][0] if k < len(spans) else len(words)
                    if i < low or (start, low, high) in tried:  # an alignment of this template covers the place, or none is there
                        break
                    tried.add((start, low, high))
                    n, first, last = align(own, words, start, low=low, high=high)
                    if not n or n / len(own) < coverage:
                        break
                    yield self.names[t], n, n / len(own), first, last + 1
                    spans.insert(k, (first, last + 1))


def align(a: np.ndarray, b: np.ndarray, start: int, band: int = BAND, low: int = 0, high: int | None = None) -> tuple[int, int, int]:
    """Most equal words of a, in order, within b near start, drifting by band words at most: their number, first and last place in b.

    Only places of b from low on, before high, count.

    A longest common subsequence over a band of diagonals, one row for each word of a. Of as long ones, that which begins last.
    """
    width, high = 2 * band + 1, len(b) if high is None else high
    best = [(0, -1, -1)] * width  # of diagonal start + d - band: matches, minus the first place, last place
    for i, word in enumerate(a):
        row = [(0, -1, -1)] * width
        for d in range(width):
            j = i + start + d - band
            top = best[d + 1] if d + 1 < width else (0, -1, -1)  # a's word left out
            side = row[d - 1] if d else (0, -1, -1)  # b's word left out
            score = max(top, side, key=lambda x: (x[0], x[1]))
            if low <= j < high and b[j] == word:
                n, first, _ = best[d]
                met = (n + 1, first if n else j, j)
                score = max(score, met, key=lambda x: (x[0], x[1], -x[2]))
            row[d] = score
        best = row
    n, first, last = max(best, key=lambda x: (x[0], x[1] - x[2]))
    return n, first, last


def best(matches: Iterator[tuple[str, int, float, int, int]]) -> list[tuple[str, int, float, int, int]]:
    """Those without another that spans the same words or more and matches more, or as many at a higher coverage."""
    out: list[tuple[str, int, float, int, int]] = []
    for m in sorted(matches, key=lambda m: (-m[1], -m[2], m[3], m[0])):
        if not any(o[3] <= m[3] and m[4] <= o[4] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: (m[3], m[4]))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.75) -> DataFrame:
    """(doc_id, license, matched, coverage, start_word, end_word): a row for each place where coverage of a template's words stand in order.

    Words are those between ASCII blanks, A-Z lower-cased, without punctuation at their ends. Every run of GRAM words of a
    whole text is looked up among the templates' winnowed fingerprints; each place a fingerprint points to is aligned, unless
    an alignment reported before covers it. One pass, without a shuffle; the templates travel with the tasks.

    Null, empty and blank texts match nothing; repeated rows match each; null ids stay null. Templates of fewer than GRAM words are never
    found. Of templates that match at one place, the one that matches most is reported (then by coverage, place, name). An empty df gives an empty result. Extra columns are ignored.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    rows = df.select(doc_id, text)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        claim("license_scan")
        index, memo = Index(chosen), _memo()
        for b in batches:
            row, found = [], []
            for i, x in enumerate(b.column(1)):
                x = x.as_py()
                for m in best(index.matches(_hashes(memo, x), coverage)) if x else ():
                    row.append(i)
                    found.append(m)
            if row:
                names, matched, share, first, last = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(names), pa.array(matched, pa.int64()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                    names=[doc_id, "license", "matched", "coverage", "start_word", "end_word"],
                )

    return rows.mapInArrow(run, f"`{doc_id}` {kind}, license string, matched bigint, coverage double, start_word bigint, end_word bigint")
