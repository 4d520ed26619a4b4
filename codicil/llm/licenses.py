"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Words are compared in lower case with marks as white space. Each template's three-word hashes are winnowed (the
least hash of every window of three is kept) into an inverted index hash -> (template, place). A text is winnowed
in the same way, so any run of five words that it shares with a template hits the index. Hits on nearby diagonals
make one candidate, which a local alignment within a band around its diagonal turns into matched words and a span.
A match must hold just the deciding words of its template (names, versions, "NonCommercial", "Lesser", "later" and the
like), none missing and none more. Of overlapping matches the one with most matched words is reported.

The index holds templates only and is small by construction; texts never leave their task.

Edge cases: null and empty texts have no license. Repeated rows are each reported, a null id stays null. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.scratch import small_batches
from codicil.llm.words import hash_words, mix, text_bytes

GRAM, WINDOW, BAND = 3, 3, 6
#: Least share of a template's words that a match holds.
COVERAGE = 0.75

#: Public license notices, as their texts prescribe them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_GNU = "under the terms of the GNU {0} as published by the Free Software Foundation"
_HEADER = (
    "This {1} is free software: you can redistribute it and/or modify it " + _GNU + "{2} This {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
for _name, _title, _work, _versions in (
    ("GPL", "General Public License", "program", ("2", "3")),
    ("LGPL", "Lesser General Public License", "library", ("2.1", "3")),
    ("AGPL", "Affero General Public License", "program", ("3",)),
    ("LGPL", "Library General Public License", "library", ("2",)),
):
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES.setdefault(_id, f"This work is licensed under the GNU {_title}, version {_v}.")
        TEMPLATES.setdefault(f"{_id}-or-later", _HEADER.format(_title, _work, f"; either version {_v} of the License, or (at your option) any later version."))
        TEMPLATES[f"{_id}-header"] = _HEADER.format(_title, _work, f", version {_v} of the License.")
        TEMPLATES[f"{_id}-or-later-short"] = f"This work is licensed under the GNU {_title}, version {_v} or later."
for _id, _title in (("", ""), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC", "-NonCommercial"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives")):
    for _v in ("4.0", "3.0"):
        _kind = "International" if _v == "4.0" else "Unported"
        _long = f"This work is licensed under a Creative Commons Attribution{_title} {_v} {_kind} License."
        if _long not in TEMPLATES.values():
            TEMPLATES[f"CC-BY{_id}-{_v}-notice"] = _long
        TEMPLATES.setdefault(f"CC-BY{_id}-{_v}" if f"CC-BY{_id}-{_v}" not in TEMPLATES else f"CC-BY{_id}-{_v}-short", f"Licensed under CC BY{_id} {_v}.")
del TEMPLATES["CC-BY-NC-4.0-short"]  # the same words as CC-BY-NC-4.0
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
TEMPLATES["BSD-2-Clause"] = TEMPLATES["BSD"] + _AS_IS
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _AS_IS

#: Words that tell a license from its neighbours; versions and clauses count only where the template has a version.
NAMES = re.compile(r"\b(?:mit|apache|bsd|isc|mozilla|eclipse|artistic|boost|gnu|cc|creative commons|lesser|library general|affero)\b")
CLAUSES = re.compile(r"\b(?:non ?commercial|share ?alike|no ?deriv\w*|nc|sa|nd|later)\b")
VERSIONS = re.compile(r"\bv?([1-5])\b")
_MARKS = re.compile(r"[^0-9a-z]+")
_SAME = {"noncommercial": "nc", "sharealike": "sa"}


def deciding(text: str, versioned: bool = True) -> frozenset[str]:
    """The deciding words of a notice."""
    plain = _MARKS.sub(" ", text.lower())
    found = set(NAMES.findall(plain))
    if versioned:
        clauses = (c.replace(" ", "") for c in CLAUSES.findall(plain))
        found |= {"nd" if c.startswith("noderiv") else _SAME.get(c, c) for c in clauses}
        found |= set(VERSIONS.findall(plain))
    return frozenset(found)


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = 32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    return hash_words(_PLAIN[data], offsets)


def winnowed(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the selected grams of all texts; place is that of a gram's first word."""
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return hashes[:0], np.empty(0, np.int64)
    g = hashes[:n]
    for j in range(1, GRAM):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    text = np.searchsorted(bounds, np.arange(n), side="right")
    inside = np.arange(n) + GRAM <= bounds[np.minimum(text, len(bounds) - 1)]
    top = np.iinfo(np.uint64).max
    g = np.where(inside, g, top)
    pad = np.concatenate([g, np.full(WINDOW - 1, top, np.uint64)])
    owner = np.concatenate([text, np.full(WINDOW - 1, -1)])
    least = g.copy()  # of the window that starts here, within its text
    for j in range(1, WINDOW):
        least = np.minimum(least, np.where(owner[j : j + n] == text, pad[j : j + n], top))
    chosen = g == least
    for j in range(1, WINDOW):
        chosen[j:] |= (g[j:] == least[:-j]) & (text[j:] == text[:-j])
    at = np.flatnonzero(chosen & inside)
    return g[at], at


@dataclass
class Index:
    """Inverted index of the templates' fingerprints."""

    names: list[str]
    texts: list[np.ndarray]
    hashes: np.ndarray
    places: list[list[tuple[int, int]]]
    deciding: list[frozenset[str]]
    versioned: list[bool]

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        names = sorted(templates)
        texts, lists = [], defaultdict(list)
        for t, name in enumerate(names):
            h, b, _, _ = words(pa.array([templates[name]]))
            texts.append(h)
            for x, at in zip(*winnowed(h, b), strict=True):
                lists[int(x)].append((t, int(at)))
        keys = sorted(lists)
        versioned = [bool(VERSIONS.search(_MARKS.sub(" ", templates[n].lower()))) for n in names]
        own = [deciding(templates[n], v) for n, v in zip(names, versioned, strict=True)]
        return cls(names, texts, np.array(keys, np.uint64), [lists[k] for k in keys], own, versioned)

    def matches(self, column: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """(license, coverage, first byte, end byte) of each text's matches in order; bytes count from the column's first."""
        hashes, bounds, starts, ends = words(column)
        data = text_bytes(column)[0]
        found, at = winnowed(hashes, bounds)
        k = np.minimum(np.searchsorted(self.hashes, found), max(0, len(self.hashes) - 1))
        hit = np.flatnonzero(self.hashes[k] == found) if len(self.hashes) else k[:0]
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in hit.tolist():
            text = int(np.searchsorted(bounds, at[i], side="right")) - 1
            for t, place in self.places[k[i]]:
                groups[text, t].append(int(at[i]) - place)
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in range(len(bounds) - 1)]
        spans: dict[int, list] = defaultdict(list)
        for (text, t), diagonals in groups.items():
            last = None
            for d in sorted(set(diagonals)):
                if last is not None and d - last <= BAND:
                    continue
                last = d
                a, b = max(int(bounds[text]), d - BAND), min(int(bounds[text + 1]), d + len(self.texts[t]) + BAND)
                matched, lo, hi = align(self.texts[t], hashes[a:b], d - a)
                if matched < COVERAGE * len(self.texts[t]):
                    continue
                span = bytes(data[int(starts[a + lo]) : int(ends[a + hi - 1])]).decode(errors="ignore")
                if deciding(span, self.versioned[t]) == self.deciding[t]:
                    spans[text].append((matched, -t, a + lo, a + hi))
        for text, own in spans.items():
            kept = []
            for matched, minus, lo, hi in sorted(own, reverse=True):
                if all(hi <= x or lo >= y for _, _, x, y in kept):
                    kept.append((matched, -minus, lo, hi))
            for matched, t, lo, hi in sorted(kept, key=lambda x: x[2]):
                out[text].append((self.names[t], matched / len(self.texts[t]), int(starts[lo]), int(ends[hi - 1])))
        return out


def align(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment within BAND of the diagonal text place - template place."""
    # score: match 2, else -1; each cell keeps (score, matched, first text word)
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, w in enumerate(template.tolist()):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - BAND), min(len(text), i + diagonal + BAND + 1)):
            same = int(text[j]) == w
            s, m, f = above.get(j - 1, (0, 0, j))
            cell = (s + 2, m + 1, f if s > 0 else j) if same else (s - 1, m, f)
            for s, m, f in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, f)
            if cell[0] > 0:
                row[j] = cell
                if same and (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


FOUND = "doc_id long, n_licenses long, licenses array<struct<license:string,coverage:double,start:long,end:long>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """FOUND for each row of docs (doc_id, text): licenses with coverage and span in code points."""
    index = Index.of(templates or TEMPLATES)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                _, offsets = text_bytes(part.column(1))
                rows = []
                for i, own in enumerate(index.matches(part.column(1))):
                    if own:
                        raw = part.column(1)[i].as_py().encode()
                        place = lambda b, i=i, raw=raw: len(raw[: b - int(offsets[i])].decode(errors="ignore"))
                        own = [{"license": n, "coverage": c, "start": place(a), "end": place(b)} for n, c, a, b in own]
                    rows.append(own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, rows), pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_licenses", "licenses"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
