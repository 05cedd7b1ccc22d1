"""License scans by conditional compression.

A line with a license word, and a run of such lines close together, is a candidate
block. It is compressed by itself and with each template as zstandard's raw
dictionary; what a template saves, as a share of what it saves on its own text,
ranks the templates. The best are confirmed by the exact differences in wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of which each template, and so each candidate, has at least one.
CUES = ("licen", "copyright", "permission", "warrant", "redistribut", "rights reserved", "public domain", "cc0", "cc by")

# Fixed values: (license, wording) of public license texts, notices and short statements.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Unauthorized copying, redistribution or use of this file, via any medium, is strictly prohibited."),
)

#: The same cues as beginnings of single words.
CUE_WORDS = ("licen", "copyright", "permission", "warrant", "redistribut", "reserved", "domain", "cc0", "cc")

#: Lines with cues that are at most so many lines apart are scanned together, with as many lines about them.
GAP = 8
#: Words on each side of a cue that are compressed with it, besides the whole block: short wordings drown in long ones.
REACHES = (4, 16)
#: A template is confirmed only where it saves at least this share of what it saves on itself.
LEAST_SAVING = 0.25
#: Confirmed: at most these shares of the template's words missing, and of words added between its first and last.
MISSING, ADDED = 0.1, 0.2
LEVEL = 3

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


@dataclass(frozen=True)
class Finding:
    """A confirmed wording: lines first to last of a text."""

    license: str
    template: int
    first_line: int
    last_line: int
    saving: float
    plain_bytes: int
    dictionary_bytes: int
    missing: tuple[str, ...]
    added: tuple[str, ...]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def normal(words: Sequence[str]) -> bytes:
    """What is compressed of a wording."""
    return " ".join(words).encode("utf-8", "surrogatepass")


def aligned(template: Sequence[str], words: Sequence[str]) -> tuple[int, int, list[str], list[str]]:
    """The stretch [start, end) of `words` that holds most of the template in order, and the wording's differences.

    A longest common subsequence, of these one that begins last and then ends first.
    Differences: the template's words missing, and words added inside.
    """
    n, m = len(template), len(words)
    # best[j]: (common words, minus where the first is) of the template so far and words[:j]
    none = (0, 0)
    rows = [[none] * (m + 1)]
    for t in template:
        last, row = rows[-1], [none] * (m + 1)
        for j in range(1, m + 1):
            best = max(last[j], row[j - 1])
            if words[j - 1] == t:
                common, first = last[j - 1]
                best = max(best, (common + 1, first if common else j - 1))
            row[j] = best
        rows.append(row)
    if rows[n][m][0] == 0:
        return 0, 0, list(template), []
    end = next(j for j in range(m + 1) if rows[n][j] == rows[n][m])
    i, j, kept_words, kept_template = n, end, set(), set()
    while i and j and rows[i][j][0]:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            kept_words.add(j)
            kept_template.add(i)
    start = min(kept_words)
    return start, end, [w for k, w in enumerate(template) if k not in kept_template], [w for k, w in enumerate(words[start:end], start) if k not in kept_words]


class Scanner:
    """Templates with their compressors."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        for name, text in templates:
            if not any(c in text.lower() for c in CUES) or not any(w.startswith(CUE_WORDS) for w in words_of(text)):
                raise ValueError(f"a template of {name} has no cue")
        self.templates = [(name, words_of(text)) for name, text in templates]
        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **options)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        raw = [normal(words) for _, words in self.templates]
        self.given = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(r, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for r in raw]
        self.own = [max(1, len(self.plain.compress(r)) - len(g.compress(r))) for r, g in zip(raw, self.given, strict=True)]

    def ranked(self, words: Sequence[str]) -> list[tuple[float, int, int, int]]:
        """(share saved, template, bytes plain, bytes with it) of the templates that save enough on a block, best first.

        The block is compressed whole and, where it is longer, about each group of its cues.
        """
        best: dict[int, tuple[float, int, int, int]] = {}
        for lo, hi in self.about_cues(words):
            block = normal(words[lo:hi])
            plain = len(self.plain.compress(block))
            for k, g in enumerate(self.given):
                size = len(g.compress(block))
                best[k] = max(best.get(k, (0.0, k, 0, 0)), ((plain - size) / self.own[k], k, plain, size))
        # The share saved says how much of the template is there; among full ones the longer says more.
        return sorted((x for x in best.values() if x[0] >= LEAST_SAVING), key=lambda x: (-min(x[0], 1.0), -self.own[x[1]], x[1]))

    @staticmethod
    def about_cues(words: Sequence[str]) -> Iterator[tuple[int, int]]:
        marked = [k for k, w in enumerate(words) if w.startswith(CUE_WORDS)]
        if marked:
            yield 0, len(words)
        for reach in REACHES:
            lo = 0
            for k in range(1, len(marked) + 1):
                if k == len(marked) or marked[k] - marked[k - 1] > reach:
                    yield max(0, marked[lo] - reach), marked[k - 1] + reach + 1
                    lo = k

    def blocks(self, lines: list[str]) -> Iterator[tuple[int, int]]:
        """(first, last) line of each candidate: runs of lines with cues that are close, and the lines between."""
        marked = [k for k, line in enumerate(lines) if any(c in line.lower() for c in CUES)]
        lo = 0
        for k in range(1, len(marked) + 1):
            if k == len(marked) or marked[k] - marked[k - 1] > GAP:
                yield marked[lo], marked[k - 1]
                lo = k

    def scan(self, text: str | None) -> list[Finding]:
        """All confirmed wordings of a text; none overlap."""
        if not text or not any(c in text.lower() for c in CUES):
            return []
        lines, found = text.split("\n"), []
        for first, last in self.blocks(lines):
            # A wording may begin and end on the lines next to its cues.
            lo, hi = max(0, first - GAP), min(len(lines) - 1, last + GAP)
            words = [(w, k) for k in range(lo, hi + 1) for w in words_of(lines[k])]
            todo = [words]
            while todo:
                part = todo.pop()
                if got := self._best(part):
                    finding, start, end = got
                    if first <= finding.last_line and finding.first_line <= last:
                        found.append(finding)
                    todo += [part[:start], part[end:]]  # there may be more before and after it
        unique = {(f.template, f.first_line, f.last_line): f for f in found}
        return sorted(unique.values(), key=lambda f: (f.first_line, f.last_line, f.template))

    def _best(self, words: list[tuple[str, int]]) -> tuple[Finding, int, int] | None:
        """The best-ranked template that the wording confirms."""
        if not words:
            return None
        only = [w for w, _ in words]
        for share, k, plain, size in self.ranked(only):
            name, template = self.templates[k]
            for lo, hi in self._near(template, only):
                start, end, missing, added = aligned(template, only[lo:hi])
                if start and len(missing) < len(template):  # the stretch began too early, and so ended too early
                    lo, hi = lo + start, min(len(only), hi + start)
                    start, end, missing, added = aligned(template, only[lo:hi])
                if len(missing) <= MISSING * len(template) and len(added) <= ADDED * len(template):
                    start, end = start + lo, end + lo
                    return Finding(name, k, words[start][1], words[end - 1][1], min(1.0, share), plain, size, tuple(missing), tuple(added)), start, end
        return None

    @staticmethod
    def _near(template: list[str], words: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches that may hold the template, as long as it and what may be added, at words that can begin it.

        Of a confirmed wording at most MISSING of the words are missing, so one of
        the template's first words, as many and one more, begins it.
        """
        may_miss = int(MISSING * len(template))
        begin, size = set(template[: may_miss + 1]), len(template) + int(ADDED * len(template))
        known = set(template)
        held = [w in known for w in words]
        upto = [0]
        for h in held:
            upto.append(upto[-1] + h)
        for at, w in enumerate(words):
            if w in begin and upto[min(len(words), at + size)] - upto[at] >= len(template) - may_miss:
                yield at, min(len(words), at + size)


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def license_findings(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (`id_col`, license, template, first_line, last_line, saving, plain_bytes, dictionary_bytes, words_missing, words_added, exact): confirmed license wordings of whole texts.

    Words compare in lower case, without punctuation at their ends. A wording is
    confirmed if at most a tenth of its template's words are missing and at most a
    fifth as many are added between its first and last; `words_missing` and
    `words_added` list them. A text may give several rows; null, empty and unlicensed
    texts give none. Null ids stay null; repeated rows give their rows each; an empty
    table gives no rows; other columns aren't read. No shuffle.
    """
    fixed = tuple(map(tuple, templates))
    scanner(fixed)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(fixed)
        for batch in batches:
            at, got = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for f in own.scan(text):
                    at.append(k)
                    got.append(f)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array([f.license for f in got], pa.string()), pa.array([f.template for f in got], pa.int32()),
                    pa.array([f.first_line for f in got], pa.int32()), pa.array([f.last_line for f in got], pa.int32()), pa.array([f.saving for f in got], pa.float64()),
                    pa.array([f.plain_bytes for f in got], pa.int64()), pa.array([f.dictionary_bytes for f in got], pa.int64()),
                    pa.array([" ".join(f.missing) for f in got], pa.string()), pa.array([" ".join(f.added) for f in got], pa.string()), pa.array([not f.missing and not f.added for f in got], pa.bool_()),
                ],
                names=[id_col, "license", "template", "first_line", "last_line", "saving", "plain_bytes", "dictionary_bytes", "words_missing", "words_added", "exact"],
            )

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, license string, template int, first_line int, last_line int, saving double, plain_bytes bigint, dictionary_bytes bigint, words_missing string, words_added string, exact boolean")
