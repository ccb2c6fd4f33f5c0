"""License scans by conditional compression.

Characters within reach of a word of license language are candidates.  Their
words, in lower case, are cut into windows for each template, twice as long as
a confirmed copy may be and half overlapping, so that each copy lies whole in
one.  A window is compressed plainly and with the template as a raw zstandard
dictionary.  Windows whose size falls by less than the template's bound are
dropped: half of what a copy falls by that is edited as much as a confirmed
one may be.  The rest are ranked by their fall.  The first is confirmed by the
exact difference in wording: words of the template that the stretch lacks, and
words that it adds.  Confirmed words are taken away, what remains of a window
is compressed again, and so on until no window falls.  So a copy counts for
the template that it makes fall most, and each further copy has its own row.

Null and empty texts have no candidates, and an empty table gives no rows.  Equal falls are ranked by the
template's name, then by place.  Texts and lines of any length are scanned whole; work grows with the
candidate characters.  Rows that repeat a doc_id
are scanned each on its own, as rows of equal texts are.  Columns beyond doc_id
and text are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

#: Wordings of public licenses and notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
HINT = r"(?i)licen[cs]|copyright|rights reserved|redistribut|public domain|creative commons|\bcc[ -]by|warrant(?:y|ies)|permission (?:is|to|notice)"
#: Least share of a template's words found, and of the found stretch's words that are the template's.
FOUND, PURE = 0.85, 0.75
#: Characters on both sides of license language that may belong to the same copy, at least; REACHES times the longest template if that is more.
REACH, REACHES = 2000, 3
#: Share of an edited copy's fall that a window must reach; the rest is for what a copy shares with the words around it.
SLACK = 0.5
_WORD = re.compile(r"[\w.+-]*\w")
_hint = re.compile(HINT)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.words = {k: words(v) for k, v in sorted(templates.items())}
        self.reach = max([REACH, *(REACHES * len(v) for v in templates.values())])
        # Literals stay as they are with this strategy and target: entropy codes of few literals would hide what matches save.
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=12, chain_log=12, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False)
        self.plain = zstandard.ZstdCompressor(compression_params=how)
        self.given = {
            k: zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(" ".join(v).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k, v in self.words.items()
        }
        self.size = {k: int(len(v) / PURE) + 1 for k, v in self.words.items()}
        self.least = {k: max(1, int(SLACK * self.fall(self.edited(v), k)[0])) for k, v in self.words.items()}

    @staticmethod
    def edited(want: list[str]) -> list[str]:
        """A copy with as many words missing, and as many added, as a confirmed one may have, spread evenly."""
        out, kept, added = [], 0, 0
        for i, w in enumerate(want, 1):
            if int(i * (1 - FOUND) + 1e-9) > i - kept - 1:
                continue
            out.append(w)
            kept += 1
            if added < int(kept / PURE) - kept:
                out.append(f"zq{added}")
                added += 1
        return out

    def fall(self, stretch: list[str], name: str) -> tuple[int, int, int]:
        """By how much the template makes the stretch's size fall, the plain size, and the size given the template."""
        raw = " ".join(stretch).encode("utf-8")
        plain, given = len(self.plain.compress(raw)), len(self.given[name].compress(raw))
        return plain - given, plain, given

    def blocks(self, text: str):
        """Ranges of characters within reach of license language; those that touch are one."""
        start = end = None
        for m in _hint.finditer(text):
            if start is not None and m.start() - self.reach <= end:
                end = m.end() + self.reach
            else:
                if start is not None:
                    yield start, end
                start, end = max(0, m.start() - self.reach), m.end() + self.reach
        if start is not None:
            yield start, min(end, len(text))

    def windows(self, n: int):
        """(template, first, end) over n words: each stretch as long as a confirmed one may be lies in one of them."""
        for name, size in self.size.items():
            for i in range(0, max(1, n - size), size):
                yield name, i, min(n, i + 2 * size)

    def confirm(self, stretch: list[str], name: str):
        """Share of the template's words found in order, those missing, those added, first place and end; None if too few.

        Of all alignments with a part of the stretch, the one with most words found less half of those added; the
        first of equal ones.
        """
        want = self.words[name]
        n = len(want)
        if (Counter(want) & Counter(stretch)).total() < FOUND * n:
            return None
        at = np.array(want, dtype=object)
        hits = {w: at == w for w in set(want) & set(stretch)}
        score = np.zeros((len(stretch) + 1, n + 1))
        for i, w in enumerate(stretch, 1):
            row = score[i]
            row[1:] = score[i - 1, 1:] - 0.5
            if w in hits:
                row[1:] = np.maximum(row[1:], np.where(hits[w], score[i - 1, :-1] + 1, 0))
            np.maximum.accumulate(row, out=row)
        end = i = int(score[:, n].argmax())
        j, found = n, []
        while score[i, j] > 0:
            if want[j - 1] == stretch[i - 1] and score[i, j] == score[i - 1, j - 1] + 1:
                i, j = i - 1, j - 1
                found.append((j, i))
            elif score[i, j] == score[i, j - 1]:
                j -= 1
            else:
                i -= 1
        if len(found) < FOUND * n or len(found) < PURE * (end - found[-1][1]):
            return None
        have, used = {f[0] for f in found}, {f[1] for f in found}
        missing = [w for k, w in enumerate(want) if k not in have]
        added = [stretch[k] for k in range(found[-1][1], end) if k not in used]
        return len(found) / n, missing, added, found[-1][1], end

    def winners(self, own: list[str]):
        """(license, first word, end, plain size, given size, share, missing, added), the largest fall first."""
        taken, heap = bytearray(len(own)), []

        def rank(name: str, i: int, j: int) -> None:
            if j - i < FOUND * len(self.words[name]):
                return
            fall, plain, given = self.fall(own[i:j], name)
            if fall >= self.least[name]:
                heapq.heappush(heap, (-fall, name, i, j, plain, given))

        for window in self.windows(len(own)):
            rank(*window)
        while heap:
            _, name, i, j, plain, given = heapq.heappop(heap)
            if 1 in taken[i:j]:
                # Words went to another license since: what is left of the window is ranked again.
                for m in re.finditer(rb"\x00+", taken[i:j]):
                    rank(name, i + m.start(), i + m.end())
            elif ok := self.confirm(own[i:j], name):
                share, missing, added, first, last = ok
                taken[i + first : i + last] = b"\x01" * (last - first)
                yield name, i + first, i + last, plain, given, share, missing, added
                rank(name, i, i + first)
                rank(name, i + last, j)

    def scan(self, text: str):
        """(license, start, end, plain size, given size, share, missing, added) of confirmed copies, by place."""
        for start, end in self.blocks(text):
            spans = [m.span() for m in _WORD.finditer(text, start, end)]
            own = [text[a:b].lower() for a, b in spans]
            for name, first, last, plain, given, share, missing, added in sorted(self.winners(own), key=lambda w: w[1:3]):
                yield name, spans[first][0], spans[last - 1][1], plain, given, round(share, 6), " ".join(missing), " ".join(added)


_FIELDS = [("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain_bytes", pa.int64()), ("given_bytes", pa.int64()), ("found", pa.float64()), ("missing", pa.string()), ("added", pa.string())]
SCHEMA = "doc_id long, license string, start long, end long, plain_bytes long, given_bytes long, found double, missing string, added string"


def _scan(templates: dict[str, str]):
    def run(batches):
        scanner = Scanner(templates)
        for ids, texts in tv.rows(batches, ["doc_id", "text"]):
            out = [(d, *m) for d, t in zip(ids.to_pylist(), texts, strict=True) for m in scanner.scan(t.as_py() or "")]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], [f for f, _ in _FIELDS])

    return run


def license_matches(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per confirmed copy of a license; start and end are its own, in characters, sizes those of its window."""
    hinted = documents.select("doc_id", "text").where(F.col("text").rlike(HINT))
    return hinted.mapInArrow(_scan(templates or TEMPLATES), SCHEMA)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
