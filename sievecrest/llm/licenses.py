"""License scans by patience alignment.

A text and a license template are aligned like two versions of a file: words that stand once in
either are anchors, the longest run of anchors in the same order in both is kept, and the gaps
between them are aligned in the same way; at the ends of a gap equal words are taken first. The
share of the template's words that are aligned is its coverage. Notices of up to ``SHORT`` words differ
from those of other licenses in a word or two, so they must stand in the text word for word.

Whole texts are scanned. An alignment that covers a template to the least share leaves out fewer than
a number of its positions, so it takes one at least of that many rarest ones, whichever they are: every
place in the text where such a position's word occurs proposes the window in which the template would
lie, with ``SLACK`` of its length to either side. Windows are aligned one by one, so a notice that a text
repeats, or that stands in a long text, still has anchors. Words are lower-case runs of letters and digits.

Nulls and ties: a null text is an empty one and has no license; of templates with equal coverage the
longer one wins, then the smaller name; of equal windows the first; equal rows get equal results; an
empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import small_batches, text_bytes

MIN_COVERAGE = 0.8
SLACK = 0.25
SHORT = 14  # words of a notice that must stand in a text word for word

# Notices as their licenses word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "BSD-notice": "Released under the BSD License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "Artistic-2.0-notice": "Licensed under the Artistic License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
}

# The GNU notices differ from this one by name and version.
TEMPLATES |= {
    name: TEMPLATES["GPL-3.0"].replace("GNU General", kind).replace("version 3", version)
    for name, kind, version in (
        ("GPL-2.0", "GNU General", "version 2"),
        ("LGPL-2.1", "GNU Lesser General", "version 2.1"),
        ("LGPL-3.0", "GNU Lesser General", "version 3"),
        ("AGPL-3.0", "GNU Affero General", "version 3"),
    )
}

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence (patience piles with back links)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect.bisect_left(tops, v)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
        back[i] = piles[at - 1] if at else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience_align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions in order.

    Equal words at the ends of a gap are taken only beside an anchor: the borders of the whole text
    say nothing. Without any anchor the whole is taken as one gap.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template), False, False)]
    while todo:
        a0, a1, b0, b1, left, right = todo.pop()
        while left and a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while right and a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_text, in_template = Counter(text[a0:a1]), Counter(template[b0:b1])
        where = {template[j]: j for j in range(b0, b1) if in_template[template[j]] == 1}
        anchors = [(i, where[text[i]]) for i in range(a0, a1) if in_text[text[i]] == 1 and text[i] in where]
        chosen = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        pairs += chosen
        borders = [(a0 - 1, b0 - 1), *chosen, (a1, b1)]
        if chosen:
            for k, ((i, j), (m, n)) in enumerate(zip(borders, borders[1:])):
                todo.append((i + 1, m, j + 1, n, left or k > 0, right or k < len(chosen)))
        elif not (left or right):
            todo.append((a0, a1, b0, b1, True, True))
    return sorted(pairs)


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: words_of(text.encode()) for name, text in templates.items()}

    def scan(self, text: bytes, least: float) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, last word) of the best window of every template covered to ``least``."""
        words = words_of(text)
        where: dict[bytes, list[int]] = {}
        wanted = {w for t in self.words.values() for w in t}
        for i, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(i)
        found = []
        for name, template in self.words.items():
            present = sum(w in where for w in template)
            if not template or present < least * len(template):
                continue  # alignment can never cover more
            if len(template) <= SHORT:
                at = self._verbatim(words, where, template)
                if at is not None:
                    found.append((name, 1.0, at, at + len(template) - 1))
                continue
            best = max((self._window(words, template, a, b) for a, b in self._windows(where, template, len(words), least)), default=None)
            if best and best[0] >= least:
                found.append((name, best[0], -best[1], best[2]))
        return sorted(found, key=lambda f: (-f[1], -len(self.words[f[0]]), f[0]))

    @staticmethod
    def _verbatim(words: list[bytes], where: dict[bytes, list[int]], template: list[bytes]) -> int | None:
        """First place where the template stands word for word."""
        if any(w not in where for w in template):
            return None
        rarest = min(range(len(template)), key=lambda j: len(where[template[j]]))
        starts = (i - rarest for i in where[template[rarest]] if i >= rarest)
        return next((a for a in starts if words[a : a + len(template)] == template), None)

    @staticmethod
    def _windows(where: dict[bytes, list[int]], template: list[bytes], n: int, least: float) -> Iterator[tuple[int, int]]:
        size, slack = len(template), max(2, int(SLACK * len(template)))
        spare = size - math.ceil(least * size - 1e-9)
        rarest = sorted(range(size), key=lambda j: (len(where.get(template[j], ())), j))[: spare + 1]
        starts = sorted({max(0, i - j - slack) for j in rarest for i in where.get(template[j], ())})
        last = None
        for start in starts:
            if last is None or start > last + slack // 2:
                yield start, min(n, start + size + 2 * slack + slack // 2)
                last = start

    @staticmethod
    def _window(words: list[bytes], template: list[bytes], a: int, b: int) -> tuple[float, int, int]:
        pairs = patience_align(words[a:b], template)
        if not pairs:
            return 0.0, -a, a
        return len(pairs) / len(template), -(a + pairs[0][0]), a + pairs[-1][0]


def scan_licenses(
    df: DataFrame, id_col: str, text_col: str, templates: dict[str, str] | None = None, least: float = MIN_COVERAGE
) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, licenses) of every row; nulls where there is none."""
    templates = templates or TEMPLATES
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            found = [known.scan(t, least) for t in text_bytes(batch.column(1))]
            best = [f[0] if f else (None, None, None, None) for f in found]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([b[i] for b in best], kind) for i, kind in enumerate(kinds)]
            names = pa.array([sorted(f[0] for f in fs) for fs in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, names], ["doc_id", "license", "coverage", "first_word", "last_word", "licenses"]
            )

    schema = f"doc_id {id_type}, license string, coverage double, first_word long, last_word long, licenses array<string>"
    return rows.mapInArrow(scan, schema)
