"""License notices: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment judges them.

Templates and texts are cut into words of ASCII letters, digits and bytes from 0x80 up, lower-cased.  The index holds
every 3-gram that is the smallest of 3 consecutive ones, so 5 shared words in a row cannot be missed.  All n-grams of short
templates (at most SHORT words) are looked up at every place of a text, 3-grams or, of templates of five words, 2-grams: a
notice with a coverage of MIN_COVERAGE and words changed or left out always shares one.  For each candidate the
hits of one diagonal band are gathered and the stretch of the text around them is aligned with the template inside
the band (longest common subsequence of words within BAND of the diagonal).  Coverage is the share of the template's
words that are matched in order.  A finding takes its stretch of the text, and the hits outside of it are aligned again.
A finding needs a coverage of MIN_COVERAGE; a template's findings in one text don't overlap, and of templates that claim
the same words the one with more matched words stays, then the one with the higher coverage, then the first by name.
The templates are a fixed, bounded set.  Null, empty and wordless texts have no findings.  Repeated rows are repeated.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import ALNUM, alnum_words, grams, hasher, prepare, winnow

GRAM, KEEP, BAND, MIN_COVERAGE, SHORT = 3, 3, 12, 0.8, 12
SCHEMA = "doc_id long, license string, template_words long, matched_words long, coverage double, start long, end long, n_spans long, spans string"

#: Public licence notices.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-short": "Licensed under CC BY 4.0",
    "CC-BY-NC-short": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-SA-short": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-short": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without permission",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def align(text: list, template: list, shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """Pairs (text word, template word) of a longest common subsequence with text - template within band of shift."""
    n, width = len(template), 2 * band + 1
    best = np.zeros((n + 1, width + 1), np.int32)  # column c: text index before it = row + shift - band + c
    for q in range(n - 1, -1, -1):
        for c in range(width - 1, -1, -1):
            p = q + shift - band + c
            skip = max(best[q + 1, c - 1] if c else 0, best[q, c + 1])
            best[q, c] = max(skip, best[q + 1, c] + 1) if 0 <= p < len(text) and text[p] == template[q] else skip
    pairs, q, c = [], 0, 0
    while q < n and c < width:
        p = q + shift - band + c
        if 0 <= p < len(text) and text[p] == template[q] and best[q, c] == best[q + 1, c] + 1:
            pairs.append((p, q))
            q += 1
        elif best[q, c] == best[q, c + 1]:
            c += 1
        else:
            q, c = q + 1, c - 1
            if c < 0:
                q, c = q, 0
    for i in range(len(pairs) - 2, -1, -1):  # each word as late as the next one allows, so that a notice isn't begun by a common word before it
        q = pairs[i][1]
        pairs[i] = next((p, q) for p in range(min(pairs[i + 1][0] - 1, q + shift + band), -1, -1) if text[p] == template[q])
    return pairs


def index(templates: dict[str, str]) -> dict:
    hashed, where, words = hasher(), {"winnowed": [], "pairs": [], "all": []}, {}
    for name, text in templates.items():
        words[name] = alnum_words(text.encode())
        n = len(words[name])
        kind = "winnowed" if n > SHORT else "pairs" if n == 5 else "all"
        g = grams(hashed(words[name]), 2 if kind == "pairs" else GRAM)
        where[kind] += [(g[q], name, int(q)) for q in (winnow(g, KEEP) if kind == "winnowed" else range(len(g)))]
    return {"words": words} | {kind: table(x) for kind, x in where.items()}


def table(where: list[tuple]) -> tuple[np.ndarray, list[tuple[str, int]]]:
    where = sorted(where, key=lambda x: x[0])
    return np.array([x[0] for x in where], np.uint64), [(x[1], x[2]) for x in where]


def hits(g: np.ndarray, places: np.ndarray, inverted: tuple) -> list[tuple[str, int, int]]:
    """Template, diagonal and place of every n-gram of the text at these places that the table holds."""
    keys, at = inverted
    lo = np.searchsorted(keys, g[places])
    found = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == g[places]) if len(keys) else []
    return [(at[j][0], int(places[i]) - at[j][1], int(places[i])) for i in found for j in range(lo[i], np.searchsorted(keys, g[places[i]], "right"))]


def find(ix: dict, words: list[bytes], h: np.ndarray) -> list[tuple[str, list[tuple[int, int]]]]:
    """Findings in the words of one text: template and matched pairs, by first word."""
    g, g2 = grams(h, GRAM), grams(h, 2)
    diagonals: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for name, shift, p in hits(g, winnow(g, KEEP), ix["winnowed"]) + hits(g, np.arange(len(g)), ix["all"]) + hits(g2, np.arange(len(g2)), ix["pairs"]):
        diagonals[name][shift].append(p)
    found = []
    for name, places in diagonals.items():
        template, free, ordered = ix["words"][name], None, sorted(places)
        n = len(template)
        while ordered:
            near = ordered[: bisect.bisect_right(ordered, ordered[0] + BAND)]
            shift = near[len(near) // 2]
            text = words if free is None else free
            around = set(text[max(0, shift - BAND) : max(0, shift + n + BAND)])
            # no more words than are there at all can be matched
            pairs = align(text, template, shift) if sum(w in around for w in template) >= MIN_COVERAGE * n else []
            if not pairs or len(pairs) < MIN_COVERAGE * n:
                ordered.remove(shift)
                continue
            found.append((name, pairs))
            b, e = pairs[0][0], pairs[-1][0] + 1
            free = list(words) if free is None else free
            free[b:e] = [None] * (e - b)
            i, j = bisect.bisect_left(ordered, b - n), bisect.bisect_right(ordered, e)
            ordered[i:j] = [s for s in ordered[i:j] if not all(b <= p < e for p in places[s])]
    kept, taken = [], bytearray(len(words))
    for name, pairs in sorted(found, key=lambda x: (-len(x[1]), len(ix["words"][x[0]]), x[0], x[1][0])):
        b, e = pairs[0][0], pairs[-1][0] + 1
        if not any(taken[b:e]):
            taken[b:e] = b"\1" * (e - b)
            kept.append((name, pairs))
    return sorted(kept, key=lambda x: x[1][0])


def spans(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of consecutive matched text words, end exclusive."""
    out: list[list[int]] = []
    for p, _ in pairs:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(a, b) for a, b in out]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each finding in docs (doc_id, text); start, end and spans in code points, end exclusive."""
    prepare(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        hashed, ix = hasher(), index(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = text.translate(ALNUM).split() if text else []
                if len(words) < GRAM:
                    continue
                h = hashed(words)
                # a text without any indexed 3-gram has no finding
                if not (got := find(ix, words, h)):
                    continue
                at = [m.span() for m in WORD.finditer(text)]
                wide = [0] + [i for i, c in enumerate(text) if c & 0xC0 != 0x80]
                point = lambda byte, wide=wide: bisect.bisect_left(wide, byte, 1) - 1
                for name, pairs in got:
                    cut = [(point(at[a][0]), point(at[b - 1][1])) for a, b in spans(pairs)]
                    n = len(ix["words"][name])
                    rows.append({"doc_id": doc_id, "license": name, "template_words": n, "matched_words": len(pairs), "coverage": len(pairs) / n, "start": cut[0][0], "end": cut[-1][1], "n_spans": len(cut), "spans": ",".join(f"{a}:{b}" for a, b in cut)})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template_words", pa.int64()), ("matched_words", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.string())])
