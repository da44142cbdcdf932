"""License scans: parts of a text are compared with licence templates by the Dice coefficient of their word bigrams.

Text and templates are normalised alike: ASCII lower case, words of digits, lower-case letters and non-ASCII characters. The
parts are lines, paragraphs (lines without a blank one between them) and the whole text. A part with m distinct bigrams
can reach a Dice coefficient of t only with templates of t / (2 - t) * m to (2 - t) / t * m bigrams; others aren't compared.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .scratch import small_batches

LEAST = 0.75

#: Notices as their licences word them.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def bigrams(words: np.ndarray) -> np.ndarray:
    return tk.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:])


class Templates:
    def __init__(self, texts: dict[str, str], least: float):
        self.least = least
        found = []
        for name, text in sorted(texts.items()):
            for _, _, words, _ in tk.hashed_words(pa.array([text]), tk.SYMBOLS):
                if grams := set(bigrams(words).tolist()):
                    found.append((len(grams), name, grams))
        found.sort(key=lambda t: t[:2])
        self.sizes = [t[0] for t in found]
        self.rows = found
        self.known = np.unique(np.array([g for t in found for g in t[2]], np.uint64))

    def best(self, grams: set[int]) -> tuple[float, str] | None:
        """The nearest template at the least coefficient or above; of equals, the first by name."""
        m, t = len(grams), self.least
        lo, hi = bisect_left(self.sizes, t / (2 - t) * m - 1e-9), bisect_right(self.sizes, (2 - t) / t * m + 1e-9)
        near = [(2 * len(grams & own) / (m + n), name) for n, name, own in self.rows[lo:hi]]
        return min(((-d, name) for d, name in near if d >= t), default=None)


UNITS = ("line", "paragraph", "text")


def parts(raw: np.ndarray, within: np.ndarray, starts: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For lines, paragraphs and texts: word ranges. A paragraph of one line and a text of one paragraph are left out."""
    breaks = np.flatnonzero(raw == 10)
    line_of = np.searchsorted(breaks, starts)  # line ends before each word
    new_doc = np.zeros(len(starts), bool)
    new_doc[at[:-1][at[:-1] < len(starts)]] = True
    new_line = new_doc.copy()
    new_line[1:] |= line_of[1:] != line_of[:-1]
    lines = np.flatnonzero(new_line)
    # A blank line has white space alone; a line of other separators has no words but ends no paragraph.
    dark = np.concatenate([[0], np.cumsum(~tk.WHITE[raw])])
    edges = np.concatenate([[0], breaks + 1, [len(raw)]])
    blank = dark[edges[1:]] == dark[edges[:-1]]
    blanks = np.concatenate([[0], np.cumsum(blank)])
    new_paragraph = new_doc.copy()
    new_paragraph[1:] |= blanks[line_of[1:]] != blanks[line_of[:-1]]
    paragraphs = np.flatnonzero(new_paragraph)
    texts = np.flatnonzero(new_doc)
    below: np.ndarray | None = None
    for unit, first in enumerate((lines, paragraphs, texts)):
        last = np.append(first[1:], len(starts)) if len(first) else first
        if below is not None and len(first):
            several = np.searchsorted(below, last) - np.searchsorted(below, first) > 1
            yield unit, first[several], last[several]
        else:
            yield unit, first, last
        below = first


def scan_batches(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("template", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        data, offsets = tk.text_bytes(batch.column(1))
        for a, b in tk.blocks(offsets):
            raw = data[offsets[a] : offsets[b]]
            low = tk.LOWER[raw]
            within = offsets[a : b + 1] - offsets[a]
            starts, ends, at = tk.word_spans(low, within, tk.SYMBOLS)
            words = tk.span_hashes(low, starts, ends)
            matches: list[list[dict]] = [[] for _ in range(b - a)]
            compared = np.zeros(b - a, np.int64)
            if len(words) > 1 and len(templates.known):
                grams = bigrams(words)
                place = np.minimum(np.searchsorted(templates.known, grams), len(templates.known) - 1)
                upto = np.concatenate([[0], np.cumsum(templates.known[place] == grams)])
                for unit, first, last in parts(raw, within, starts, at):
                    end = np.maximum(first, last - 1)
                    some = upto[end] > upto[first]
                    for x, y in zip(first[some].tolist(), last[some].tolist(), strict=True):
                        doc = int(np.searchsorted(at, x, "right")) - 1
                        compared[doc] += 1
                        if best := templates.best(set(grams[x : y - 1].tolist())):
                            base = within[doc]
                            matches[doc].append({"template": best[1], "dice": -best[0], "unit": UNITS[unit], "start": int(starts[x] - base), "end": int(ends[y - 1] - base)})
            top = [min(((-m["dice"], m["template"]) for m in found), default=(None, None)) for found in matches]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([t[1] for t in top], pa.string()),
                    pa.array([None if t[0] is None else -t[0] for t in top], pa.float64()),
                    pa.array([len(m) for m in matches], pa.int64()),
                    pa.array(compared, pa.int64()),
                    pa.array(matches, kind),
                ],
                ["doc_id", "license", "dice", "n_matches", "n_compared", "matches"],
            )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license and dice (the nearest template of any part; null without one), n_matches, n_compared (parts that share
    a bigram with any template) and matches (byte ranges of the text), one row for each row of ``docs``.

    Null and empty texts match nothing; equal coefficients go to the first name; repeated rows have repeated results. Other
    columns are not read. ``templates`` maps names to texts; those of fewer than two words match nothing.
    """
    small_batches(docs.sparkSession)
    known = Templates(TEMPLATES if templates is None else templates, least)
    schema = "doc_id long, license string, dice double, n_matches long, n_compared long, matches array<struct<template: string, dice: double, unit: string, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: scan_batches(it, known), schema)
