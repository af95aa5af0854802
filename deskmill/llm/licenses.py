"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage.

Words are runs of characters other than ASCII marks and white space, A-Z in lower case.  Each template is fingerprinted by winnowing its
k-word grams (the least hash of every ``window`` neighbours; all grams of a short template); the
inverted index of these fingerprints, whose size depends on the templates only, is broadcast.  A
document's grams are looked up in it, and every hit gives a template and a place; the template
is aligned there within a band.  Documents are read once and never shuffled.

A result row is one place of one template: coverage is the share of the template's words that
are matched in order, and the span is in words of the document.

Cases: null or blank texts match nothing; templates without words are ignored; a template that occurs
more than once in a text has a row for each place; repeated rows each give their rows; null doc_ids are kept;
a very long text is worked as one slice of its own; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.alignment import PAD_B, banded, padded, seed_hits
from deskmill.llm.words import U64, pieces, split_words, whole_windows, window_hashes

#: Public license notices (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

RESULT = "doc_id long, license string, coverage double, matched_words long, start_word long, end_word long"


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the winnowed grams: of every ``window`` neighbours the least, the last of equals."""
    if len(grams) <= window:
        return np.arange(len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    picked = len(grams) - 1 - (views.argmin(axis=1) + np.arange(len(views)))
    return np.unique(picked)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, gram: int = 3, window: int = 4, band: int = 8, min_coverage: float = 0.8) -> DataFrame:
    """Places of license templates in ``docs`` (doc_id, text) with at least ``min_coverage`` of the template matched."""
    names = list(templates := TEMPLATES if templates is None else templates)
    w = split_words(pa.array([templates[k] for k in names], pa.string()), lower=True, marks=True)
    words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    entries: dict[int, list] = {}
    for i, x in enumerate(words):
        if len(x):
            size = min(gram, len(x))
            grams = window_hashes(x, size)
            for p in winnow(grams, window).tolist() if len(x) >= 4 * window else range(len(grams)):
                entries.setdefault(size, []).append((int(grams[p]), i, p))
    index = {}
    for size, found in entries.items():
        found.sort()
        index[size] = np.array([e[0] for e in found], U64), np.array([e[1] for e in found]), np.array([e[2] for e in found])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                t, rows = split_words(part["text"], lower=True, marks=True), []
                doc_ids, keys = part["doc_id"].to_pylist(), [np.empty((0, 3), np.int64)]
                for size, (seeds, owner, offset) in index.items():
                    h = window_hashes(t.hash, size)
                    place, k = seed_hits(h, seeds)
                    ok = whole_windows(t.first, len(t.start), size)[place]
                    place, k = place[ok], k[ok]
                    doc = np.searchsorted(t.first, place, side="right") - 1
                    keys.append(np.stack([doc, owner[k], place - offset[k] - t.first[doc]], axis=1))
                keys = np.unique(np.concatenate(keys), axis=0)
                for i in np.unique(keys[:, 1]).tolist():
                    mine, found = keys[keys[:, 1] == i], set()
                    wide = min(band, max(1, len(words[i]) // 4))  # so that a neighbouring copy is out of reach
                    for at in range(0, len(mine), 1024):
                        some = mine[at : at + 1024]
                        begin = t.first[some[:, 0]] + some[:, 2] - wide
                        low, high = np.maximum(begin, t.first[some[:, 0]]), np.minimum(begin + len(words[i]) + 2 * wide, t.first[some[:, 0] + 1])
                        texts = [np.concatenate([np.full(l - b, PAD_B), t.hash[l:h]]) for b, l, h in zip(begin, low, high, strict=True)]
                        _, hits, first, last = banded(words[i], padded(texts, PAD_B, len(words[i]) + 2 * wide), wide)
                        for g in np.flatnonzero(hits >= min_coverage * len(words[i])).tolist():
                            base = int(some[g, 2]) - wide
                            found.add((int(some[g, 0]), base + int(first[g]), base + int(last[g]) + 1, int(hits[g])))
                    end: dict[int, int] = {}
                    for d, a, b, n in sorted(found, key=lambda x: (x[0], x[1], -x[3], x[2])):
                        if a >= end.get(d, -1):  # neighbouring seeds find one place
                            rows.append((doc_ids[d], names[i], n / len(words[i]), n, a, b))
                            end[d] = b
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "coverage", "matched_words", "start_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, RESULT)
