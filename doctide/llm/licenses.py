"""Operator 8, license scans.

Templates are cut into tokens (runs of letters and digits, lower case), and all their token triples are hashed, or pairs if
they have fewer than SHORT tokens: a template that keeps COVERAGE of its tokens keeps one of these whole.  They make an
inverted index from hash to (template, place).  A document looks all its pairs and triples up; hits of one template on
neighbouring diagonals make a candidate.  If enough of the template's tokens stand there at all, a banded alignment of
template and document around these diagonals tells which tokens match, what part of the template they cover and the span
they take.  So a long template costs little where a text only shares a phrase with it.  Everything happens where a text is read: the index is a table of templates, checked to be
small, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shingles_of, table, text_chunks, words_of

TRIPLE = 3
#: Templates of fewer tokens are indexed by pairs.
SHORT = 10
BAND = 8
COVERAGE = 0.8
MOST_TEMPLATE_BYTES = 1 << 20
#: Bytes between tokens: all ASCII but letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Fixed texts of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "ARR": "All rights reserved.",
}


def tokens_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]), apart=APART)[3]


class TemplateIndex:
    """Inverted index of the triples, or pairs, of templates (name -> text)."""

    def __init__(self, templates: dict[str, str]):
        if sum(len(t.encode()) for t in templates.values()) > MOST_TEMPLATE_BYTES:
            raise ValueError(f"templates of more than {MOST_TEMPLATE_BYTES} bytes")
        self.names, self.tokens = list(templates), [tokens_of(t) for t in templates.values()]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for t, tokens in enumerate(self.tokens):
            if len(tokens):
                width = min(len(tokens), TRIPLE if len(tokens) >= SHORT else 2)
                hashes = shingles_of(np.zeros(len(tokens), np.int64), tokens, width)[1][: len(tokens) - width + 1]
                found.setdefault(width, []).extend((h, t, p) for p, h in enumerate(hashes.tolist()))
        self.tables = []
        for width, entries in sorted(found.items()):
            entries.sort()
            hashes, coarse = np.array([e[0] for e in entries], np.uint64), np.zeros(1 << 16, bool)
            coarse[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((width, hashes, np.array([e[1:] for e in entries], np.int64).reshape(-1, 2), coarse))

    def hits(self, row: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, template and place in it of every pair or triple with equal hashes."""
        out = [np.zeros((3, 0), np.int64)]
        for width, hashes, places, coarse in self.tables:
            first, grams = shingles_of(row, tokens, width)
            maybe = np.flatnonzero(coarse[(grams >> np.uint64(48)).astype(np.int64)])
            low, high = np.searchsorted(hashes, grams[maybe]), np.searchsorted(hashes, grams[maybe], "right")
            n = high - low
            entry = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            out.append(np.stack([first[np.repeat(maybe, n)], *places[entry].T]))
        return tuple(np.concatenate(out, axis=1))


def band_of(n: int) -> int:
    """Diagonals on either side of a hit that an alignment of n tokens may use; short templates may stand close together."""
    return min(BAND, max(1, n // 3))


def candidates(at: np.ndarray, place: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Lowest and highest diagonal (token of the text less token of the template) of each group of neighbouring hits."""
    found: list[tuple[int, int]] = []
    for d in np.unique(at - place).tolist():
        if found and d - found[-1][1] <= band and d - found[-1][0] <= 4 * band:
            found[-1] = (found[-1][0], d)
        else:
            found.append((d, d))
    return found


def aligned(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Matches, and first and last matched token of text, of the longest common subsequence within diagonals low to high.

    Of equally long ones that of the shortest span counts, then the first.
    """
    width = high - low + 1
    none = (0, 0, -1)
    row = [none] * width  # best of the template so far with text up to token i - 1 + low + k
    for i, token in enumerate(template):
        new = [none] * width
        for k in range(width):
            j = i + low + k
            best = row[k + 1] if k + 1 < width else none
            if k and (left := new[k - 1]) != none and _better(left, best):
                best = left
            if 0 <= j < len(text) and text[j] == token:
                n, first, _ = row[k]
                step = (n + 1, first if n else j, j)
                if _better(step, best):
                    best = step
            new[k] = best
        row = new
    best = none
    for x in row:
        if _better(x, best):
            best = x
    return best


def _better(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    return (a[0], a[1] - a[2], -a[1]) > (b[0], b[1] - b[2], -b[1])


def matches(index: TemplateIndex, texts: pa.Array) -> list[tuple[int, str, int, float, int, int]]:
    """(row, template, matched tokens, coverage, first and end byte) of every match that covers COVERAGE of its template.

    A span that is one template word for word is no edit of another one, though most of their tokens may agree.
    """
    out = []
    for at, _, raw, offsets in text_chunks(texts):
        starts, ends, row, tokens = words_of(raw, offsets, apart=APART)
        if not len(row):
            continue
        word, template, place = index.hits(row, tokens)
        begin = np.searchsorted(row, row[word])
        for r, t in sorted(set(zip(row[word].tolist(), template.tolist(), strict=True))):
            mine = (row[word] == r) & (template == t)
            b = int(begin[mine][0])
            last, band = -1, band_of(len(index.tokens[t]))
            for low, high in candidates(word[mine] - b, place[mine], band):
                low, high = low - band, high + band
                lo, hi = max(0, low), max(0, high + len(index.tokens[t]))
                end = int(np.searchsorted(row, r, "right"))
                around = tokens[b + lo : min(b + hi, end)]
                if np.isin(index.tokens[t], around).sum() < COVERAGE * len(index.tokens[t]):
                    continue  # no alignment matches tokens that are not there
                n, f, e = aligned(index.tokens[t].tolist(), around.tolist(), low - lo, high - lo)
                if n and n >= COVERAGE * len(index.tokens[t]) and lo + f > last:
                    last = lo + e
                    out.append((at + r, index.names[t], n, n / len(index.tokens[t]), int(starts[b + lo + f] - offsets[r]), int(ends[b + lo + e] - offsets[r])))
    exact = {(r, first, end) for r, _, _, coverage, first, end in out if coverage == 1}
    return [x for x in out if x[3] == 1 or (x[0], *x[4:]) not in exact]


FOUND = "doc_id long, license string, n_matched int, coverage double, first_byte long, end_byte long, matched_text string"


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """FOUND for every place of docs (doc_id, text) that matches a template; null and empty texts match none.

    Repeated rows are each reported.  A template in another one is reported beside it.  Matches of one template do not overlap.
    """
    index = TemplateIndex(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matches(index, batch.column("text"))
            if found:
                rows, names, n, coverage, first, end = zip(*found, strict=True)
                texts = batch.column("text").take(pa.array(rows)).to_pylist()
                cut = [t.encode()[a:b].decode(errors="replace") for t, a, b in zip(texts, first, end, strict=True)]
                columns = [batch.column("doc_id").take(pa.array(rows)), pa.array(names), pa.array(n, pa.int32()), pa.array(coverage), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(cut)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "n_matched", "coverage", "first_byte", "end_byte", "matched_text"])

    return docs.select("doc_id", "text").mapInArrow(scan, FOUND)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 6))


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE: dict[str, str] = {}
