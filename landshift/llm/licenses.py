"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are few and known beforehand; their winnowed word-gram fingerprints form an
inverted index that is broadcast, with a checked bound on its size. Every gram of a
document is looked up, so a fingerprint of a template is found wherever it stands. Hits of
a template on neighbouring diagonals make one candidate, which is aligned word by word
inside a band around them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

GRAM, PAIR = 3, 2
WINNOW = 4  # of so many grams in a row one is a fingerprint at least
BAND = 12  # words that copies may gain or lose against the template
LEAST = 0.8  # coverage reported
MATCH = 2  # score of an equal word against -1 of any other step, so that one changed word after the first does not cut a line
INDEX_WORDS = 200_000  # words of all templates together
CACHED_WORDS = 400_000
_R = np.uint64(0x9E3779B97F4A7C15)

# Wordings of public licences.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "reserved-line": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


class _Hashes(dict):
    """Hash of a token's letters and digits in lower case; 0 for a token without any."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        core = "".join(filter(str.isalnum, token.lower()))
        self[token] = out = xxhash.xxh3_64_intdigest(core) | 1 if core else 0
        return out


_HASHES = _Hashes()


def token_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens that have letters or digits, and their places among all tokens."""
    tokens = text.split()
    hashes = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    places = np.flatnonzero(hashes)
    return hashes[places], places


def grams(words: np.ndarray, gram: int = GRAM) -> np.ndarray:
    n = max(0, len(words) - gram + 1)
    out = words[:n].copy()
    for k in range(1, gram):
        out = out * _R + words[k:n + k]
    return out ^ (out >> np.uint64(29))


def winnow(hashes: np.ndarray, width: int = WINNOW) -> list[int]:
    """Positions of the fingerprints: the rightmost smallest hash of every `width` neighbours."""
    picked: list[int] = []
    for i in range(max(1, len(hashes) - width + 1) if len(hashes) else 0):
        window = hashes[i:i + width]
        at = i + len(window) - 1 - int(window[::-1].argmin())
        if not picked or picked[-1] != at:
            picked.append(at)
    return picked


class TemplateIndex:
    """Inverted index from fingerprint to (template, position)."""

    def __init__(self, templates: dict[str, str], least: float = LEAST) -> None:
        self.names = sorted(templates)
        self.words = [token_hashes(templates[n])[0] for n in self.names]
        if sum(map(len, self.words)) > INDEX_WORDS:
            raise ValueError(f"templates of more than {INDEX_WORDS} words are not broadcast")
        # by gram length; a short template has all its grams there, and pairs where a changed word can leave no longer gram
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {GRAM: defaultdict(list), PAIR: defaultdict(list)}
        for t, words in enumerate(self.words):
            hashes = grams(words)
            # one changed word may leave no run of words that holds a fingerprint for sure
            short = len(words) < 2 * (GRAM + WINNOW) - 1
            for at in range(len(hashes)) if short else winnow(hashes):
                self.places[GRAM][int(hashes[at])].append((t, at))
            changed = len(words) - int(np.ceil(least * len(words) - 1e-9))
            if short and changed and -(-(len(words) - changed) // (changed + 1)) < GRAM:
                for at, h in enumerate(grams(words, PAIR).tolist()):
                    self.places[PAIR][h].append((t, at))
        self.filter = {}
        for gram, places in self.places.items():
            self.filter[gram] = np.zeros(1 << 16, dtype=bool)
            self.filter[gram][np.array([h & 0xFFFF for h in places], dtype=np.int64)] = True

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(template, hits) of each cluster of neighbouring diagonals; a hit is (diagonal, place in the document)."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gram, places in self.places.items():
            hashes = grams(words, gram)
            for at in np.flatnonzero(self.filter[gram][(hashes & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                for template, place in places.get(int(hashes[at]), ()):
                    hits[template].append((at - place, at))
        for template, found in hits.items():
            found.sort()
            start = 0
            for i in range(1, len(found) + 1):
                if i == len(found) or found[i][0] - found[i - 1][0] > BAND:
                    yield template, found[start:i]
                    start = i

    def matches(self, words: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
        """(template, matched, start, end) of what is covered to at least `least`.

        Each alignment takes the words and hits it covers away, so that copies close to each other are all found.
        """
        for template, hits in self.candidates(words):
            free = words.copy()
            while hits:
                low = hits[0][0]
                high = max(d for d, _ in hits if d <= low + BAND)
                matched, start, end = align(self.words[template], free, low, high)
                enough = matched >= least * len(self.words[template])
                if enough:
                    yield template, matched, start, end
                    free[start:end] = 0  # no word of a template
                rest = [h for h in hits if not start <= h[1] < end] if enough else [h for h in hits if h[0] > high]
                hits = rest if len(rest) < len(hits) else hits[1:]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment on the diagonals low - band to high + band."""
    left, width = low - band, high - low + 2 * band + 1
    before: list[tuple[int, int, int]] = [(0, 0, -1)] * (width + 2)
    best = (0, 0, 0, 0)
    for i, t in enumerate(template.tolist()):
        now: list[tuple[int, int, int]] = [(0, 0, -1)] * (width + 2)
        for k in range(1, width + 1):
            j = i + left + k - 1
            if not 0 <= j < len(words):
                continue
            if int(words[j]) == t:
                score, matched, start = before[k]
                cell = (score + MATCH, matched + 1, j if start < 0 else start)
            else:
                score, matched, start = max(before[k], before[k + 1], now[k - 1], key=lambda c: c[0])
                cell = (score - 1, matched, start) if score > 1 else (0, 0, -1)
            now[k] = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        before = now
    return best[1:]


def scan(text: str, index: TemplateIndex, least: float = LEAST) -> list[dict]:
    """Licences of one text, in order: template, matched words, coverage, and first and past-last token."""
    words, places = token_hashes(text)
    found = []
    for template, matched, start, end in index.matches(words, least):
        coverage = matched / len(index.words[template])
        found.append((matched, coverage, index.names[template], int(places[start]), int(places[end - 1]) + 1))
    found.sort(key=lambda m: (-m[0], -m[1], m[2], m[3]))
    chosen: list[tuple] = []
    for m in found:  # of overlapping matches the one with more words stays
        if all(min(m[4], c[4]) - max(m[3], c[3]) <= 0.5 * (m[4] - m[3]) for c in chosen):
            chosen.append(m)
    return [{"template": n, "matched": m, "coverage": round(c, 6), "start": a, "end": b} for m, c, n, a, b in sorted(chosen, key=lambda m: (m[3], m[2]))]


_FOUND = pa.list_(pa.struct([("template", pa.string()), ("matched", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch], shared, least: float) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for batch in batches:
        found = [scan(t.as_py(), index, least) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, _FOUND)], ["id", "licenses"])


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                  least: float = LEAST) -> DataFrame:
    """(id, licenses) per row; licenses is an array, empty where no template is covered to at least `least`.

    Spans count white-space separated tokens from 0. Case and signs do not matter. Null
    and empty texts have no licences; repeated rows and null ids stay; an empty table
    gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(TemplateIndex(TEMPLATES if templates is None else templates, least))
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    struct = "struct<template:string,matched:int,coverage:double,start:int,end:int>"
    return rows.mapInArrow(lambda it: _scan(it, shared, least), f"id {kind}, licenses array<{struct}>").withColumnRenamed("id", id_col)
