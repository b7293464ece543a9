"""License scans: MinHash bands over overlapping text windows retrieve license templates; the exact containment of the
template's word shingles in the window verifies each retrieved one.

A template of n shingles belongs to the power of two s >= 1.25 n; its windows have 2 s shingles and start every s, so an
occurrence stretched by a quarter lies whole in one of them. At a containment of 0.8 the Jaccard similarity with the window is
at least 0.15, and with 64 bands of one row the template is retrieved with a probability over 0.9999 (see recall_bound). A
window without any template shingle has no similarity to find, so only the others are hashed.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trajlytics.llm.common import id_and_text

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
PIECE_BYTES = 1 << 20
MATCHES = "doc_id long, template string, containment double, start_pos long, end_pos long"
BASE = np.uint64(0x9E3779B97F4A7C15)

# Public license notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions"
    ),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at"
    ),
    "BSD grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"
    ),
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at"
    ),
    "EPL-2.0 header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at"
    ),
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means"
    ),
    "Zlib grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions"
    ),
    "BSL-1.0 grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
        "Software, and to prepare derivative works of the Software"
    ),
    "CC0-1.0 waiver": "has waived all copyright and related or neighboring rights to",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MIT disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ),
    "BSD disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
}


def recall_bound(n_shingles: int, bands: int = BANDS, containment: float = CONTAINMENT) -> float:
    """Lower bound of the chance that a contained template is retrieved from its window."""
    shared = math.ceil(containment * n_shingles)
    similarity = shared / (2 * window_class(n_shingles) + n_shingles - shared)
    return 1 - (1 - similarity) ** bands


def window_class(n_shingles: int) -> int:
    s = 2
    while 4 * s < 5 * n_shingles:
        s *= 2
    return s


def word_table() -> np.ndarray:
    """Bytes of words: ASCII letters and digits and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[128:] = True
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = True
    return table


def hashed_words(data: np.ndarray, table: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of lower-cased UTF-8 bytes."""
    inside = table[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else None
    if place is None:
        place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))])
    with np.errstate(over="ignore"):
        value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * powers[place & 0xFFFF], np.uint64(0))
        return np.add.reduceat(value, starts) * BASE, starts, ends


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of every run of SHINGLE words."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    n = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, SHINGLE):
            h = h * BASE + words[k : k + n]
            h ^= h >> np.uint64(31)
        return h


def hash_powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(1 << 16, np.uint64(0x100000001B3)), dtype=np.uint64)


def min_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    factors = np.random.default_rng(3).integers(1, 1 << 63, (bands, 2), dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = values[None, :] * factors[:, :1] + factors[:, 1:]
        return ((mixed ^ (mixed >> np.uint64(32))) * BASE).min(axis=1)


class Retrieval:
    """Band index of the templates, by window class."""

    def __init__(self, templates: Mapping[str, str], bands: int) -> None:
        self.bands, self.names, self.sets = bands, list(templates), []
        self.index: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        table, powers = word_table(), hash_powers()
        for k, (name, text) in enumerate(templates.items()):
            words, _, _ = hashed_words(np.frombuffer(text.encode().lower(), np.uint8), table, powers)
            found = np.unique(shingles(words))
            if not len(found):
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            self.sets.append(found)
            for band, low in enumerate(min_hashes(found, bands).tolist()):
                self.index[window_class(len(found))][band, low].append(k)
        self.index = {s: dict(v) for s, v in self.index.items()}
        self.all = np.unique(np.concatenate(self.sets))
        bits = max(16, int(np.ceil(np.log2(64 * len(self.all)))))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.all >> self.shift] = True

    def matches(self, found: np.ndarray, owner: np.ndarray, containment: float) -> list[tuple[int, float, int, int]]:
        """(template, containment, first shingle, last shingle) for shingle hashes and the document of each; of overlapping
        matches of one template the best."""
        near = np.flatnonzero(self.seen[found >> self.shift])
        near = near[np.isin(found[near], self.all)]
        out: set[tuple[int, float, int, int]] = set()
        for size, index in self.index.items():
            for start in sorted({int(b) * size for b in np.unique(np.concatenate([near // size, near // size - 1])) if b >= -1}):
                place = np.arange(max(0, start), min(start + 2 * size, len(found)))
                for doc in np.unique(owner[place[np.isin(place, near)]]).tolist():
                    here = place[owner[place] == doc]
                    values = found[here]
                    hit = {k for key in enumerate(min_hashes(np.unique(values), self.bands).tolist()) for k in index.get(key, ())}
                    for k in hit:
                        shared = np.isin(values, self.sets[k])
                        share = len(np.unique(values[shared])) / len(self.sets[k])
                        if share >= containment:
                            at = here[shared]
                            out.add((k, share, int(at[0]), int(at[-1])))
        best: list[tuple[int, float, int, int]] = []
        last: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for m in sorted(out, key=lambda x: (-x[1], x[3] - x[2], x[0], x[2])):
            if all(m[3] < a or b < m[2] for a, b in last[m[0]]):
                last[m[0]].append((m[2], m[3]))
                best.append(m)
        return best


def scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per occurrence of a template in a document: the share of its shingles found, and the span in characters.

    One map without a shuffle. Words are runs of letters and digits, A-Z lower-cased. Texts of fewer than five words, empty
    and null ones match nothing; repeated rows repeat their matches; null ids stay null; an empty table gives no rows.
    """
    retrieval = Retrieval(templates, bands)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, powers = word_table(), hash_powers()

        def work(pieces: list[tuple[int, bytes]]) -> list[tuple]:
            data = np.frombuffer(b" ".join(p[1] for p in pieces).lower(), np.uint8)
            begins = np.cumsum([0, *(len(p[1]) + 1 for p in pieces)])
            words, starts, ends = hashed_words(data, table, powers)
            owner = np.searchsorted(begins, starts, side="right") - 1
            n = max(0, len(words) - SHINGLE + 1)
            whole = owner[:n] == owner[len(owner) - n :] if n else np.zeros(0, bool)
            found = np.where(whole, shingles(words), np.uint64(0))
            rows = []
            for k, share, first, last in retrieval.matches(found, owner[:n], containment):
                piece = int(owner[first])
                doc_id, raw = pieces[piece]
                a, b = int(starts[first] - begins[piece]), int(ends[last + SHINGLE - 1] - begins[piece])
                start = len(raw[:a].decode("utf-8", "replace"))
                rows.append((doc_id, retrieval.names[k], share, start, start + len(raw[a:b].decode("utf-8", "replace"))))
            return rows

        for batch in batches:
            rows: list[tuple] = []
            waiting: list[tuple[int, bytes]] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := text.as_py():
                    waiting.append((doc_id, text.encode("utf-8", "replace")))
                    size += len(text)
                if size >= PIECE_BYTES:
                    rows += work(waiting)
                    waiting, size = [], 0
            if waiting:
                rows += work(waiting)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(search, MATCHES)
