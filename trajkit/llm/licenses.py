"""License scans by conditional compression.

A block that repeats a template's wording shrinks much when it is compressed with the template as a raw dictionary. Every
template is aligned word by word with every block and confirmed by the exact words that the two differ in; where none holds,
the template that shrinks the block most is reported, unconfirmed.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajkit.llm.common import lean, row_slices

#: License notices as they are commonly worded. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "Copyright. All rights reserved.",
    "rights-reserved": "All rights reserved.",
}
#: Identifiers of the SPDX list that source files name in one line. Fixed values.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES |= {f"SPDX:{i}": f"SPDX-License-Identifier: {i}" for i in SPDX}
#: Words without which no block is looked at; line ends and comment marks may stand between them.
CUES = r"(?i)licen[sc]e|copyright|spdx|creative[\W_]+commons|permission[\W_]+is[\W_]+hereby|redistribution[\W_]+and[\W_]+use|all[\W_]+rights[\W_]+reserved"
#: Parts of hyphenated words are words, for lines may end at a hyphen.
_WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...], least: float) -> _Templates:
    return _Templates(templates, least)


class _Templates:
    """Templates laid side by side for alignment, with their compressors."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        import zstandard

        level = 3
        self.plain = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        self.names, self.words, self.primed = [], [], []
        for name, text in templates:
            known = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.names.append(name)
            self.words.append([w for w, _, _ in _words(text)])
            self.primed.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.sizes = np.array([len(w) for w in self.words])
        #: The most differing words with which each template is still confirmed, -1 for none.
        self.most = np.array([max((c for c in range(n) if (n - c) / n >= least), default=-1) for n in self.sizes.tolist()])
        longest = int(self.sizes.max())
        #: A confirmed notice has fewer words than this on each side of any word in it.
        self.reach = int((self.sizes + np.maximum(self.most, 0)).max())
        #: Costs of an alignment: a word put in, a missing word. The fewest differences count, then the fewest missing words.
        self.put_in, self.missing = longest + 1, longest + 2
        self.ramp = np.arange(longest + 1) * self.missing
        places: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for i, w in enumerate(words):
                places.setdefault(w, []).append((k, i))
        self.places = {w: tuple(np.array(p).T) for w, p in places.items()}

    def costs(self, words: list[str]) -> np.ndarray:
        """(words, templates): the least cost of each whole template in alignments that end with each word and begin with any."""
        at, out = np.arange(len(self.sizes)), np.empty((len(words), len(self.sizes)), dtype=np.int64)
        row = np.tile(self.ramp, (len(self.sizes), 1))
        for j, w in enumerate(words):
            now = row + self.put_in
            now[:, 0] = 0
            if w in self.places:
                k, i = self.places[w]
                now[k, i + 1] = np.minimum(now[k, i + 1], row[k, i])
            row = np.minimum.accumulate(now - self.ramp, axis=1) + self.ramp
            out[j] = row[at, self.sizes]
        return out

    def aligned(self, k: int, words: list[str]) -> list[tuple[int, int]]:
        """(place in template k, place in words) of the words matched in its cheapest alignment that ends with the last word."""
        own = self.words[k]
        rows = [[i * self.missing for i in range(len(own) + 1)]]
        for w in words:
            was, now = rows[-1], [0]
            for i, x in enumerate(own):
                now.append(min(now[i] + self.missing, was[i + 1] + self.put_in, was[i] if x == w else 1 << 60))
            rows.append(now)
        pairs, i, j = [], len(own), len(words)
        while i and j:
            if own[i - 1] == words[j - 1] and rows[j][i] == rows[j - 1][i - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif rows[j][i] == rows[j][i - 1] + self.missing:
                i -= 1
            else:
                j -= 1
        return pairs[::-1]

    def reductions(self, block: str) -> list[float]:
        data = block.lower().encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return [1 - len(c.compress(data)) / alone for c in self.primed]

    def differences(self, k: int, pairs: list[tuple[int, int]], words: list[str]) -> tuple[list[str], list[str]]:
        """(missing, put in): words of template k, and words between the first and the last match."""
        met, said = {i for i, _ in pairs}, {j for _, j in pairs}
        return [w for i, w in enumerate(self.words[k]) if i not in met], [words[j] for j in range(pairs[0][1], pairs[-1][1]) if j not in said]


def confirmed_notices(words: list[str], prepared: _Templates) -> list[tuple[int, int, int, list[str], list[str]]]:
    """(first, last + 1, template, missing, put in) of every notice among words that holds; no two share a word.

    All templates are aligned with all of words. The notice with the most template words met, less its differences, goes
    first; then what stands before and after it is looked at in the same way, until nothing holds.
    """
    costs = prepared.costs(words)
    differ = costs // prepared.put_in
    # A missing word costs one more than a word put in, and templates are shorter than put_in: the quotient counts both.
    heap = []
    for j, k in zip(*(x.tolist() for x in np.nonzero(differ <= prepared.most)), strict=True):
        n, c = int(prepared.sizes[k]), int(differ[j, k])
        heap.append(((c - n, c / n, int(costs[j, k]) % prepared.put_in), j, prepared.names[k], k))
    heapq.heapify(heap)
    taken, found = np.zeros(len(words), dtype=bool), []
    while heap:
        rank, j, name, k = heapq.heappop(heap)
        if taken[j]:
            continue
        n = int(prepared.sizes[k])
        low = max(0, j + 1 - n - int(prepared.most[k]))
        held = np.flatnonzero(taken[low:j])
        low += int(held[-1]) + 1 if len(held) else 0
        pairs = prepared.aligned(k, words[low : j + 1])
        if not pairs:
            continue
        missing, extra = prepared.differences(k, pairs, words[low : j + 1])
        c = len(missing) + len(extra)
        if c > prepared.most[k]:
            continue
        now = (c - n, c / n, len(missing))
        if now > rank:  # what it began with belongs to another notice
            heapq.heappush(heap, (now, j, name, k))
            continue
        first, stop = low + pairs[0][1], low + pairs[-1][1] + 1
        taken[first:stop] = True
        found.append((first, stop, k, missing, extra))
    return found


def _best_unconfirmed(text: str, words: list[tuple[str, int, int]], prepared: _Templates) -> tuple | None:
    """Of the template that shrinks the block of words most, the find that is not confirmed."""
    saved = prepared.reductions(text[words[0][1] : words[-1][2]])
    said = [w for w, _, _ in words]
    ends = prepared.costs(said).argmin(axis=0)
    for k in sorted(range(len(saved)), key=lambda k: (-saved[k], -prepared.sizes[k], prepared.names[k])):
        if saved[k] <= 0:
            return None
        pairs = prepared.aligned(k, said[: int(ends[k]) + 1])
        if pairs:
            missing, extra = prepared.differences(k, pairs, said)
            return prepared.names[k], round(saved[k], 6), words[pairs[0][1]][1], words[pairs[-1][1]][2], _listed(missing, extra), False
    return None


def _listed(missing: list[str], extra: list[str]) -> str:
    return " ".join([*(f"-{w}" for w in missing), *(f"+{w}" for w in extra)])


def notices(text: str, words: list[tuple[str, int, int]], cues: list[int], prepared: _Templates) -> Iterator[tuple[str, float, int, int, str, bool]]:
    """The finds, as best_template() gives them, among words of text: all that are confirmed, then the best one near each cue
    (a place in words) that is in no find yet, by the words between the confirmed ones."""
    held = sorted(confirmed_notices([w for w, _, _ in words], prepared))
    for first, stop, k, missing, extra in held:
        start, end = words[first][1], words[stop - 1][2]
        yield prepared.names[k], round(prepared.reductions(text[start:end])[k], 6), start, end, _listed(missing, extra), True
    firsts, stops, until = [h[0] for h in held], [h[1] for h in held], -1
    for p in cues:
        at = bisect_right(firsts, p)
        if (at and p < stops[at - 1]) or words[p][1] < until:
            continue
        low = max(p - prepared.reach, stops[at - 1] if at else 0)
        high = min(p + prepared.reach + 1, firsts[at] if at < len(held) else len(words))
        find = _best_unconfirmed(text, words[low:high], prepared)
        if find:
            yield find
            if find[2] <= words[p][1]:
                until = find[3]


def candidate_blocks(text: str, reach: int) -> Iterator[tuple[list[tuple[str, int, int]], list[int]]]:
    """(words, places of cues among them): all words of text that have at most reach words between them and a cue.

    Words are taken across line ends and comment marks. Blocks that would touch are one, so no word is in two.
    """
    cues = re.finditer(CUES, text)
    cue = next(cues, None)
    before, block, places = deque(maxlen=reach), [], []
    for m in _WORD.finditer(text):
        word, hit = (m[0].lower(), m.start(), m.end()), False
        while cue and cue.start() < m.end():
            cue, hit = next(cues, None), True
        if places and not hit and len(block) > places[-1] + 2 * reach:
            yield block[: places[-1] + reach + 1], places
            before.extend(block[places[-1] + reach + 1 :])
            block, places = [], []
        if hit and not places:
            block = list(before)
            before.clear()
        if hit:
            places.append(len(block))
        if places:
            block.append(word)
        else:
            if cue is None:
                break
            before.append(word)
    if places:
        yield block[: places[-1] + reach + 1], places


def best_template(block: str, templates: dict[str, str], least: float) -> tuple[str, float, int, int, str, bool] | None:
    """(template, reduction, start, end, differences, confirmed) of the confirmed notice with the most words, or else of the
    template that shrinks the block most.

    reduction is the share of the compressed size that the template saves: of the notice if it is confirmed, else of the
    block. Of templates that save nothing there is no best. The start and end are those of the words that the template's
    first and last matched words are aligned with, with the fewest differences that any alignment has. differences lists words
    taken from the template (-) and put in (+) between these; confirmed says that the share of the template's words that are
    met, less what is put in, is least or more.
    """
    prepared = _prepared(tuple(sorted(templates.items())), least)
    words = _words(block)
    finds = list(notices(block, words, [], prepared)) if words else []
    if finds:
        size = dict(zip(prepared.names, prepared.sizes.tolist(), strict=True))
        return max(finds, key=lambda f: size[f[0]] - len(f[4].split()))
    return _best_unconfirmed(block, words, prepared) if words else None


def _apart(rows: list[tuple]) -> list[tuple]:
    """Of overlapping finds of one template, which near cues may give, the one with the fewest differences."""
    kept: list[tuple] = []
    for row in sorted(rows, key=lambda r: (not r[5], len(r[4].split()), r[0])):
        if not any(k[2] == row[2] and k[0] < row[1] and row[0] < k[1] for k in kept):
            kept.append(row)
    return sorted(kept)


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, start, end, license, reduction, differences, confirmed of every candidate block of the whole texts.

    start and end are code points in the text. A block is what stands near a cue, over however many lines, wide enough for
    any template with the extra words that least allows. Nulls, empty texts and texts without a cue have no blocks; of
    overlapping finds of one template one stays. Repeated rows give repeated
    results, a null id stays null, an empty table gives none; other columns are not read.
    """
    chosen = templates or TEMPLATES
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _prepared(tuple(sorted(chosen.items())), least)
        for batch in batches:
            rows = []
            texts = (t for a, b in row_slices(batch.column(1)) for t in batch.column(1).slice(a, b - a).to_pylist())
            for i, t in enumerate(texts):
                found = [(f[2], f[3], f[0], f[1], f[4], f[5]) for words, cues in candidate_blocks(t, prepared.reach) for f in notices(t, words, cues, prepared)]
                rows += [(i, *row) for row in _apart(found)]
            at = pa.array([r[0] for r in rows], pa.int32())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "start", "end", "license", "reduction", "differences", "confirmed"])

    cued = lean(docs).select(F.col(doc_id), F.col(text)).where(F.rlike(F.col(text), F.lit(CUES)))
    return cued.mapInArrow(scan, f"doc_id {kind}, start long, end long, license string, reduction double, differences string, confirmed boolean")
