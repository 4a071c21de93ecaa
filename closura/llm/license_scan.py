"""License scans by conditional compression (operator 6).

Lines with words that license notices use are candidates, with text around them that
holds the longest template on either side.  Each such block is compressed with zstandard,
alone and with every template as a raw dictionary; templates are ranked by how much
smaller it gets.  The best ``2 * TOP``, and all others if none of them is there, are then
confirmed word by word: the words of a stretch of the block are aligned with the template's (longest common subsequence), at least
``COVER`` of the template must be there in order, and all of its ``must`` words; what
differs is reported.  A template whose words are all there is exact.

A block may hold several notices: confirmed words are taken out and the rest is looked
at again.

Cases: null or empty text has no license; blocks that many documents share are worked
out once by each worker; spans are in code points, end exclusive; ties between templates
go to the longer match, then the name; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import LEAVING, lean

TOP = 4
COVER = 0.85
LONGEST = 4000  # characters of a block; longer ones are cut at lines, or at blanks

#: Substrings of lower-cased text that make its line a candidate (fixed values).
CUES = ("licen", "copyright", "permission", "redistribut", "warrant", "spdx", "public domain", "creative commons", "cc by", "cc0")

#: The same, where a line may end between words.
CUE = re.compile("|".join(re.escape(c).replace(r"\ ", r"[\W_]{1,40}") for c in CUES))

#: Notices (fixed values): name -> (words that must be there, texts).
TEMPLATES: dict[str, tuple[str, list[str]]] = {
    "MIT": ("mit", [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"]),
    "MIT-text": ("", [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"]),
    "Apache-2.0": ("apache 2.0", [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."]),
    "GPL-3.0": ("3", [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 3.", "SPDX-License-Identifier: GPL-3.0-only"]),
    "GPL-2.0": ("2", [
        "This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"]),
    "LGPL-3.0": ("lesser 3", ["Licensed under the GNU Lesser General Public License, version 3."]),
    "AGPL-3.0": ("affero 3", ["Licensed under the GNU Affero General Public License, version 3."]),
    "MPL-2.0": ("mozilla 2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]),
    "BSD": ("", [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"]),
    "ISC": ("", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."]),
    "CC-BY-NC-4.0": ("nc 4.0", ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License (CC BY-NC 4.0)."]),
    "CC-BY-SA-4.0": ("sa 4.0", ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License (CC BY-SA 4.0)."]),
    "CC-BY-4.0": ("4.0", ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."]),
    "CC0-1.0": ("", ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."]),
    "Unlicense": ("", ["This is free and unencumbered software released into the public domain."]),
}

WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


class Template:
    def __init__(self, name: str, must: str, text: str):
        self.name, self.text = name, text
        self.words = WORD.findall(text.lower())
        self.must = set(must.split())
        self.masks: dict[str, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict((text + "\n").encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)


@lru_cache(1)
def templates() -> list[Template]:
    return [Template(name, must, text) for name, (must, texts) in TEMPLATES.items() for text in texts]


@lru_cache(1)
def plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False)


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, the last possible words of b."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: by characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def placed(t: Template, words: list[str]) -> list[tuple[int, int]]:
    """The alignment of the template with the stretch of ``words`` that holds most of it,
    of those the last and shortest; nothing if that's under ``COVER``.

    A stretch is at most half as long again as the template and 3 words.  One with too few
    of its words in any order is passed over, which loses nothing."""
    n = len(t.words)
    least, width = max(3, math.ceil(COVER * n - 1e-9)), int(1.5 * n + 3)
    sums = [0, *accumulate(w in t.masks for w in words)]
    best, at = least - 1, -1
    for j, w in enumerate(words):
        if w in t.masks and sums[min(j + width, len(words))] - sums[j] > best - (best >= least):
            got = common(t, words[j : j + width])
            if got >= max(best, least):
                best, at = got, j
    if at < 0:
        return []
    end = min(at + width, len(words))
    while common(t, words[at : end - 1]) == best:
        end -= 1
    return [(i, at + j) for i, j in aligned(t.words, words[at:end])]


def common(t: Template, words: list[str]) -> int:
    """Length of the longest common subsequence, a word of bits at a time (Hyyro 2004)."""
    full = (1 << len(t.words)) - 1
    v = full
    for w in words:
        m = t.masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(t.words) - v.bit_count()


@lru_cache(50_000)
def block_licenses(block: str) -> tuple[tuple[str, int, int, float, bool, str], ...]:
    """(name, start, end, size reduction, exact, differences) of the notices in a block."""
    found = []
    rest = [(m.group(), m.start(), m.end()) for m in WORD.finditer(lowered(block))]
    text = block
    while rest:
        data = text.encode()
        alone = len(plain().compress(data))
        gains = sorted(((alone - len(t.compressor.compress(data))) / alone, i) for i, t in enumerate(templates()))[::-1]
        winner = None
        for k, (gain, i) in enumerate(gains):
            if k == 2 * TOP and winner is not None:
                break  # the other templates are tried only if none of these is there
            t = templates()[i]
            words = [w for w, _, _ in rest]
            pairs = placed(t, words)
            if not pairs:
                continue
            own = {words[j] for _, j in pairs}
            if not all(any(w == m or w.startswith(f"{m}.") for w in own) for m in t.must):
                continue
            inside = words[pairs[0][1] : pairs[-1][1] + 1]
            used = {i for i, _ in pairs}
            missing = [w for k, w in enumerate(t.words) if k not in used]
            taken = {j for _, j in pairs}
            extra = [w for j, w in enumerate(inside, pairs[0][1]) if j not in taken]
            rank = (len(pairs) - len(missing) - len(extra), gain, t.name)
            if winner is None or rank > winner[0]:
                winner = (rank, t.name, pairs, gain, missing, extra)
        if winner is None:
            break
        _, name, pairs, gain, missing, extra = winner
        a, b = rest[pairs[0][1]][1], rest[pairs[-1][1]][2]
        differences = " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in extra])
        found.append((name, a, b, round(gain, 4), not missing and not extra, differences))
        rest = rest[: pairs[0][1]] + rest[pairs[-1][1] + 1 :]
        text = block[:a] + block[b:] if len(found) == 1 else " ".join(w for w, _, _ in rest)
        if not CUE.search(text.lower()):
            break
    return tuple(sorted(found, key=lambda f: f[1:3]))


LEAVING.append(block_licenses.cache_clear)


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans around candidate lines, joined where they touch.  A joined span that would be
    over ``LONGEST`` goes on in another that overlaps it by the lines' surroundings."""
    around = 2 * max(len(t.text) for t in templates())
    out: list[list[int]] = []
    for m in CUE.finditer(lowered(text)):
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b = len(text) if b < 0 else b
        if b - a > LONGEST:  # of a very long line, the part around the words
            a, b = max(a, m.start() - LONGEST // 4), min(b, m.end() + LONGEST // 4)
        # notices are wrapped: their other lines may have none of the words
        a, b = max(0, a - around), min(len(text), b + around)
        if out and a <= out[-1][1] + 1 and b - out[-1][0] <= LONGEST:
            out[-1][1] = max(b, out[-1][1])
        elif not out or b > out[-1][1]:
            out.append([a, b])
    return [(a, b) for a, b in out]


def licenses(text: str) -> list[tuple[str, int, int, float, bool, str]]:
    """The notices of a text; of those found in two overlapping blocks the longer one."""
    out: list = []
    for a, b in blocks(text):
        for n, x, y, *rest in block_licenses(text[a:b]):
            out.append((n, a + x, a + y, *rest))
    kept: list = []
    for f in sorted(out, key=lambda f: (f[1] - f[2], f[1], f[0])):
        if all(f[2] <= g[1] or f[1] >= g[2] for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[1:3])


KIND = "array<struct<name: string, start: long, end: long, gain: double, exact: boolean, differences: string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses: what is found in each text, in order of its place."""
    item = pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64()), ("exact", pa.bool_()), ("differences", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                rows.append([{"name": n, "start": a, "end": b, "gain": g, "exact": e, "differences": d} for n, a, b, g, e, d in (licenses(t) if t else ())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(item))], names=["doc_id", "licenses"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id long, licenses {KIND}")
