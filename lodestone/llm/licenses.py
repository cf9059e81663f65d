"""Operator 3: license notices by conditional compression."""

from __future__ import annotations

import difflib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording of public notices, each under its SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Proprietary": ("All rights reserved.",),
}
TRIGGER = re.compile(r"licen[sc]e|copyright|permission is hereby|permission to use|public domain|redistribut|free software|rights reserved|creative commons|\bCC[ -]BY", re.I)
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
MOST_DIFFERENT = 0.2  #: differing words of a confirmed notice, as a share of the template's
FIRST = 3  #: templates of largest reduction whose wording is compared; more if they tie
SPAN = int((1 + MOST_DIFFERENT) * max(len(WORD.findall(t.lower())) for x in TEMPLATES.values() for t in x)) + 1  #: words that the longest notice can have
WIDTHS = (8, 16, 32, SPAN)  #: words on either side of a licensing word
PLAIN = 4000  #: characters; a longer block is compressed by its words alone and not remembered


@lru_cache(maxsize=1)
def compressors() -> list[tuple[str, str, zstandard.ZstdCompressor]]:
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            known = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, text, zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False)))
    return out


@lru_cache(maxsize=1)
def plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False)


def reductions(block: str) -> list[tuple[int, str, str]]:
    """(bytes that the template saves, license, template), the largest first."""
    block = block.lower() if len(block) <= PLAIN else " ".join(w[:64] for w in WORD.findall(block.lower()))
    data = block.encode("utf-8", "replace")
    alone = len(plain().compress(data))
    found = [(alone - len(c.compress(data)), name, text) for name, text, c in compressors()]
    return sorted(found, key=lambda x: (-x[0], x[1], x[2]))


def differences(block: str, template: str) -> tuple[int, int, int]:
    """Start and end, in the block, of the stretch that matches the template, and its differing words."""
    own = [(m[0], m.start(), m.end()) for m in WORD.finditer(block.lower())] if len(block.lower()) == len(block) else [(m[0].lower(), m.start(), m.end()) for m in re.finditer(WORD.pattern, block, re.I)]
    wanted = WORD.findall(template.lower())
    steps = difflib.SequenceMatcher(None, [w for w, _, _ in own], wanted, autojunk=False).get_opcodes()
    equal = [s for s in steps if s[0] == "equal"]
    if not equal:
        return 0, 0, len(wanted)
    # Of all runs of equal stretches the one with the fewest differing words: a word of the
    # template that occurs far off, too, takes nothing in.
    best = None
    for k, first in enumerate(equal):
        inner = 0
        for n, last in enumerate(equal[k:], k):
            if n > k:
                inner += max(last[1] - equal[n - 1][2], last[3] - equal[n - 1][4])
            key = first[3] + inner + len(wanted) - last[4], first[1] - last[2]
            if best is None or key < best[0]:
                best = key, first[1], last[2] - 1
    (apart, _), a, b = best
    return own[a][1], own[b][2], apart


def closest(block: str) -> tuple[str, int, int, int, int] | None:
    """License, start, end, differing and equal words of a block's notice that has the most equal words; None if no template's wording is close."""
    ranked = reductions(block)
    floor = ranked[min(FIRST, len(ranked)) - 1][0]
    best = None
    for saved, name, template in ranked:
        if saved < floor or saved <= 0:
            break
        start, end, apart = differences(block, template)
        words = len(WORD.findall(template.lower()))
        if apart <= MOST_DIFFERENT * words:
            key = (apart - words, apart, name)
            if best is None or key < best[0]:
                best = key, (name, start, end, apart, words - apart)
    return best and best[1]


remembered = lru_cache(maxsize=100_000)(closest)


def identify(block: str) -> tuple[str, int, int, int, int] | None:
    return remembered(block) if len(block) <= PLAIN else closest(block)


def scan(text: str | None) -> list[tuple[str, int, int, int]]:
    """(license, start, end, differing words) of every notice in a text, in code points.

    Around each licensing word that no notice holds yet, blocks of sentences or line parts and
    windows of words are tried, up to the longest notice on either side and up to the notices
    found before. The notice with the most equal words is kept, and what is left around the word
    is tried again until no template matches.
    """
    if not text or not TRIGGER.search(text):
        return []
    parts = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+?(?:[.!?](?=\s|$)|(?=\n|$))", text)]
    begins = [a for a, _ in parts]
    starts, ends = array("q"), array("q")
    for m in re.finditer(WORD.pattern, text, re.I):
        starts.append(m.start())
        ends.append(m.end())
    found: list[tuple[int, int, str, int]] = []  # by start, without overlap
    for m in TRIGGER.finditer(text):
        at, i, w = m.start(), bisect_right(begins, m.start()) - 1, bisect_right(starts, m.start()) - 1
        words = [(starts[max(w - n, 0)], ends[min(w + n, len(ends) - 1)]) for n in WIDTHS]
        widest = words[-1]
        blocks = [(parts[i][0], parts[min(i + n, len(parts)) - 1][1]) for n in (1, 3, 6)] + words
        while True:
            n = bisect_right(found, at, key=lambda x: x[0])
            low, high = found[n - 1][1] if n else 0, found[n][0] if n < len(found) else len(text)
            if at < low:
                break
            best = None
            for a, b in dict.fromkeys((max(a, low, widest[0]), min(b, high, widest[1])) for a, b in blocks):
                got = identify(text[a:b]) if a < b else None
                if got and (best is None or (-got[4], got[3]) < best[0]):
                    best = (-got[4], got[3]), (a + got[1], a + got[2], got[0], got[3])
            if best is None:
                break
            found.insert(bisect_left(found, best[1]), best[1])
    return [(name, a, b, apart) for a, b, name, apart in found]


def license_notices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_notices, licenses, notices`` of every row, over whole texts.

    ``licenses`` are the distinct identifiers in order, ``notices`` are ``license:start:end:differing
    words``, both joined by commas. Templates are tried by how many bytes each saves as a raw zstd
    dictionary; the wording decides. Texts are scanned whole, however long their lines and however
    short the lines of a notice. Null and empty texts have none; equal texts have equal notices; an
    empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(sorted({n for n, *_ in x})) for x in found]), pa.array([",".join(":".join(map(str, y)) for y in x) for x in found])],
                names=["doc_id", "n_notices", "licenses", "notices"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_notices long, licenses string, notices string")
