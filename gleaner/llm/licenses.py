"""License scans by conditional compression: candidate blocks are compressed with each template as a zstandard raw
dictionary, templates rank by how much smaller a block gets, and winners are confirmed by their exact wording differences.

A notice may differ in a few words, so at least one run of its words stands unchanged; how long that is at least follows
from the template's length and the words that may differ. Candidate blocks are the surroundings of all such runs, merged
where they overlap and cut where they would exceed a fixed number of words, with an overlap longer than any template. So no
notice that would be confirmed is left out, and a text of any length is scanned whole in bounded memory.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .shared import map_rows

# Wording of public license notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-statement": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC0-1.0-statement": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004",
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions",
}
_GNU = [("GPL-2.0", "program", ";", "General", "2", "2, June 1991"), ("GPL-3.0", "program", ":", "General", "3", "3, 29 June 2007"), ("LGPL-2.0", "library", ";", "Library General", "2", "2, June 1991"), ("LGPL-2.1", "library", ";", "Lesser General", "2.1", "2.1, February 1999"), ("LGPL-3.0", "program", ":", "Lesser General", "3", "3, 29 June 2007"), ("AGPL-3.0", "program", ":", "Affero General", "3", "3, 19 November 2007")]
for _name, _what, _mark, _kind, _version, _dated in _GNU:
    TEMPLATES.setdefault(_name, f"This {_what} is free software{_mark} you can redistribute it and/or modify it under the terms of the GNU {_kind} Public License as published by the Free Software Foundation{_mark.replace(':', ',')} either version {_version} of the License, or (at your option) any later version.")
    TEMPLATES.setdefault(f"{_name}-statement", f"Licensed under the GNU {_kind} Public License, version {_version}.")
    TEMPLATES[f"{_name}-text"] = f"GNU {_kind} Public License Version {_dated}"
for _short, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _where in (("4.0", "International"), ("3.0", "Unported")):
        for _name, _text in ((f"CC-{_short}-{_version}-statement", f"Licensed under CC {_short} {_version}."), (f"CC-{_short}-{_version}", f"This work is licensed under a Creative Commons {_long} {_version} {_where} License.")):
            if _text not in TEMPLATES.values():
                TEMPLATES[f"{_name}-short" if _name in TEMPLATES else _name] = _text

# Words that decide which license and version it is: none may be missing, added or changed.
_DECIDES = re.compile(rb"v?\d{1,2}(\.\d+)*|gnu|lesser|affero|mozilla|apache|eclipse|boost|mit|bsd|isc|cc0|by-[a-z-]+|attribution.*|.*(noncommercial|sharealike|noderiv).*")
LONGEST = 8  # words of a run at most
MOST = 600  # words of a block at most
CHUNK = 1 << 20
_EDGE = b".,;:!?()[]{}\"'*#/-_<>"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> list[tuple[bytes, int, int]]:
    """(word in lower case without punctuation around it, start, end); words of punctuation alone are left out."""
    return [(w, m.start(), m.end()) for m in _WORD.finditer(text) if (w := m[0].lower().strip(_EDGE))]


def allowed(words: int) -> int:
    """Words of a notice of so many that may be missing, added or changed."""
    return words // 10


class Runs:
    """Finds the places of words that stand unchanged in a row in any notice that may be confirmed."""

    def __init__(self, templates: list[list[bytes]]):
        self.ids = {w: i for i, w in enumerate(sorted({w for t in templates for w in t}), 1)}
        self.base = len(self.ids) + 1
        grams: dict[int, set[int]] = {}
        for t in templates:
            k = allowed(len(t))  # k places of differences leave k + 1 runs of all but k words
            size = min(LONGEST, -(-(len(t) - k) // (k + 1)))
            codes = [self.ids[w] for w in t]
            grams.setdefault(size, set()).update(self.code(codes[i : i + size]) for i in range(len(t) - size + 1))
        self.grams = {size: np.array(sorted(x), np.uint64) for size, x in grams.items()}
        self.least = min(grams)

    def code(self, ids: list[int]) -> int:
        out = 0
        for i in ids:
            out = (out * self.base + i) % (1 << 64)
        return out

    def places(self, text: bytes) -> np.ndarray:
        """First words, counted as words_of() does, of these runs."""
        get = self.ids.get
        ids = np.array([get(w, 0) for x in text.lower().split() if (w := x.strip(_EDGE))], np.uint64)
        found: list[np.ndarray] = []
        known = ids > 0
        if len(ids) < self.least or not np.logical_and.reduce([known[i : len(ids) - self.least + 1 + i] for i in range(self.least)]).any():
            return np.zeros(0, np.int64)
        for size, grams in self.grams.items():
            n = len(ids) - size + 1
            if n > 0:
                codes = np.zeros(n, np.uint64)
                for i in range(size):
                    codes = codes * np.uint64(self.base) + ids[i : n + i]
                found.append(np.flatnonzero(grams.take(np.searchsorted(grams, codes), mode="clip") == codes))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def candidate_blocks(places: np.ndarray, words: int, reach: int) -> list[tuple[int, int]]:
    """(first, last exclusive) word of the surroundings of places, merged; longer ones in overlapping parts."""
    spans: list[list[int]] = []
    for p in places.tolist():
        if spans and p - reach <= spans[-1][1]:
            spans[-1][1] = min(words, p + reach)
        else:
            spans.append([max(0, p - reach), min(words, p + reach)])
    most = max(MOST, 4 * reach)
    return [(at, min(hi, at + most)) for lo, hi in spans for at in range(lo, max(lo + 1, hi - 2 * reach), most - 2 * reach)]


def chunks_of(text: bytes, reach: int) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of parts that end at white space and overlap by the words of two notices."""
    at = 0
    while True:
        space = _SPACE.search(text, at + CHUNK)
        end = space.start() if space else len(text)
        yield at, text[at:end]
        if end >= len(text):
            return
        back, seen = end, 0
        while seen < 2 * reach and back > at:
            back = max(at, back - 4096)
            seen = len(text[back:end].split())
        space = _SPACE.search(text, back, end)
        at = max(at + 1, space.start() if space else end)


def deciding(words: list[bytes], at: range) -> Counter:
    """Those of the words at these places that decide about license and version, numbers without v and .0."""
    out: Counter = Counter()
    for i in at:
        w = words[i]
        if _DECIDES.fullmatch(w) or w == b"library" and words[i + 1 : i + 2] == [b"general"]:
            out[w.lstrip(b"v").removesuffix(b".0") if w[-1:].isdigit() else w] += 1
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = 6):
        self.words = {k: [w for w, _, _ in words_of(t.encode())] for k, t in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=level)
        self.given = {k: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(b" ".join(w), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items()}
        self.runs = Runs(list(self.words.values()))
        self.reach = max(map(len, self.words.values())) + allowed(max(map(len, self.words.values())))
        self.known: dict[bytes, list] = {}

    def rank(self, data: bytes) -> list[tuple[int, str]]:
        """(bytes saved, template), best first."""
        size = len(self.plain.compress(data))
        return sorted(((size - len(c.compress(data)), k) for k, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def confirm(self, name: str, block: list[bytes]) -> tuple[int, int, list[str]] | None:
        """Place of a template among a block's words, with what is missing (-) and added (+); None if it differs too much."""
        want = self.words[name]
        m = SequenceMatcher(None, want, block, autojunk=False).find_longest_match()
        if not m.size:
            return None
        most = allowed(len(want))
        lo, hi = max(0, m.b - m.a - most), m.b - m.a + len(want) + most
        part = block[lo:hi]
        ops = [o for o in SequenceMatcher(None, want, part, autojunk=False).get_opcodes() if o[0] != "equal"]
        first, last, inner = 0, len(part), []
        for kind, a, b, c, d in ops:  # at the ends, no more words count as changed than the notice has there
            if a == 0 and kind != "delete":
                first = c = max(c, d - (b - a))
            if b == len(want) and kind != "delete":
                last = d = min(d, c + (b - a))
            inner.append((a, b, c, d))
        notes, gone, more = [], Counter(), Counter()
        for a, b, c, d in inner:
            notes += [f"-{w.decode('utf-8', 'replace')}" for w in want[a:b]] + [f"+{w.decode('utf-8', 'replace')}" for w in part[c:d]]
            gone += deciding(want, range(a, b))
            more += deciding(part, range(c, d))
        if len(notes) <= most and last > first and gone != more:  # another license; this one may stand beside it
            for s, e in ((0, lo + first), (lo + last, len(block))):
                if (e - s) * 10 >= len(want) * 9 and (hit := self.confirm(name, block[s:e])):
                    return s + hit[0], s + hit[1], hit[2]
            return None
        return (lo + first, lo + last, notes) if len(notes) <= most and last > first else None

    def scan_block(self, words: list[bytes]) -> list[tuple[str, int, int, int, str]]:
        """(template, first word, last exclusive, bytes saved, differences) in a block. Confirmed wording is taken out, and
        what is left is ranked again."""
        found, left = [], list(enumerate(words))
        while left:
            own = [w for _, w in left]
            for saved, name in self.rank(b" ".join(own)):
                if saved <= 0:
                    return found
                if len(own) * 10 >= len(self.words[name]) * 9 and (hit := self.confirm(name, own)):
                    a, b, notes = hit
                    found.append((name, left[a][0], left[b - 1][0] + 1, saved, " ".join(notes)))
                    left = left[:a] + [(left[a][0], b"\x00")] + left[b:]
                    break
            else:
                return found
        return found

    def scan(self, text: bytes | None) -> list[tuple[str, int, int, int, str]]:
        """(template, start, end, bytes saved, differences) of a whole text, by start. Of findings over the same bytes in
        overlapping parts the longest stays."""
        out: list[tuple[str, int, int, int, str]] = []
        for start, part in chunks_of(text or b"", self.reach):
            places = self.runs.places(part)
            if not len(places):
                continue
            words = words_of(part)
            for lo, hi in candidate_blocks(places, len(words), self.reach):
                own = [w for w, _, _ in words[lo:hi]]
                data = b" ".join(own)
                if data not in self.known:
                    if len(self.known) >= 20_000:
                        self.known.clear()
                    self.known[data] = self.scan_block(own)
                out += [(k, start + words[lo + a][1], start + words[lo + b - 1][2], saved, notes) for k, a, b, saved, notes in self.known[data]]
        out.sort(key=lambda x: (x[1] - x[2], x[1], x[0]))
        kept: list[tuple[str, int, int, int, str]] = []
        for x in out:
            i = bisect(kept, x[1], key=lambda y: y[1])
            if (not i or kept[i - 1][2] <= x[1]) and (i == len(kept) or kept[i][1] >= x[2]):
                kept.insert(i, x)
        return kept


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each input row: id, findings (array of license, start, length in bytes, saved bytes, differences).

    Null, empty and clean texts have no findings. A template counts where at most a tenth of its words are missing, added
    or changed (a short one: none), and none of those that decide about license and version. Equal texts give equal findings. Other columns are ignored, whatever their names.
    """

    def make():
        scanner = Scanner(templates)

        def each(key, text):
            yield key, [{"license": k, "start": s, "length": e - s, "saved": saved, "differences": notes} for k, s, e, saved, notes in scanner.scan(text)]

        return each

    return map_rows(df, f"{id_col} {dict(df.dtypes)[id_col]}, findings array<struct<license:string,start:long,length:long,saved:long,differences:string>>", make, [id_col, text_col])
