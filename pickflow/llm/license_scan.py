"""License scans by conditional compression: how much shorter a block gets when a license text is given as a dictionary.

Blocks with a word of licensing are cut out of every text: the sentences, runs of sentences and lines, and windows of long
sentences that have about the words of a template, and what is left around them. Each is compressed alone and with every
template as a raw dictionary; templates are ranked by the bytes saved, and the best is confirmed by the words that differ: few may, and none that decides.
"""

from __future__ import annotations

import bisect
import difflib
import itertools
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers that a tag may name, and licenses whose whole text is a template.
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
)
FULL = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0")
#: Customary notices of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "Copyright. All rights reserved."),
    ("proprietary", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
    *((name, pkgutil.get_data("pickflow.llm", f"license_texts/{name}.txt").decode().strip()) for name in FULL),
)
#: What makes a sentence a candidate; and what may stand in a notice without being a difference: years, marks, holders' signs.
CUE = r"(?i)licen[cs]|copyright|\bspdx|redistribut|all\s+rights\s+reserved|public\s+domain|creative\s+commons|permission\s+is\s+hereby"
_IGNORED = re.compile(r"(?:19|20)\d\d(?:-(?:19|20)?\d\d)?|\(c\)|©", re.I)
#: Share of a template's words that may differ, and the largest block looked at in one piece (longer ones are cut there).
TOLERANCE, LONGEST = 0.15, 2000
#: Words in a row that find the places where a template may stand: TOLERANCE leaves some of each template's unchanged. A
#: sentence of more characters than FLAT is taken for text without sentence ends, in which a notice may begin anywhere.
ANCHOR, FLAT = 3, 400
#: Words that decide which license is meant, or whether it is granted, besides numbers. A wording that has one
#: more or one less of them than the template, also as a part of a word with hyphens, is no notice of that license.
DECISIVE = frozenset(
    "not no never without cannot lesser library affero gnu gpl lgpl agpl mit apache mozilla mpl bsd isc zlib boost eclipse epl cddl unlicense"
    " cc cc0 zero attribution sharealike noderivatives noderivs noncommercial sa nd nc creative commons clause only later".split()
)
_DENIED = re.compile(r"\b(?:not|never|no longer|cannot|isn't|aren't)\s+(?:\w+\s+){0,2}$", re.I)
#: Most words of a holder's name between "copyright" and "all rights reserved".
HOLDER = 12
#: Up to so many words that may differ, all begins and ends of a span are tried; beyond, so many nearest to the alignment.
NEAR = 4

SCHEMA = "doc_id bigint, block int, begin bigint, length bigint, license string, bytes_alone int, bytes_saved int, differences int, confirmed boolean"


def units(text: str) -> list[tuple[int, int]]:
    """Where the sentences of each line begin and end."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        # a full stop inside a version number or an abbreviation ends no sentence
        cuts = [0, *(m.end() for m in re.finditer(r"[.!?](?=\s+[A-Z(])", line[0])), len(line[0])]
        out += [(line.start() + a, line.start() + b) for a, b in zip(cuts[:-1], cuts[1:]) if line[0][a:b].strip()]
    return out


def blocks(text: str, scanner: Scanner) -> Iterator[tuple[int, str]]:
    """Where each candidate begins, and its text: first the notices that a template confirms, then what is left with a cue.

    A notice is a sentence, a run of sentences or lines, or a window of a long sentence, no two overlapping; longer ones and
    those with fewer differences come first. What is left are sentences and runs of sentences of a line that all have a cue.
    """
    cue = re.compile(CUE)
    parts = units(text)
    cues = [cue.search(text, a, b) is not None for a, b in parts]
    if not any(cues) and not cue.search(text):
        return
    taken: list[tuple[int, int]] = []
    for _, _, a, b in sorted(scanner.proposed(text, parts)):
        if all(b <= x or a >= y for x, y in taken) and cue.search(text, a, b) and not _DENIED.search(text, max(0, a - 60), a) and scanner.best(text[a:b])[-1]:
            taken.append((a, b))
    left, run = [], None
    for (a, b), has in zip(parts, cues):
        inside = sorted((max(a, x), min(b, y)) for x, y in taken if x < b and y > a)
        ends = [a, *(e for span in inside for e in span), b]
        for i, (x, y) in enumerate(zip(ends[::2], ends[1::2])):
            if not has or not cue.search(text, x, y):
                run = None
                continue
            # a run ends at a line feed, at a notice, and where it would get too long
            if run is None or i or inside or "\n" in text[run[1] : x] or y - run[0] > LONGEST:
                run = [x, y]
                left.append(run)
            else:
                run[1] = y
        if inside and inside[-1][1] >= b:
            run = None
    yield from sorted([(a, text[a:b]) for a, b in taken] + [piece for a, b in left for piece in _pieces(text, a, b)])


def _pieces(text: str, a: int, b: int) -> Iterator[tuple[int, str]]:
    while a < b:
        piece = text[a : min(b, a + LONGEST)]
        if piece.strip():
            yield a + len(piece) - len(piece.lstrip()), piece.strip()
        a += LONGEST


def words(text: str) -> list[tuple[str, int, int]]:
    """The words that count in comparisons, each with its begin and end; the name of a holder does not count."""
    found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[\w.\-]*\w", _IGNORED.sub(lambda m: " " * len(m[0]), text))]
    out, i = [], 0
    while i < len(found):
        out.append(found[i])
        i += 1
        if out[-1][0] == "copyright":
            after = (k for k in range(i, min(i + HOLDER, len(found)) + 1) if [w for w, _, _ in found[k : k + 3]] == ["all", "rights", "reserved"])
            i = next(after, i)
    return out


def wording(text: str) -> list[str]:
    return [w for w, _, _ in words(text)]


def decisive(wanted: Sequence[str]) -> Counter:
    """The words of a wording that decide, with their counts."""
    return Counter(w for w in wanted if any(part in DECISIVE or part.lstrip("v").replace(".", "").isdigit() for part in w.split("-")))


def differences(block: str, template: str) -> int:
    """Words that must be left out, put in or replaced to turn one wording into the other."""
    return _differences(wording(template), wording(block))


def _differences(a: list[str], b: list[str], limit: int | None = None) -> int:
    """Beyond ``limit``, any number above it will do."""
    if a == b:
        return 0
    if limit is not None and (least := max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values())) > limit:
        return least
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal")


def _peaks(shifts: Counter, slack: int, least: int) -> list[int]:
    """Shifts with at least ``least`` votes no further than ``slack``, those with the most first; one for each such place."""
    by_place = sorted(shifts)
    sums = [0, *itertools.accumulate(shifts[s] for s in by_place)]
    out: list[int] = []
    for s in sorted(by_place, key=lambda s: (-shifts[s], s)):
        a, b = bisect.bisect_left(by_place, s - slack), bisect.bisect_right(by_place, s + slack)
        if sums[b] - sums[a] >= least and not any(abs(s - o) <= slack for o in out):
            out.append(s)
    return out


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES):
        import zstandard as zstd

        own = lambda text: zstd.ZstdCompressionDict(text.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        options = {"level": 19, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstd.ZstdCompressor(**options)
        self.given = [(name, text, zstd.ZstdCompressor(dict_data=own(text), **options)) for name, text in templates]
        self.known: dict[str, tuple] = {}
        self.wordings = [wording(text) for _, text in templates]
        self.decisive = [decisive(w) for w in self.wordings]
        self.anchors: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for t, w in enumerate(self.wordings):
            size = min(ANCHOR, len(w))
            for at in range(len(w) - size + 1 if w else 0):
                self.anchors.setdefault(tuple(w[at : at + size]), []).append((t, at))

    def proposed(self, text: str, parts: Sequence[tuple[int, int]]) -> set[tuple[int, int, int, int]]:
        """(minus words, differences, begin, end) of spans that differ by no more than ``TOLERANCE`` from a template."""
        found = words(text)
        own = [w for w, _, _ in found]
        starts = [a for a, _ in parts]
        votes: dict[int, Counter] = {}
        for size in {len(k) for k in self.anchors}:
            for i in range(len(own) - size + 1):
                for t, at in self.anchors.get(tuple(own[i : i + size]), ()):
                    votes.setdefault(t, Counter())[i - at] += 1
        out = set()
        for t, shifts in votes.items():
            wanted = self.wordings[t]
            n, slack = len(wanted), int(TOLERANCE * len(wanted))
            for at in _peaks(shifts, slack, max(1, n - min(ANCHOR, n) + 1 - ANCHOR * slack)):
                begin, end = at, at + n
                if slack > NEAR:
                    area = max(0, at - slack)
                    same = [m for m in difflib.SequenceMatcher(None, wanted, own[area : at + n + 2 * slack], autojunk=False).get_matching_blocks() if m.size >= ANCHOR]
                    begin, end = area + same[0].b - same[0].a, area + same[-1].b + n - same[-1].a
                # words before which a part begins or after which one ends, and every word of a long part; the nearest first
                begins, ends = [], []
                for i in sorted(range(max(0, begin - slack), min(len(own), begin + slack + 1)), key=lambda i: abs(i - begin)):
                    part = parts[bisect.bisect_right(starts, found[i][1]) - 1]
                    if part[1] - part[0] > FLAT or i == 0 or found[i - 1][1] < part[0]:
                        begins.append(i)
                for j in sorted(range(max(1, end - 2 * slack), min(len(own), end + 2 * slack) + 1), key=lambda j: abs(j - end)):
                    part = parts[bisect.bisect_right(starts, found[j - 1][1]) - 1]
                    if part[1] - part[0] > FLAT or j == len(own) or found[j][1] >= part[1]:
                        ends.append(j)
                if slack > NEAR:
                    begins, ends = begins[:NEAR], ends[:NEAR]
                for i, j in ((i, j) for i in begins for j in ends if i < j and abs(j - i - n) <= slack):
                    differ = _differences(wanted, own[i:j], slack)
                    if differ <= slack:
                        out.add((-n, differ, *self._whole(text, parts, starts, found[i][1], found[j - 1][2])))
                    if differ == 0:
                        break
        return out

    @staticmethod
    def _whole(text: str, parts: Sequence[tuple[int, int]], starts: Sequence[int], a: int, b: int) -> tuple[int, int]:
        """From word to word, with the marks around them unless they belong to a neighbouring word."""
        end = parts[bisect.bisect_right(starts, b - 1) - 1][1]
        while b < end and not text[b].isspace() and not text[b].isalnum():
            b += 1
        return a, b

    def best(self, block: str) -> tuple[str | None, int, int, int | None, bool]:
        """License, bytes alone, bytes saved, differences, confirmed. Ties: the fewer differences, then the order of the templates."""
        if block not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[block] = self._best(block)
        return self.known[block]

    def _best(self, block: str) -> tuple[str | None, int, int, int | None, bool]:
        raw = block.encode()
        alone = len(self.alone.compress(raw))
        ranked = sorted((len(c.compress(raw)) - alone, i) for i, (_, _, c) in enumerate(self.given))
        own = wording(block)
        near = [(saved, i) for saved, i in ranked if len(self.wordings[i]) <= 2 * len(own) + 10] or ranked
        top = [(_differences(self.wordings[i], own), i, -saved) for saved, i in near if saved == near[0][0]]
        # the next in rank may be the same notice with other words
        top += [(_differences(self.wordings[i], own), i, -saved) for saved, i in near[len(top) : len(top) + 3]]
        marks = decisive(own)
        good = [(d, i, saved) for d, i, saved in top if d <= TOLERANCE * len(self.wordings[i]) and saved > 0 and marks == self.decisive[i]]
        least, i, saved = min(good or top)
        return self.given[i][0], alone, saved, least, bool(good)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each candidate block of ``docs`` (``doc_id``, ``text``), confirmed or not.

    Columns: doc_id, block (number in its text), begin and length (characters), license (of the best template), bytes_alone,
    bytes_saved, differences (words), confirmed. Null, empty and other texts without a word of licensing give no rows.
    Repeated rows give repeated results. Other columns are ignored.
    """
    given = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (begin, block) in enumerate(blocks(text, scanner)):
                    out.append((doc_id, i, begin, len(block), *scanner.best(block)))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.where(F.col("text").rlike(CUE)).select("doc_id", "text").mapInArrow(run, SCHEMA)
