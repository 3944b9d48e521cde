"""License scans by patience alignment.

A template and a text are words (runs of letters and digits, lower-cased, with inner dots and hyphens). Candidate windows of
the text come from the template's rarest words there: if a template is covered to min_coverage, then of any
floor((1 - min_coverage) * words) + 1 of its words at least one is matched, so windows around all occurrences of that many
rarest ones miss nothing. In a window the words unique to both sides are anchors; the longest increasing subsequence of their
places is kept, and the gaps between anchors are aligned recursively, after their common first and last words. Coverage is
the share of the template's words that are matched in a window with a quarter more words than the template on either side.

Whole texts are scanned; each template reports its best coverage in a document, the first such place. Null and empty texts
have no license; repeated rows are scanned each; an empty table gives no rows. Very long texts are indexed once, by word, and
every window around a rare word is aligned. Templates of a license that are covered by equally many words: the one covered
more, then the first; licenses found are ordered by words, coverage, name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MIN_COVERAGE = 0.8

#: License notices by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

#: Whole texts, in license_texts; those of AGPL-3.0 and of the CC licenses but BY-SA are not there.
WHOLE = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC-BY-SA-4.0")
#: A license whose text has all of another's: the other isn't reported within it.
INCLUDES = {"BSD-3-Clause": "BSD-2-Clause"}
#: Words that have to stand in a row where a template is found: what tells notices apart that are alike otherwise.
MARKS = (
    ("MIT", "Released under the MIT License.", "mit"),
    ("Apache-2.0", "", "apache license"),
    ("GPL-3.0", "", "gnu general public license"),
    ("LGPL-3.0", "", "lesser general public license"),
    ("AGPL-3.0", "", "affero general public license"),
    ("MPL-2.0", "", "mozilla public license"),
    ("BSD-3-Clause", "", "endorse or promote products"),
    ("CC-BY-NC-4.0", "", "by-nc 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "by-sa 4.0"),
    ("CC-BY-SA-4.0", "", "attribution-sharealike 4.0 international"),
    ("CC-BY-ND-4.0", "", "by-nd 4.0"),
    ("CC-BY-NC-SA-4.0", "", "by-nc-sa 4.0"),
    ("CC-BY-NC-ND-4.0", "", "by-nc-nd 4.0"),
)

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def all_templates() -> tuple[tuple[str, str], ...]:
    """The notices and the whole texts."""
    return (*TEMPLATES, *((n, files(__package__).joinpath("license_texts", f"{n}.txt").read_text()) for n in WHOLE))


def in_a_row(phrase: list[str], words: list[str]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose second increases: piles of patience with back links."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [b]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places in a and b whose words are matched, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        s, e, t, f = todo.pop()
        while s < e and t < f and a[s] == b[t]:
            out.append((s, t))
            s, t = s + 1, t + 1
        while s < e and t < f and a[e - 1] == b[f - 1]:
            e, f = e - 1, f - 1
            out.append((e, f))
        if s == e or t == f:
            continue
        in_a, in_b = Counter(a[s:e]), Counter(b[t:f])
        place = {w: j for j, w in enumerate(b[t:f], t) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[s:e], s) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        i0, j0 = s, t
        for i, j in [*anchors, (e, f)]:
            todo.append((i0, i, j0, j))
            if i < e:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates=TEMPLATES, min_coverage: float = MIN_COVERAGE):
        self.min = min_coverage
        self.templates = [(name, words) for name, text in templates if (words := words_of(text))]
        marks = {(name, text): mark for name, text, mark in MARKS}
        self.marks = [words_of(marks.get((name, text)) or marks.get((name, ""), "")) for name, text in templates if words_of(text)]
        self.vocabulary = frozenset(w for _, words in self.templates for w in words)
        self.counts = [Counter(w) for _, w in self.templates]

    def best(self, words: list[str], present: set[str], places: dict[str, list[int]], t: int, mark: list[str] | None = None) -> tuple[int, int, int] | None:
        """Most matched words of template t, and the first and last place in the text; None if below the minimum. With a mark,
        of the places that have it."""
        template, counts = self.templates[t][1], self.counts[t]
        n = len(template)
        need = max(1, -int(-self.min * n // 1))
        if sum(c for w, c in counts.items() if w in present) < need:
            return None
        missing = {w for w in counts if w in present and w not in places}
        if missing:  # one pass over the text for all templates' words
            wanted = missing | (self.vocabulary & present)
            places.update((w, []) for w in wanted if w not in places)
            for i, x in enumerate(words):
                if x in wanted:
                    places[x].append(i)
        order = sorted(range(n), key=lambda i: (len(places.get(template[i], ())), i))
        slack = n // 4 + 1
        windows = set()
        for i in order[: n - need + 1]:
            for p in places.get(template[i], ()):
                windows.add(max(0, p - i - slack))
        found = None
        for s in sorted(windows):
            window = words[s : s + n + 2 * slack]
            here = Counter(window)
            if sum(min(c, k) for w, c in counts.items() if (k := here[w])) < max(need, found[0] + 1 if found else 0):
                continue
            got = aligned(template, window)
            if mark and got and not in_a_row(mark, window[got[0][1] : got[-1][1] + 1]):
                continue
            if len(got) >= need and (found is None or len(got) > found[0]):
                found = (len(got), s + got[0][1], s + got[-1][1])
                if len(got) == n:
                    break
        return found

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first and last word of the text) of each license's best template, best first."""
        lowered = text.lower()
        if not any(w in lowered for w in self.hints()):
            return []
        words = _WORD.findall(lowered)
        present = set(words)
        places: dict[str, list[int]] = {}
        by: dict[str, tuple[str, float, int, int, int]] = {}
        for t, (name, template) in enumerate(self.templates):
            mark = self.marks[t]
            if not present.issuperset(mark):
                continue
            if (got := self.best(words, present, places, t, mark)) is not None:
                row = (name, got[0] / len(template), *got)
                if name not in by or (row[2], row[1]) > (by[name][2], by[name][1]):
                    by[name] = row
        for name, part in INCLUDES.items():
            if name in by and part in by and by[name][3] <= by[part][3] and by[part][4] <= by[name][4]:
                del by[part]
        return sorted(by.values(), key=lambda r: (-r[2], -r[1], r[0]))

    def hints(self) -> tuple[str, ...]:
        """Words one of which is in every text that covers a template: for each template, the longest word of its mark, or as
        many of its longest words as can't all be missed."""
        if not hasattr(self, "_hints"):
            out: set[str] = set()
            for (_, words), counts, mark in zip(self.templates, self.counts, self.marks, strict=True):
                if mark:
                    out.add(max(mark, key=len))
                    continue
                spare = len(words) - max(1, -int(-self.min * len(words) // 1))
                for w in sorted(counts, key=lambda w: (-len(w), w)):
                    out.add(w)
                    spare -= counts[w]
                    if spare < 0:
                        break
            self._hints = tuple(sorted(out))
        return self._hints


def _scanned(names: list[str], templates, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("license", "coverage", "matched", "first_word", "last_word"), r, strict=True)) for r in scanner.scan(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], names=[*names, "licenses"])

    return run


def license_scan(docs: DataFrame, templates=None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """templates: (license, text) of each instead of all_templates(). doc_id, and licenses: an array of all licenses found, the one with most matched words first. No text is moved."""
    fields = "doc_id long, licenses array<struct<license: string, coverage: double, matched: int, first_word: int, last_word: int>>"
    return docs.select("doc_id", "text").mapInArrow(_scanned(["doc_id"], all_templates() if templates is None else templates, min_coverage), fields)


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan(read(spark, folder, "documents"))
    top = F.try_element_at("licenses", F.lit(1))
    names = F.array_join(F.transform("licenses", lambda r: r["license"]), ",")
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), names.alias("licenses"), top["license"].alias("license"), F.coalesce(top["coverage"], F.lit(0.0)).alias("coverage"), top["first_word"].alias("first_word"), top["last_word"].alias("last_word"))
