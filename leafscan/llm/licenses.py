"""License scan by patience alignment with templates (operator 2)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import small_batches

COVERAGE = 0.8  # share of a template's words that must align
SHORT = 12  # words up to which all of a template must align
SLACK = 8  # words by which a region may exceed twice the template
PIECE = 1 << 20  # characters whose words are held at once
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# Notices as they are usually printed, by SPDX identifier; then the decisive phrases (name, version) in them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""", "Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License.", "MIT License"),
    ("MIT", "Licensed under the MIT License.", "MIT License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "GNU General Public License", "version 3 of the License"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0"),
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    decisive: tuple[range, ...] = ()  # places of words that must align without foreign words between them

    @property
    def least(self) -> int:
        """Words that must align; of a short template, all."""
        if len(self.words) <= SHORT:
            return len(self.words)
        return -(-len(self.words) * int(COVERAGE * 100) // 100)

    @property
    def region(self) -> int:
        return 2 * len(self.words) + SLACK


def places_of(phrase: list[str], words: list[str]) -> range:
    """Where a phrase first occurs."""
    n = len(phrase)
    return next(range(k, k + n) for k in range(len(words) - n + 1) if words[k : k + n] == phrase)


def templates(rows: tuple[tuple[str, ...], ...] = TEMPLATES) -> list[Template]:
    out = []
    for name, text, *phrases in rows:
        words = words_of(text)
        out.append(Template(name, tuple(words), tuple(places_of(words_of(p), words) for p in phrases)))
    return out


def spellings(known: list[Template]) -> dict[str, str]:
    """The templates' words by the ways to write them: a version may be given as 3 or 3.0."""
    out = {w: w for t in known for w in t.words}
    for w in list(out):
        if re.fullmatch(r"[0-9]+(\.0)?", w):
            out.setdefault(w.removesuffix(".0") if w.endswith(".0") else f"{w}.0", w)
    return out


def decided(template: Template, aligned: list[tuple[int, int]], places: list[int]) -> bool:
    """Whether all decisive words align, those of a phrase with neighbouring words of the text."""
    at = {j: places[i] for i, j in aligned}
    return all(all(j in at and at[j] - at[phrase[0]] == j - phrase[0] for j in phrase) for phrase in template.decisive)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first part, whose second parts increase (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int | None] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before.append(piles[at - 1] if at else None)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out = []
    k = piles[-1] if piles else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[str], b: tuple[str, ...]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, ascending.

    In each pair of ranges equal words at both ends align; then words that
    occur once in either range are anchors, of which the longest increasing
    subsequence stays, and the gaps between anchors are aligned the same way.
    """
    out: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out.extend(anchors)
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        ranges.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends[:-1], ends[1:], strict=True))
    return sorted(out)


@dataclass(frozen=True)
class Found:
    license: str
    start: int  # first aligned word of the text
    end: int  # after the last one
    coverage: float


def find(template: Template, places: list[int], words: list[str]) -> list[Found]:
    """Regions of a text that cover enough of a template, from left to right, not overlapping.

    ``places`` and ``words`` hold the text's words that the template has. A
    region is aligned only if its words, counted as often as the template has
    them, could reach the coverage, and counts only if the decisive words
    stand in it without foreign words between them.
    """
    wanted = Counter(template.words)
    have: Counter[str] = Counter()
    common = end = start = 0
    out: list[Found] = []
    while start < len(places):
        while end < len(places) and places[end] < places[start] + template.region:
            have[words[end]] += 1
            common += have[words[end]] <= wanted[words[end]]
            end += 1
        after = start + 1
        if common >= template.least:
            aligned = patience(words[start:end], template.words)
            if len(aligned) >= template.least and decided(template, aligned, places[start:end]):
                first, last = start + aligned[0][0], start + aligned[-1][0]
                out.append(Found(template.license, places[first], places[last] + 1, len(aligned) / len(template.words)))
                after = last + 1
        for word in words[start:after]:
            common -= have[word] <= wanted[word]
            have[word] -= 1
        start = after
    return out


def pieces(text: str) -> Iterator[str]:
    """A text in parts that end at white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def scan_text(text: str, known: list[Template]) -> tuple[int, list[Found]]:
    """Number of words, and what is found, by place; of overlapping finds the longest in aligned words stays."""
    vocabulary = spellings(known)
    places: list[int] = []
    words: list[str] = []
    n = 0
    for piece in pieces(text):
        own = words_of(piece)
        for at, word in enumerate(own, n):
            if word in vocabulary:
                places.append(at)
                words.append(vocabulary[word])
        n += len(own)
    counts = Counter(words)
    found: list[tuple[float, Found]] = []
    for template in known:
        wanted = Counter(template.words)
        if sum(min(c, counts[w]) for w, c in wanted.items()) < template.least:
            continue
        own = [k for k, w in enumerate(words) if w in wanted]
        for f in find(template, [places[k] for k in own], [words[k] for k in own]):
            found.append((f.coverage * len(template.words), f))
    found.sort(key=lambda x: (-x[0], x[1].start, x[1].license))
    kept: list[Found] = []
    for _, f in found:
        if all(f.end <= k.start or k.end <= f.start for k in kept):
            kept.append(f)
    return n, sorted(kept, key=lambda f: f.start)


def license_scan(docs: DataFrame, rows: tuple[tuple[str, ...], ...] = TEMPLATES, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_found, licenses, best_license, coverage, spans``.

    ``licenses`` are the distinct identifiers found, sorted and joined by
    commas; ``spans`` lists identifier:first word:end by place;
    ``best_license`` has the highest coverage, the first in the text if several
    have, and is null without a find (coverage 0). Case and punctuation do not
    count. Null and empty texts have no words; repeated rows are scanned each,
    an empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    known = templates(rows)
    chosen = docs.select(F.col(order).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [scan_text(t, known) for t in batch.column(1).to_pylist()]
            best = [max(found, key=lambda f: f.coverage, default=None) for _, found in results]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in results], pa.int64()),
                    pa.array([len(found) for _, found in results], pa.int64()),
                    pa.array([",".join(sorted({f.license for f in found})) for _, found in results], pa.string()),
                    pa.array([b.license if b else None for b in best], pa.string()),
                    pa.array([b.coverage if b else 0.0 for b in best], pa.float64()),
                    pa.array([",".join(f"{f.license}:{f.start}:{f.end}" for f in found) for _, found in results], pa.string()),
                ],
                names=["doc_id", "n_words", "n_found", "licenses", "best_license", "coverage", "spans"],
            )

    return chosen.mapInArrow(
        run, f"doc_id {kind}, n_words long, n_found long, licenses string, best_license string, coverage double, spans string"
    )
