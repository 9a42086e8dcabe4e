"""License scans by patience alignment of texts with license templates.

A template is aligned with the text around an occurrence of one of its words by anchoring on words that are unique in both, keeping
the longest increasing subsequence of anchors and aligning the gaps between them in the same way; equal words at both ends of a
gap match directly. Coverage is the share of the template's words so matched. A match has at least LEAST of it, spans at most
SPREAD times the template's words, holds all of the words that tell the license from its kin (names, qualifiers and versions)
and between its words no qualifier of a kin (a Lesser GPL is no GPL).

Whole texts are read. A template of n words matches at LEAST only if no more than (1 - LEAST) * n of its words are missing, so
of any larger set of its words (triggers) one must be there: texts without one are passed over, and every occurrence of one is
tried as a fixed point of the alignment, which loses nothing.

Defined cases. Null or empty text: no rows. Null ids and repeated rows: a row for each finding. Several licenses that
cover one region: the best covered, then the longer template, then the first name. Empty table: empty result. Other columns are ignored."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, SPREAD = 0.8, 1.5

# Notices and license texts as their publishers word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "apache-1.0": "Licensed under the Apache License, Version 1.0.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
for _short, _name in (("gpl", ""), ("lgpl", "Lesser "), ("agpl", "Affero ")):
    for _version in ("2", "2.1", "3"):
        _id = f"{_short}-{_version}" if "." in _version else f"{_short}-{_version}.0"
        TEMPLATES[_id] = f"This work is licensed under the GNU {_name}General Public License, version {_version}."
        TEMPLATES[_id + "-notice"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name}General Public License as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version."
for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        TEMPLATES[f"cc-{_kind.lower()}-{_version}"] = f"Licensed under CC {_kind} {_version}."
# Words too common to tell a license; words that must be matched where a template has them; those that must not stand in a match unmatched.
COMMON = frozenset("a an and any are as at be by for from in is it not of on or that the this to with you".split())
NAMES = frozenset("apache bsd cc gnu isc mit mozilla unencumbered".split())
QUALIFIERS = frozenset("affero lesser library nc nd sa noncommercial noderivatives noderivs sharealike".split())

_word = re.compile(r"v?[0-9]+(?:\.[0-9]+)+|[0-9a-z]+")
_version_number = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def words(text: str) -> list[str]:
    """Words of [0-9a-z] in lower case; a version number is one word, without a v before it and zeros after it."""
    return [m[1] if (m := _version_number.fullmatch(w)) else w for w in _word.findall(text.lower())]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by piles and back-links."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p:
            back[i] = piles[p - 1]
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching places of a and b, increasing in both. Gaps still to be aligned wait in a list, so any depth is fine."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        n_a, n_b = Counter(a[i:j]), Counter(b[k:m])
        in_a = {w: x for x, w in enumerate(a[i:j], i) if n_a[w] == 1 and n_b[w] == 1}
        anchors = [(in_a[w], y) for y, w in enumerate(b[k:m], k) if w in in_a]
        kept = [anchors[x] for x in increasing([x for x, _ in anchors])]
        if kept:
            out += kept
            edges = [(i - 1, k - 1), *kept, (j, m)]
            gaps += [(x + 1, p, y + 1, q) for (x, y), (p, q) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, words(text)
        n = len(self.words)
        # The fewest words whose share reaches least, by the same division as in scan.
        self.enough = next((k for k in range(n) if k / n >= least), n)
        self.longest = int(SPREAD * n)
        self.must = [i for i, w in enumerate(self.words) if w in NAMES or w in QUALIFIERS or w[0].isdigit()]
        self.names = [w for w in {self.words[i] for i in self.must} if not w[0].isdigit()]
        self.count = Counter(self.words)
        # Of so many words with all their repeats, one can't be missing; the longest are the rarest.
        spare = n - self.enough + 1
        self.triggers: set[str] = set()
        for w in sorted(set(self.words) - COMMON, key=lambda w: (-len(w), w)):
            if spare > 0:
                self.triggers.add(w)
                spare -= self.count[w]
        if spare > 0:
            self.triggers |= set(self.words)
        self.at = {w: [p for p, v in enumerate(self.words) if v == w] for w in self.triggers}

    def around(self, own: list[str], x: int, p: int) -> tuple[int, int, int] | None:
        """(matched words, first word, end) of the match in which own[x] is the template's word p, or None if that is no match."""
        lo, hi = max(0, x - int(SPREAD * p) - 1), x + int(SPREAD * (len(self.words) - p)) + 1
        part = own[lo:hi]
        if sum((Counter(part) & self.count).values()) < self.enough:
            return None
        left = patience(part[: x - lo], self.words[:p])
        right = patience(part[x - lo + 1 :], self.words[p + 1 :])
        pairs = [*left, (x - lo, p), *((i + x - lo + 1, k + p + 1) for i, k in right)]
        # Words far off at the ends may make a match too long for what they add.
        while len(pairs) >= self.enough and pairs[-1][0] - pairs[0][0] >= self.longest:
            drop_first = pairs[1][0] - pairs[0][0] >= pairs[-1][0] - pairs[-2][0] and pairs[0][1] != p or pairs[-1][1] == p
            pairs = pairs[1:] if drop_first else pairs[:-1]
        if len(pairs) < self.enough or pairs[-1][0] - pairs[0][0] >= self.longest:
            return None
        matched, places = {k for _, k in pairs}, {i for i, _ in pairs}
        if not all(k in matched for k in self.must):
            return None
        first, end = pairs[0][0], pairs[-1][0] + 1
        if any(part[i] in QUALIFIERS for i in range(first, end) if i not in places):
            return None
        return len(pairs), lo + first, lo + end


def scan(text: str, templates: list[Template], least: float = LEAST) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, matched words, first word, end) of the licenses in a text; of overlapping ones the best."""
    low = text.lower()
    likely = [t for t in templates if all(w in low for w in t.names) and any(w in low for w in t.triggers)]
    if not likely:
        return []
    own = words(low)
    every = frozenset().union(*(t.triggers for t in likely))
    at: dict[str, list[int]] = {}
    for i, w in enumerate(own):
        if w in every:
            at.setdefault(w, []).append(i)
    found = set()
    for t in likely:
        for w in t.triggers:
            for x in at.get(w, ()):
                for p in t.at[w]:
                    if hit := t.around(own, x, p):
                        found.add((t.name, hit[0] / len(t.words), *hit))
    begins: list[int] = []
    out: list = []
    for x in sorted(found, key=lambda x: (-x[1], -x[2], x[4] - x[3], x[0], x[3])):
        i = bisect_left(begins, x[3])
        if (i == len(begins) or out[i][3] >= x[4]) and (i == 0 or out[i - 1][4] <= x[3]):
            begins.insert(i, x[3])
            out.insert(i, x)
    return out


def find(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license found: doc_id, license, coverage, matched, start_word, end_word (numbers of words as `words` counts them, end exclusive)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(k, v, least) for k, v in templates.items()]
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) if t.is_valid for x in scan(t.as_py(), known, least)]
            if rows:
                kinds = [batch.schema.field("doc_id").type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "license", "coverage", "matched", "start_word", "end_word"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, license string, coverage double, matched long, start_word long, end_word long")
