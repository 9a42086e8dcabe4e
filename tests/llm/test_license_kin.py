"""Licenses are told from their kin, matches are bounded in span, and the scan agrees with an exhaustive one."""

import numpy as np

from cellwright.llm import license_scan
from cellwright.llm.license_scan import LEAST, QUALIFIERS, SPREAD, TEMPLATES, Template, patience, scan, words

KNOWN = [Template(k, v, LEAST) for k, v in TEMPLATES.items()]


def names(text):
    return [x[0] for x in scan(text, KNOWN)]


def test_kin():
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    assert names("Licensed under the Apache License, Version 1.0.") == ["apache-1.0"]
    assert names("Licensed under the Apache License, Version 1.1") == ["apache-1.1"]
    assert names("Licensed under the Apache License, v2") == ["apache-2.0"]
    assert names("Licensed under the Apache License, Version 3.0.") == []
    assert names(gnu.format("", 2)) == ["gpl-2.0"]
    assert names(gnu.format("Lesser ", 3)) == ["lgpl-3.0"]
    assert names(gnu.format("Lesser ", 2.1)) == ["lgpl-2.1"]
    assert names(gnu.format("Affero ", 3)) == ["agpl-3.0"]
    assert names(gnu.format("", 7)) == []
    for kind in ("BY", "BY-ND", "BY-SA", "BY-NC", "BY-NC-ND", "BY-NC-SA"):
        for version in ("3.0", "4.0"):
            assert names(f"Licensed under CC {kind} {version}.") == [f"cc-{kind.lower()}-{version}"]
    assert names(TEMPLATES["mpl-1.1"]) == ["mpl-1.1"] and names(TEMPLATES["mpl-2.0"]) == ["mpl-2.0"]
    assert names("Released under the BSD License.") == []
    assert names(TEMPLATES["gpl-3.0-notice"].replace("version 3", "version 2")) == ["gpl-2.0-notice"]
    assert all(names(v) == [k] for k, v in TEMPLATES.items())


def test_scattered_words_are_no_license():
    rng = np.random.default_rng(1)
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 500, n)]
    spread = [x for w in words(TEMPLATES["mit-text"]) for x in (w, *filler(12))]
    assert names(" ".join(spread)) == []
    twice = filler(30) + words(TEMPLATES["mit-text"])[:40] + filler(10) + words(TEMPLATES["mit-text"]) + filler(30)
    assert [(x[0], x[1], x[3]) for x in scan(" ".join(twice), KNOWN)] == [("mit-text", 1.0, 80)]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        b = [f"w{x}" for x in rng.integers(0, 60, 40)]
        a = [w for w in b if rng.random() > 0.1]
        for _ in range(3):
            a.insert(int(rng.integers(0, len(a))), f"new{rng.integers(0, 9)}")
        pairs = patience(a, b)
        assert all(a[i] == b[k] for i, k in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert 0.9 * longest_common(a, b) <= len(pairs) <= longest_common(a, b)


def exhaustive(text):
    """Licenses of which some window of at most SPREAD times the words holds enough, by dynamic programming over every window."""
    own, out = words(text), set()
    for t in KNOWN:
        n = len(t.words)
        if len(set(own) & set(t.words)) * 2 < len(set(t.words)):
            continue
        for a in range(len(own)):
            part = own[a : a + int(SPREAD * n)]
            named = [w for w in part if w in QUALIFIERS]
            if longest_common(part, t.words) / n >= LEAST and all(t.words[i] in part for i in t.must) and sorted(named) == sorted(w for w in t.words if w in QUALIFIERS):
                out.add(t.name)
    return out


def test_scan_against_every_window():
    rng = np.random.default_rng(3)
    pick = ["mit-text", "isc-text", "bsd-text", "apache-2.0-notice", "gpl-3.0-notice", "mpl-1.1"]
    for i in range(24):
        w = words(TEMPLATES[pick[i % 6]])
        keep = 0.93 if i % 2 else 0.6
        must = {w[k] for k in Template("x", TEMPLATES[pick[i % 6]], LEAST).must}
        w = [x for x in w if x in must or rng.random() < keep]
        text = " ".join([f"f{x}" for x in rng.integers(0, 99, 20)] + w + [f"f{x}" for x in rng.integers(0, 99, 20)])
        assert set(names(text)) <= exhaustive(text) and bool(names(text)) == bool(exhaustive(text)), (pick[i % 6], text)
