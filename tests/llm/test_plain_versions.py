"""Mixing and the whole pipeline against plain Python versions of what they compute."""

import re
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cellwright.llm import mixing, packing, toxicity

from .test_operators import DOCS, WORDS, brute_groups


def plain_copies(rows, weights=(5.0, 2.0, 1.0), budget=1.5, most=2):
    """rows: (source, size, u, wanted) -> copies of each, by going through each source's order document by document."""
    total = Counter()
    for s, z, _, _ in rows:
        total[s] += z
    order = sorted(total, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), budget * sum(total.values())
    while True:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) >= most * total[s]}
        if not over:
            break
        target |= {s: float(most * total[s]) for s in over}
        left, free = left - sum(most * total[s] for s in over), free - over
    target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
    copies = [0] * len(rows)
    for s in order:
        mine = [i for i, r in enumerate(rows) if r[0] == s and r[1] > 0]
        low, high = 0.0, 1e9  # the factor, by bisection
        for _ in range(200):
            factor = (low + high) / 2
            low, high = (factor, high) if sum(rows[i][1] * min(rows[i][3] * factor, most) for i in mine) < target[s] else (low, factor)
        mean = {i: float(most) if target[s] >= most * total[s] else min(rows[i][3] * high, most) for i in mine}
        place = {}
        for i in mine:
            copies[i] = floor(mean[i] + 1e-12)
            p, u = mean[i] - copies[i], rows[i][2]
            if copies[i] < most:
                odds = u / (1 - u) * (1 - p) / p if p > 1e-12 else 0
                place[i] = odds / (1 + odds) if p > 1e-12 else 1 + u
        room = target[s] - sum(rows[i][1] * copies[i] for i in mine)
        limit, taken = room, set()
        for i in sorted(place, key=place.get):
            z = rows[i][1]
            if z <= limit and z <= room:
                taken.add(i)
                room -= z
            elif z <= limit:
                limit = room
                if room <= mixing.NEAR * target[s]:
                    break
        if room > mixing.NEAR * target[s]:
            near = [(abs(rows[i][1] - room), place[i], i) for i in place if i not in taken and rows[i][1] < 2 * room]
            taken |= {min(near)[2]} if near else set()
        for i in taken:
            copies[i] += 1
    return copies


def test_mixing_against_the_plain_way(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "w " * int(rng.choice([0, 3, 20, 200, 5000], p=[0.05, 0.3, 0.4, 0.24, 0.01])), "en", [None, "a", "b", "c", "d"][min(int(rng.integers(0, 9)), 4)], 0) for i in range(1500)] + [(5000, "w " * 30_000, "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for weight in (None, 1 + F.col("doc_id") % 5, F.when(F.col("doc_id") % 3 == 0, 50.0).when(F.col("doc_id") % 3 == 1, 1.0)):
        facts = df.select("doc_id", *mixing._facts(df, 17, weight, "doc_id", "text", "source")).collect()
        want = plain_copies([(r.source, r["size"], r.u, r.wanted) for r in facts])
        got = {r.doc_id: r for r in mixing.mix(df, doc_weight=weight).collect()}
        assert {r.doc_id: c for r, c in zip(facts, want)} == {i: r.copies for i, r in got.items()}
        off = defaultdict(float)
        for r in got.values():
            off[r.source, r.target] += r.taken
        assert weight is not None or all(abs(n - t) <= 0.01 * t + 200 for (_, t), n in off.items()), off


def test_many_sources_are_joined_and_not_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", f"host{i % 90}" if i % 8 else None, 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    few = sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect()) == few
    assert Counter(r.doc_id for r in mixing.mixed(df).collect()) == {i: n for i, n in few if n}


def test_equal_rows_of_which_some_are_taken(spark):
    same = [(7 if i % 2 else None, "w " * 10, "en", "a", 0) for i in range(400)]
    df = spark.createDataFrame(same + [(1000 + i, "w " * 10, "en", "bcd"[i % 3], 0) for i in range(3000)], DOCS).repartition(6)
    by = mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r.n - r.t) <= 10 for r in by)
    sums = {r.source: r.n / 10 for r in by}
    assert Counter(r.source for r in mixing.mixed(df).collect()) == sums


def plain_redaction(text):
    """The kinds that the documents below hold, one after the other."""
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
    text = re.sub(r"[0-9]+(\.[0-9]+){3}", lambda m: "[IP]" if all(int(p) <= 255 for p in m[0].split(".")) else m[0], text)
    luhn = lambda s: sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(s)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    text = re.sub(r"[0-9]([\x20-]?[0-9])+", lambda m: "[CARD]" if 12 <= len(digits(m)) <= 19 and luhn(digits(m)) else m[0], text)
    return re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: "[PHONE]" if 9 <= len(digits(m)) <= 15 else m[0], text)


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows, labels = [], []
    private = ["ask a.b@c.org", "at 10.0.0.7", "card 4111 1111 1111 1111", "no 4111 1111 1111 1112", "call +44 20 7946 0958"]
    for i in range(500):
        bad = rng.random() < 0.2
        words = [*rng.choice(WORDS, int(rng.integers(20, 60))), *(["vilewort", "nastiest"] * 3 if bad else [])]
        words.insert(5, private[i % 5]) if i % 4 == 0 else None
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, int(bad)))
    rows += [(1000 + i, rows[i][1] + " end" * (i % 2), "en", "s1", 0) for i in range(0, 60)] + [(2000, None, "en", "s2", 0), (2001, "", None, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels[:350], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    number = {int(k): i for i, k in enumerate(model.keys)}

    def score(text):
        words = toxicity.words_in(text)
        hits = Counter(number[f] for w in words for f in toxicity.features_of(w) if f in number)
        z = model.bias + sum(model.weights[0, k] * np.log1p(n) + model.weights[1, k] * np.log1p(100 * n / max(len(words), 1)) for k, n in hits.items())
        return 1 / (1 + np.exp(-z))

    kept = [r for r in rows if score(r[1]) < corpus_pipeline.TOXIC]
    assert 0.1 < 1 - len(kept) / len(rows) < 0.35

    first = Counter((d, c) for d, _, c in brute_groups([(r[0], r[1]) for r in kept], 5, 80).elements())
    kept = [r for r in kept if (r[0], r[0]) in first]
    kept = [(d, None if t is None else plain_redaction(t), *rest) for d, t, *rest in kept]
    clean = spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s, _ in kept], DOCS)
    facts = clean.select("doc_id", *mixing._facts(clean, 17, None, "doc_id", "text", "source")).collect()
    copies = dict(zip([r.doc_id for r in facts], plain_copies([(r.source, r["size"], r.u, r.wanted) for r in facts])))
    texts = {r[0]: r[1] for r in kept}
    whole = packing.encoder().whole
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, packing.END] for d, t in texts.items()}

    got, at = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append(r)
        at[r.sequence_id].append(r)
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {d: n for d, n in copies.items() if n} == {d: sum(r.length for r in p) // len(ids[d]) for d, p in got.items()}
    assert all(sum(r.length for r in p) == copies[d] * len(ids[d]) for d, p in got.items())
    for p in at.values():
        p.sort(key=lambda r: r.offset)
        assert [r.offset for r in p] == list(np.cumsum([0, *(r.length for r in p[:-1])])) and sum(r.length for r in p) <= packing.WINDOW

