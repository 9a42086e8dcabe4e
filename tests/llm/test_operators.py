"""Every operator on the defined cases (nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with
clashing names) and against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cellwright.llm import license_scan, mixing, neighbours, packing, pii, queries, resharding, text_dedup, toxicity, vector_dedup, warc

WORDS = [w + x for w in ("al", "be", "ce", "da", "ed", "fo", "gu", "hi") for x in ("n", "ro", "ma", "st")]
#: Names that operators use inside.
CLASH = ["size", "u", "slice", "target", "score", "key", "bucket", "kept", "shard", "slot", "spans", "registers", "row", "copies", "length", "m_email"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_rows():
    base = prose(1, 60)
    long_ = prose(2, 30_000)
    rows = [(1, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one  TWO"), (9, long_), (9, long_), (None, prose(3, 40)), (None, None), (10, base.upper()), (11, "mail a.b@c.de card 4111 1111 1111 1111"), (12, "x" * 100_000), (13, prose(4, 50)), (14, "é😀 " * 50)]
    return [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def own_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(odd, none):
    rows = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in odd.collect())
    assert sorted(r["size"] for r in rows) == sorted(len(own_words(t)) for _, t, *_ in odd_rows())
    assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want, left = {}, 1.5 * sum(sizes.values())
    free = set(sizes)
    while True:  # share by weight, stop at twice the size, share the excess again
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    want |= {s: level * weights[s] for s in free}
    assert {r.source: pytest.approx(r.target) for r in rows} == want
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).columns == none.columns
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, rows))
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)


def test_mixing_comes_near_targets_and_weights_count(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 200)), "en", "abcd"[min(i % 10, 3)], 0) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r.n - r.t) <= 0.01 * r.t for r in got)
    heavy = mixing.mix(df, budget=0.5, doc_weight=F.when(F.col("doc_id") < 2000, 3.0).otherwise(1.0)).groupBy(F.col("doc_id") < 2000).agg(F.sum("copies")).collect()
    share = dict(map(tuple, heavy))
    assert share[True] > 1.8 * share[False]


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in own_words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def head(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[head(i)] = head(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[head(i)] = min(low.get(head(i), d), d)
    return Counter((d, len(sets[i]), low.get(head(i))) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(9)
    rows = [(r[0], r[1]) for r in odd_rows()]
    base = prose(7, 150).split()
    for i in range(100, 220):  # around the threshold, more than a block's worth of pairs
        w = list(base)
        for p in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            w[p] = f"edit{i}x{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = text_dedup.near_duplicates(df, 4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None)
    assert text_dedup.near_duplicates(none).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    b = np.r_[a[:2400], b[:600]]
    both = np.union1d(a, b)
    ra, rb, ru = text_dedup.registers([np.unique(a), np.unique(b), both])
    assert (text_dedup.merged(ra, rb) == ru).all()
    truth = len(np.intersect1d(a, b)) / len(both)
    assert abs(text_dedup.likeliest(ra[None], rb[None], np.array([3000.0]), np.array([3000.0]))[0] - truth) < 0.15


def brute_spans(x):
    luhn = lambda s: sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(s)))) % 10 == 0
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii(spark, odd, none):
    rng = np.random.default_rng(1)
    alphabet = list("ab1 29.@+-()é😀Z") + ["4111111111111111", "1.2.3.4", "a@b.co"]
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(400)] + [r[1] for r in odd_rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).select("doc_id", pii.listed(F.filter("spans", lambda x: x["rank"] < 4)).alias("base")).collect():
        assert r.base == brute_spans(texts[r.doc_id] or "")
    said = "IBAN DE89 3704 0044 0532 0130 00, bad DE89 3704 0044 0532 0130 01. SSN 123-45-6789; order 123-45-6789 of things far away from any of the words"
    spans = pii.find(spark.createDataFrame([(1, said)], "doc_id long, text string")).first().spans
    assert [(s.kind, said[s.start : s.end]) for s in spans if s.kind in ("iban", "ssn")][:2] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.where("doc_id = 11").first().text == "mail [EMAIL] card [CARD]" and clean.where("doc_id = 4").first().text is None
    assert pii.find(none).count() == 0


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.2
        words = list(rng.choice(WORDS, 30)) + (["vilewort", "nastiest"] if bad else [])
        rows.append((i, " ".join(rng.permutation(words)), "en", "s", 0))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:900] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(1200) if i % 4 == 2 or i >= 900]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit(none, known) is None and toxicity.fit(docs, known.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_packing(spark, odd, none):
    whole = packing.encoder().whole
    want = Counter()
    for d, t, *_ in odd_rows():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, tuple(ids)] += 1
    rows = packing.pack(odd).collect()
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    got, parts = Counter(), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    for d, p in parts.items():
        total = sum(x.length for x in p)
        assert total == sum(len(ids) * n for (e, ids), n in want.items() if e == d)
    for (d, ids), n in want.items():
        if sum(m for (e, _), m in want.items() if e == d) == 1:
            assert [x for r in sorted(parts[d], key=lambda r: r.start) for x in r.ids] == list(ids)
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append(r)
    for p in seq.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit_decreasing(lengths):
    at, offset, n = packing.best_fit_decreasing(lengths, 50)
    rooms, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # the plain way
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
        room = min(fits) if fits else 50
        want[i] = 50 - room
        rooms.append(room - lengths[i])
    assert n == len(rooms) and offset == [want[i] for i in range(len(lengths))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab1'.sé中<|endoftext>　", max_size=40) | st.lists(st.sampled_from([" ", "  ", "a", "b1", "<|endoftext|>", "\n", "\x85", "\x1c", "　", "'s", "don't", "é!", " word,", " naïve***", " x<|endoftext|>", " it's", " Ωmega.", " a.b", "%%"]), max_size=12).map("".join))
def test_same_ids_as_the_tokenizer(text):
    e = packing.encoder()
    assert np.frombuffer(e.encode(text), np.uint32).tolist() == e.whole.encode(text, add_special_tokens=False).ids


def odd_vectors():
    rng = np.random.default_rng(4)
    v = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    v += [(300 + i, (np.array(v[i % 40][1]) + 0.02 * rng.standard_normal(16)).tolist()) for i in range(200)]
    v += [(600, v[0][1]), (600, v[0][1]), (601, [x * 3 for x in v[0][1]]), (602, None), (603, []), (604, [0.0] * 16), (605, [None] + [1.0] * 15), (606, [float("nan")] * 16), (607, [float("inf")] * 16), (608, [1.0, 2.0]), (None, v[5][1])]
    return v


def test_vector_dedup(spark):
    v = odd_vectors()
    df = spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<float>, cls int")
    ok = [bool(x) and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x in v]
    unit = [np.float32(x).astype(float) / np.linalg.norm(np.float32(x).astype(float)) if o else None for (_, x), o in zip(v, ok)]
    link = [[ok[i] and ok[j] and i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9 for j in range(len(v))] for i in range(len(v))]
    root = list(range(len(v)))
    for _ in range(30):
        root = [min([root[i], *(root[j] for j in range(len(v)) if link[i][j])]) for i in range(len(v))]
    low = {}
    for i, (d, _) in enumerate(v):
        if d is not None:
            low[root[i]] = min(low.get(root[i], d), d)
    want = Counter((d, sum(link[i]), low.get(root[i])) for i, (d, _) in enumerate(v))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()) == want
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vector_dedup_makes_more_passes_for_more_vectors(spark):
    assert [vector_dedup.passes_for(n, 0.9) for n in (0, 64, 10**4)] == [16, 16, 18] and vector_dedup.passes_for(10**7, 0.9) > vector_dedup.passes_for(10**6, 0.9) > 50
    rng = np.random.default_rng(6)
    v = rng.standard_normal((8000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(400):  # lone pairs just above the threshold
        side = rng.standard_normal(32)
        side -= (side @ v[i]) * v[i]
        v[400 + i] = 0.901 * v[i] + np.sqrt(1 - 0.901**2) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, window=2).collect()}
    assert np.mean([got[400 + i].component_id == i and got[i].n_links == 1 for i in range(400)]) >= 0.99


def test_neighbours(spark):
    v = odd_vectors()
    df = spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<float>, query int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = {i: np.float32(x).astype(float) for i, x in v if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)}
    hits = total = 0
    assert set(got) == {i for i in ok if i % 20 == 0}
    for q, rows in got.items():
        best = sorted((-float(x @ ok[q]), i) for i, x in ok.items() if i != q and len(x) == len(ok[q]))[:20]
        assert [r[0] for r in rows] == list(range(1, len(best) + 1))
        assert all(s == pytest.approx(float(ok[i] @ ok[q])) for _, i, s in rows)
        hits += len({i for _, i in best} & {i for _, i, _ in rows})
        total += len(best)
    assert hits / total >= 0.9
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_resharding(spark, odd, none):
    rows = resharding.reshard(odd, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert resharding.reshard(none).count() == 0
    path, affected = resharding.rewrite(odd, shards=3)
    back = odd.sparkSession.read.parquet(path)
    assert affected == [0, 1, 2] and sorted(str(r.text) for r in back.collect()) == sorted(str(t) for _, t, *_ in odd_rows())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=5), st.lists(st.integers(0, 30), min_size=1, max_size=5))
def test_flow_moves_the_fewest_bytes(supply, capacity):
    capacity = [*capacity, max(0, sum(supply) - sum(capacity))]
    flow = resharding.cheapest_flow(supply, capacity)
    assert all(sum(x for (a, _), x in flow.items() if a == i) == s for i, s in enumerate(supply))
    assert all(sum(x for (_, b), x in flow.items() if b == j) <= c for j, c in enumerate(capacity))
    stay = sum(min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity))
    assert sum(x for (a, b), x in flow.items() if a != b) == sum(supply) - stay


def test_warc(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "é", "é" * 50_000), (5, "é", "é" * 50_000), (6, "u", "\r\n\r\n")] + [(100 + i, "u", prose(i, 100)) for i in range(30)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, frame int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.write(df)).collect())
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in pages:
        raw, f = (h or "").encode(), first[h or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == f else "revisit", None if i == f else f] += 1
    assert got == want
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_reader_refuses_damage():
    raw = warc.record("response", 1, "http://a", "2024-01-01T00:00:00Z", b"body " * 400)
    frame = warc._compressor(b"").compress(raw)
    good = warc.dictionary_frame(b"") + frame * 2
    assert [warc.parsed(x)["payload"] for x in warc.frames(good)] == [b"body " * 400] * 2
    for bad in (good[:-3], good + b"junk!!", b"\x5d\x2a\x4d\x18\xff\xff\x00\x00ab"):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length", b"Content-Size"), (b"body body", b"body bodz"), (b"WARC-Date", b"WARC-When")):
        with pytest.raises(warc.WarcError):
            warc.parsed(raw.replace(old, new))


def test_license_scan(spark, odd, none):
    mit, isc = license_scan.TEMPLATES["mit-text"], license_scan.TEMPLATES["isc-text"]
    changed = mit.replace("free of charge", "without charge").replace("modify, ", "")
    rows = [(1, f"{prose(1, 3000)} {mit} {prose(2, 50)}"), (2, f"{prose(3, 20)}\n{changed}"), (3, f"{isc}\n{prose(5, 10)}\n{isc}"), (4, " ".join(mit.split()[:40])), (5, None), (6, ""), (7, prose(8, 20_000)), (8, "Released under the MIT License. " * 3), (None, isc)]
    got = license_scan.find(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, coverage int")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter({(1, "mit-text"): 1, (2, "mit-text"): 1, (3, "isc-text"): 2, (8, "mit"): 3, (None, "isc-text"): 1})
    assert all(r.coverage == 1 for r in got if r.doc_id != 2)
    assert license_scan.find(none).count() == 0 and license_scan.find(odd).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_longest_increasing(values):
    got = [values[i] for i in license_scan.increasing(values)]
    best = [0] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < v], default=0)
    assert got == sorted(set(got)) and len(got) == max(best, default=0)


def test_pipeline_stages(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        if name == "near_duplicates":
            groups = text_dedup.near_duplicates(docs).collect()
            known = {r.component_id for r in groups if r.doc_id is not None}
            assert {r.doc_id for r in out.collect() if r.doc_id is not None} == known and out.where("doc_id = 9").count() == 1
        if name == "pii":
            assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())
        assert name in ("mixing", "packing") or out.count() <= docs.count()
        docs = out.cache() if name != "packing" else out
    assert docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names


def test_pii_query_counts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_pii(spark, sf).collect():
        base = brute_spans(texts[r.doc_id] or "")
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r.spans.split(",")) or not base


def test_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op1_mixing": "doc_id size source_size target taken",
        "op2_warc": "page_id payload_bytes payload_digest record_type refers_to",
        "op4_vector_dedup": "vec_id n_links component_id kept",
        "op7_toxicity": "doc_id held_out score predicted",
        "op8_neighbours": "query_id rank vec_id score",
        "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op10_resharding": "doc_id size text_crc32 law shard slot grown_shard",
    }
    for name, columns in want.items():
        out = queries.queries()[name](spark, sf)
        assert set(columns.split()) <= set(out.columns) and out.count() > 0
