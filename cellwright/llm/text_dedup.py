"""MinHash near-dedup with SetSketch registers.

Register values are floor(1 - log_b x) of the first arrival time x of a Poisson process that the shingles drive:
exponentially spaced, truncated to 16 bits, and mergeable by maximum. Bands of registers propose pairs, a joint
maximum-likelihood estimate of the similarity from (greater, smaller, equal) register counts and the known set sizes
rejects hopeless ones, and the full shingle sets confirm the rest.

Documents with equal shingle sets are one class from the start, so copies never meet in pairs. In a band's bucket
each class is first compared with one hub. Only classes that then share a bucket with one of another component are
compared with it, in blocks of bounded size inside the tasks: by registers first, and where those leave it open by full
sets. The blocks give out links between components, never pairs.

Defined cases. Null or word-less text: empty set, linked with nothing. Null doc_id: takes part; never the smallest id
of a component unless all its ids are null. Repeated rows: one class. Empty table: empty result. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, components, cut, in_small_batches, lean, mixed, words_of
from .places import at_rest, chosen, marked, place, without

REGISTERS, ROWS = 192, 6
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Words whose shingles are worked on at once; a longer document is worked on by itself.
CHUNK = 200_000
#: Members of a block in which classes of one bucket are compared.
BLOCK = 256

_hashes = WordHashes(150_000)


def shingle_sets(texts: list[str | bytes | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; of fewer words, of the whole sequence."""
    words = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    out = []
    step = np.uint64(0x9E3779B97F4A7C15)
    if len(flat) >= k:
        rolled = flat[: len(flat) - k + 1].copy()
        for i in range(1, k):
            rolled = rolled * step + flat[i : len(flat) - k + 1 + i]
        rolled = mixed(rolled)
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(rolled[end - n : end - k + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for w in flat[end - n : end]:
                h = mixed(h * step + w)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers, a row of m 16-bit values for each set. Each element drives a Poisson process of rate m whose arrivals fall on
    uniform registers; an element rests as soon as its next arrival can change no register."""
    first = np.full((len(sets), m), np.inf)
    flat = first.reshape(-1)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        r = mixed(element + np.uint64((turn * 0xD1B54A32D192ED03) & (2**64 - 1)))
        at = at - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / m
        place = ((r & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, of * m + place, at)
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        worst = first[of[heads]].max(axis=1)
        awake = at < np.repeat(worst, np.diff(np.r_[heads, len(of)]))
        element, of, at = element[awake], of[awake], at[awake]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(first / RATE) / np.log(BASE))
    return np.clip(value, 0, TOP).astype(np.uint16)


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The registers of a union are the largest of its parts' registers."""
    return np.maximum.reduce(sketches)


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of sketches (rows of a and b) whose set sizes are known."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    tiny = 1e-12

    def fit(j):
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (5**0.5 - 1) / 2
    for _ in range(32):  # the likelihood is concave
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        left = fit(c) > fit(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch that hold about CHUNK words at most, with their texts as UTF-8; the others' texts stay in Arrow."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n // 6 + 1
        if size >= CHUNK or i == len(sizes) - 1:
            part = batch.slice(begin, i + 1 - begin)
            yield part, part.column("text").cast(pa.binary()).to_pylist()
            begin, size = i + 1, 0


def _named(text: bytes | None) -> bytes:
    """What tells texts without words apart, in place of registers."""
    return b"" if text is None else hashlib.blake2b(text, digest_size=16).digest()


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                sets = shingle_sets(texts, k)
                sketch = registers(sets)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("file"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() if q else _named(t) for r, q, t in zip(sketch, keys, texts)], pa.binary())],
                    ["doc_id", "file", "row", "n_shingles", "key", "registers"],
                )
        _hashes.clear()  # a worker lives on through all stages

    return run


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                sets = shingle_sets(texts, k)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "shingles"])
        _hashes.clear()

    return run


def _bands(spark_col: Column) -> Column:
    """One 64-bit key for each band of ROWS registers (two bytes each), its number mixed in."""
    return F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(F.substring(spark_col, i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i))


def _estimator(least: float):
    """Pairs (a, b) whose registers make a similarity of `least` likely, some thousands at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                a, b = (np.frombuffer(b"".join(part.column(f"registers_{x}").to_pylist()), np.uint16).reshape(len(part), -1) for x in "ab")
                j = likeliest(a, b, *(part.column(f"n_{x}").to_numpy().astype(float) for x in "ab"))
                yield part.select(["a", "b"]).filter(pa.array(j >= least))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    Links join documents with 100 * |intersection| >= percent * |union| of their shingle sets. A pair at the threshold of
    0.8 shares one of the 32 bands with probability 0.99994; each proposed link is confirmed on the full sets."""
    found = grouped(at_rest(docs), shingle, percent, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates, all columns: the one with the least id, null ids last, and
    of rows that share that id the first by place. Texts without words are groups of their own; of those that share an id
    one stays for each text. No text is shuffled."""
    docs = at_rest(docs)
    found = grouped(docs, shingle, percent, id_col, text_col)
    return without(docs, cut(found.where("not first").select("file", "row"), "dropped"))


def grouped(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs (at rest) by place: doc_id, file, row, n_shingles, component_id, first (is it its group's first row?)."""
    in_small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *place(docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.mapInArrow(lean(_sketcher(shingle)), f"doc_id {id_type}, file long, row long, n_shingles long, key binary, registers binary"), "sketches")
    # Order of a group's rows: by id, null last, then by place.
    head = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "file", "row")
    classes = cut(rows.where("key is not null").groupBy("key").agg(F.min(head).alias("head"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes")

    member = classes.select("key", F.posexplode(_bands(F.col("registers"))).alias("band", "bucket"))
    hubs = member.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key", "bucket").alias("h"), "key"))["key"].alias("hub"), F.count("*").alias("n")).where("n > 1")
    # Few of the classes' bands meet others, so what is left of several partitions goes to one file.
    files = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 6)
    member = cut(member.join(hubs, "bucket").coalesce(files), "members")
    stars = member.where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    links = _confirmed(docs, classes, stars, shingle, percent)
    found = components(links)

    # Which classes share a bucket with one of another component? First by registers, then by full sets.
    member = cut(_unsettled(member.select("bucket", "band", "key").join(found.withColumnRenamed("node", "key"), "key", "left").select("bucket", "band", "key", F.coalesce("root", "key").alias("root"))), "unsettled")
    sketch = classes.select("key", "registers", "n")
    likely = _dealt(member).join(sketch, "key").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lean(_block_job(percent, False)), "bucket long, key binary")
    likely = cut(likely.distinct(), "likely")
    member = cut(member.join(likely, ["bucket", "key"], "left_semi"), "unsettled", (likely, member))
    sets = _sets(docs, classes, member.select("key"), shingle)
    more = _dealt(member).join(sketch, "key").join(sets, "key").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lean(_block_job(percent, True)), "a binary, b binary")
    found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # From classes back to documents.
    named = classes.select("key", "head").join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "head", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("head").alias("least"))
    named = named.join(least, "root").select("key", "least")
    out = rows.join(named, "key", "left")
    alone = F.col("key").isNull()
    blank = rows.where("key is null and doc_id is not null").groupBy(F.col("doc_id").alias("b_id"), F.col("registers").alias("b_text")).agg(F.min(F.struct("file", "row")).alias("b"), F.count("*").alias("times")).where("times > 1")
    out = out.join(blank, alone & (F.col("doc_id") == F.col("b_id")) & (F.col("registers") == F.col("b_text")), "left")
    least = F.when(alone, F.col("b")).otherwise(F.struct("least.file", "least.row"))
    first = least.isNull() | ((F.col("file") == least["file"]) & (F.col("row") == least["row"]))
    return out.select("doc_id", "file", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), first.alias("first"))


def _unsettled(member: DataFrame) -> DataFrame:
    """The members (bucket, band, key, root) of buckets that hold several roots, each with the sizes of its bucket's
    two parts: the members of the most frequent root there (major), which need no comparison among themselves, and the others."""
    roots = member.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    tops = roots.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all")).where("all > top.c")
    tops = tops.select("bucket", F.col("top.root").alias("major"), (F.col("all") - F.col("top.c")).alias("minors"), F.col("top.c").alias("majors"))
    return member.join(tops, "bucket").withColumn("major", F.col("root") == F.col("major"))


def _dealt(member: DataFrame) -> DataFrame:
    """Members dealt to pairs of blocks (i, j) of about BLOCK members, so that every two members of which one isn't
    major meet in one pair; own is a member's block. A bucket of BLOCK members or fewer is a single block."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    single = F.col("minors") + F.col("majors") <= BLOCK
    nth = lambda n: F.pmod(F.xxhash64("key"), blocks(n)).cast("int")
    own = F.when(single, 0).when(F.col("major"), blocks("minors") + nth("majors")).otherwise(nth("minors"))
    last = F.when(single, 0).when(F.col("major"), blocks("minors") - 1).otherwise(blocks("minors") + blocks("majors") - 1)
    dealt = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("bucket", "band", "key", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _block_job(percent: int, exact: bool):
    """Over rows sorted by (bucket, i, j): compare the members of different roots in each pair of blocks, two classes only
    in the first band they share. By registers, yield the members (bucket, key) of likely links; with the full sets, links
    (a, b) that connect what wasn't yet connected in this task."""
    j0 = percent / 100
    least = j0 - 5 * (j0 * (1 - j0) / REGISTERS) ** 0.5
    mult = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(ROWS)], np.uint64)

    def likely(rows: dict, out: list, parent: dict) -> None:
        n = len(rows["key"])
        own, i, j = np.array(rows["own"]), rows["i"][0], rows["j"][0]
        left, right = (np.arange(n),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        r = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(n, REGISTERS)
        band = mixed((r.reshape(n, -1, ROWS).astype(np.uint64) * mult).sum(axis=2, dtype=np.uint64))
        names = {k: x for x, k in enumerate(dict.fromkeys(rows["root"]))}
        root = np.array([names[k] for k in rows["root"]])
        size = np.array(rows["n"], float)
        for lo in range(0, len(left), 64):
            x = left[lo : lo + 64]
            same = band[x][:, None, :] == band[right][None, :, :]
            fit = (same.argmax(axis=2) == rows["band"][0]) & same.any(axis=2) & (root[x][:, None] != root[right][None, :])
            if i == j:
                fit &= x[:, None] < right[None, :]
            fit &= 100 * np.minimum(size[x][:, None], size[right][None, :]) >= percent * np.maximum(size[x][:, None], size[right][None, :])
            u, v = np.nonzero(fit)
            u, v = x[u], right[v]
            if len(u):
                near = np.flatnonzero((r[u] == r[v]).sum(axis=1) >= least * REGISTERS * 0.8)
                near = near[likeliest(r[u[near]], r[v[near]], size[u[near]], size[v[near]]) >= least] if len(near) else near
                for a, b in zip(u[near].tolist(), v[near].tolist()):
                    link(rows, a, b, out, parent) if exact else out.extend(((rows["bucket"][0], rows["key"][a]), (rows["bucket"][0], rows["key"][b])))

    def head(parent: dict, x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(rows: dict, a: int, b: int, out: list, parent: dict) -> None:
        ra, rb = head(parent, rows["root"][a]), head(parent, rows["root"][b])
        if ra != rb:
            s, t = rows["shingles"][a], rows["shingles"][b]
            shared = len(np.intersect1d(s, t, assume_unique=True))
            if shared * 100 >= (len(s) + len(t) - shared) * percent:
                parent[ra] = rb
                out.append((rows["root"][a], rows["root"][b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"] if exact else ["bucket", "key"]
        kinds = [pa.binary(), pa.binary()] if exact else [pa.int64(), pa.binary()]
        held, at, parent = None, None, {}

        def done(rows: dict | None):
            out: list = []
            if rows and len(rows["key"]) > 1:
                likely(rows, out, parent)
            out = list(dict.fromkeys(out))
            if len(parent) > 200_000:
                parent.clear()
            return [pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kinds[c]) for c in (0, 1)], names)] if out else []

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "shingles"}
            if exact:
                lists = batch.column("shingles")
                flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                cols["shingles"] = [flat[lo:hi] for lo, hi in zip(off[:-1], off[1:])]
            keys = list(zip(cols["bucket"], cols["i"], cols["j"]))
            starts = [x for x in range(len(keys)) if x == 0 or keys[x] != keys[x - 1]] + [len(keys)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                part = {c: v[lo:hi] for c, v in cols.items()}
                if keys[lo] == at:
                    held = {c: held[c] + part[c] for c in held}
                else:
                    yield from done(held)
                    held, at = part, keys[lo]
        yield from done(held)

    return run


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # 192 registers estimate 0.8 with a deviation of 0.029; five of them below the threshold lose about one pair in 3 million.
    j = percent / 100
    near = cut(near.mapInArrow(lean(_estimator(j - 5 * (j * (1 - j) / REGISTERS) ** 0.5)), "a binary, b binary"), "pairs")
    sets = _sets(docs, classes, near.select(F.explode(F.array("a", "b")).alias("key")), k)
    # The hub of a star is a in some pairs and b in others; what repeats is matched last, so it isn't moved again.
    often = near.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("times"))
    near = near.join(often.select(F.col("key").alias("a"), F.col("times").alias("ta")), "a").join(often.select(F.col("key").alias("b"), F.col("times").alias("tb")), "b")
    near = near.select(F.when(F.col("ta") >= F.col("tb"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("ta") >= F.col("tb"), F.col("b")).otherwise(F.col("a")).alias("leaf"))
    both = near.join(sets.select(F.col("key").alias("leaf"), F.col("shingles").alias("s")), "leaf").join(sets.select(F.col("key").alias("hub"), F.col("shingles").alias("t")), "hub")
    shared = F.size(F.array_intersect("s", "t"))
    both = both.select("hub", "leaf", shared.alias("shared"), (F.size("s") + F.size("t") - shared).alias("all"))
    return both.where(F.col("shared") * 100 >= F.col("all") * percent).select(F.least("hub", "leaf").alias("a"), F.greatest("hub", "leaf").alias("b"))


def _sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(key, shingles) of the given classes, from the text of one document of each, which is read again at its place."""
    wanted = keys.distinct().join(classes.select("key", "head.file", "head.row"), "key")
    return cut(chosen(docs, marked(wanted.select("file", "row")), [F.col("text")], _setter(k), "key binary, shingles array<long>"), "sets")
