"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic classifier over words and word beginnings of whole texts is trained from confirmed toxic examples P and
unlabelled text U by minimising  prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1)):  U holds toxic texts too, so their
expected share is subtracted from its risk as a negative, and where that turns the term negative (a sign of overfitting)
the step goes the other way. Training uses a bounded sample (`positives` and `unlabelled` documents, by hash of the id), which is
collected as counts over a bounded vocabulary (the `vocabulary` features whose frequencies differ most between P and U): at most
8 * (positives + unlabelled) * vocabulary bytes, 384 MB by default. Whether beginnings of words are features, or whole words
alone, is decided by the risk on a quarter of that sample that took no part in a first training; no other row decides on
anything. Scoring reads every text with the finished weights.

Defined cases. Null or word-less text: the score of no words. Null doc_id: scored, never trained on.
Null, absent or repeated labels: not confirmed, or confirmed once. No confirmed example at all: every score is 0.
Empty table: empty result. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, lean

PREFIXES = (4, 5, 6, 7, 8)
#: Words whose features a worker remembers.
REMEMBERED = 100_000
EPOCHS, BATCH, RATE, DECAY, SEED = 60, 1024, 0.02, 1e-3, 17

_BREAKS = bytes(c if 97 <= c <= 122 or c > 127 or c in (9, 10, 11, 12, 13) else 32 for c in bytes(range(256)))


def words_in(text: str | None) -> list[bytes]:
    """Words in lower case; ASCII characters other than letters part words."""
    return [] if text is None else text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split()


def features_of(word: bytes) -> list[int]:
    """Hashes of a word, even, and of its beginnings, odd."""
    text = word.decode("utf-8", "replace")
    beginnings = [text[:n].encode("utf-8", "surrogatepass") for n in PREFIXES if len(text) >= n]
    return [(xxhash.xxh3_64_intdigest(word) >> 1 << 1) - (1 << 63)] + [(xxhash.xxh3_64_intdigest(x) | 1) - (1 << 63) for x in beginnings]


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # for each key by count, and by rate
    bias: float
    prior: float


class Places(dict):
    """By word, the numbers of its features in the vocabulary; emptied when full."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.number = {int(k): i for i, k in enumerate(keys)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return got

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature numbers of a text in order, how often it has each, and its words."""
        words = words_in(text)
        hits = [i for got in map(self.__getitem__, words) if got for i in got]
        return *np.unique(np.array(hits, np.int64), return_counts=True), len(words)


def values(counts: np.ndarray, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature the log of its count and of its rate."""
    return np.log1p(counts), np.log1p(100 * counts / np.maximum(words, 1))


@dataclass(frozen=True)
class Sample:
    """Documents as rows of a sparse matrix: the features of row i are at[begin[i]:begin[i + 1]]; each has two values."""

    begin: np.ndarray
    at: np.ndarray
    x: np.ndarray  # (2, features)

    def __len__(self) -> int:
        return len(self.begin) - 1

    def rows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, values, place in `some`) of the rows in `some`."""
        sizes = self.begin[some + 1] - self.begin[some]
        of = np.repeat(np.arange(len(some)), sizes)
        take = np.arange(len(of)) + np.repeat(self.begin[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        return self.at[take], self.x[:, take], of


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, len(batch), 64):
            part = batch.slice(begin, 64)
            sets = [{f for w in set(words_in(t.as_py())) for f in features_of(w)} for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array([np.fromiter(s, np.int64, len(s)) for s in sets], pa.list_(pa.int64()))], ["positive", "found"])


def _scores(w: np.ndarray, b: float, part: tuple, n: int) -> np.ndarray:
    at, x, of = part
    return np.bincount(of, w[0, at] * x[0] + w[1, at] * x[1], n) + b


def risk(w: np.ndarray, b: float, p: Sample, some_p: np.ndarray, u: Sample, some_u: np.ndarray, prior: float) -> float:
    """The non-negative risk of weights on some rows."""
    z_p, z_u = _scores(w, b, p.rows(some_p), len(some_p)), _scores(w, b, u.rows(some_u), len(some_u))
    return prior * np.logaddexp(0, -z_p).mean() + max(0.0, np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean())


def train(p: Sample, some_p: np.ndarray, u: Sample, some_u: np.ndarray, width: int, prior: float, use: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (2, width) and bias, by Adam on the non-negative risk with the logistic loss; `use`: the features that may have weights."""
    rng = np.random.default_rng(SEED)
    w, b = np.zeros((2, width)), float(np.log(prior / (1 - prior)))
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    steps = max(1, (len(some_u) + BATCH - 1) // BATCH)
    turn = 0
    for _ in range(epochs):
        order_p, order_u = rng.permutation(some_p), rng.permutation(some_u)
        for part_p, part_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
            if not len(part_p) or not len(part_u):
                continue
            in_p, in_u = p.rows(part_p), u.rows(part_u)
            z_p, z_u = _scores(w, b, in_p, len(part_p)), _scores(w, b, in_u, len(part_u))
            s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
            negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
            if negative >= 0:
                g_p, g_u = prior * (s_p - 1 - s_p) / len(z_p), s_u / len(z_u)
            else:  # undo the overfitting
                g_p, g_u = prior * s_p / len(z_p), -s_u / len(z_u)
            grad, grad_b = DECAY * w, g_p.sum() + g_u.sum()
            for (at, x, of), g in ((in_p, g_p), (in_u, g_u)):
                grad += np.stack([np.bincount(at, g[of] * v, width) for v in x])
            grad *= use
            turn += 1
            m_w, v_w, m_b, v_b = 0.9 * m_w + 0.1 * grad, 0.999 * v_w + 0.001 * grad * grad, 0.9 * m_b + 0.1 * grad_b, 0.999 * v_b + 0.001 * grad_b * grad_b
            rate, c = RATE / (1 - 0.9**turn), 1 - 0.999**turn
            w, b = w - rate * m_w / (np.sqrt(v_w / c) + 1e-8), b - rate * m_b / (np.sqrt(v_b / c) + 1e-8)
    return w, b


def chosen_features(p: Sample, u: Sample, whole: np.ndarray, prior: float) -> np.ndarray:
    """Which features may have weights: all, or whole words alone if those leave less risk on every fourth row after a training on the others."""
    split = lambda n: (np.flatnonzero(np.arange(n) % 4 != 3), np.flatnonzero(np.arange(n) % 4 == 3))
    (fit_p, test_p), (fit_u, test_u) = split(len(p)), split(len(u))
    every = np.ones(len(whole), bool)
    if not len(test_p) or not len(test_u) or whole.all():
        return every
    left = [risk(*train(p, fit_p, u, fit_u, len(whole), prior, use), p, test_p, u, test_u, prior) for use in (every, whole)]
    return whole if left[1] < left[0] else every


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, prior: float | None = None, positives: int = 6_000, unlabelled: int = 18_000, vocabulary: int = 2_000, least_docs: int = 5, least_z: float = 4.0) -> Model | None:
    """A model from documents whose id satisfies `use` (default: all), or None without confirmed examples.

    prior: the share of toxic documents; by default that among the labelled ones in use. U is drawn from all documents
    in use, whatever their labels say. positives, unlabelled: most documents of P and U. vocabulary: most features; least_docs: documents of
    the sample a feature must be in; least_z: the least z-score of the difference of its frequencies in P and U."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    docs = docs.where(use) if use is not None else docs
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
    known = known.where(use) if use is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return None
    prior = min(max(prior if prior is not None else toxic / n, 1e-4), 0.9)
    first = lambda ids, most: ids.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
    chosen_p = first(known.where("toxic = 1").select("doc_id"), positives).withColumn("positive", F.lit(True))
    chosen_u = first(docs.select("doc_id").distinct(), unlabelled).withColumn("positive", F.lit(False))
    # At most positives + unlabelled ids are broadcast.
    sample = cut(docs.join(F.broadcast(chosen_p.union(chosen_u)), "doc_id"), "sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return None
    seen = sample.select("positive", "text").mapInArrow(lean(_features), "positive boolean, found array<long>").select("positive", F.explode("found").alias("f"))
    seen = seen.groupBy("f").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u")).where(f"p + u >= {int(least_docs)}")
    n_p, n_u = sizes[True], sizes[False]
    mean = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u) + 1e-12)
    keys = np.sort(np.array([r[0] for r in seen.withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "f").limit(vocabulary).collect()], np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(keys)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                got = [places.counts(t.as_py()) for t in part.column("text")]
                cols = [pa.array([x[i] for x in got], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("h"), *cols, pa.array([x[2] for x in got], pa.int64())], ["positive", "h", "at", "n", "words"])

    rows = sample.select("positive", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(lean(counted), "positive boolean, h long, at array<int>, n array<int>, words long").toArrow().combine_chunks()
    rows = rows.sort_by([("positive", "ascending"), ("h", "ascending")])
    sets = [_sample(rows.filter(rows["positive"]) if flag else rows.filter(pc.invert(rows["positive"]))) for flag in (True, False)]
    whole = keys % 2 == 0
    may = chosen_features(*sets, whole, prior)
    w, b = train(sets[0], np.arange(len(sets[0])), sets[1], np.arange(len(sets[1])), len(keys), prior, may)
    return Model(keys, w, b, prior)


def _sample(rows: pa.Table) -> Sample:
    flat = lambda name: pa.concat_arrays([c.flatten() for c in rows[name].chunks]).to_numpy() if len(rows) else np.empty(0, np.int64)
    sizes = pc.list_value_length(rows["at"]).to_numpy() if len(rows) else np.empty(0, np.int64)
    words = np.repeat(rows["words"].to_numpy(), sizes)
    return Sample(np.r_[0, np.cumsum(sizes)].astype(np.int64), flat("at"), np.stack(values(flat("n"), words)))


def scorer(model: Model | None):
    """An Arrow UDF: text to score."""
    cache: list[Places] = []

    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(texts)))
        if not cache:
            cache.append(Places(model.keys))
        w = model.weights
        z = np.array([sum(w[i, at] @ x for i, x in enumerate(values(n, words))) for at, n, words in (cache[0].counts(t.as_py()) for t in texts)], float) + model.bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")


def score(docs: DataFrame, model: Model | None, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= least) for every row."""
    df = docs.select(F.col(id_col).alias("doc_id"), scorer(model)(F.col(text_col)).alias("score"))
    return df.select("doc_id", "score", (F.col("score") >= least).cast("int").alias("predicted"))
