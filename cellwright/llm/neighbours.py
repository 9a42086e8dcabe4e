"""Approximate nearest neighbours: low-dimensional stable projections indexed by kd-trees.

Vectors are projected to PROJECTED dimensions by Gaussian (2-stable) weights, so a projected squared distance over the true one
follows a chi-square law. Projected neighbours are verified exactly, nearest first, until the law says with probability SURE that
whatever is nearer than the k-th best so far would already have come. Inner products become distances by one more
coordinate, which brings all vectors to one length.

The index has two levels. A kd-tree over a sample's projections (SAMPLE vectors; every vector is indexed) deals the vectors to cells;
a cell of more than SHARD vectors is searched in pieces. Each query is searched in its own cell first. The k-th score found there
is its bound elsewhere: cells whose boxes lie beyond the chi-square limit aren't visited, and in those that are, a second
kd-tree gives out leaves, of whose vectors only those within the limit are verified. Leaves are verified for all queries of
a block at once by a matrix product; what may be among the best is scored again, each pair by itself.

Equal vectors are one class, of which the k + 1 smallest ids can matter, so copies are neither searched for nor through one by one.

Defined cases. Vectors that are null, empty, zero, or hold null or non-finite components: neither queries nor
candidates. Null vec_id: no part. Vectors of another length than the query's: no candidates. Repeated rows (id and
vector): one. Fewer candidates than k: all. Ties: smaller vec_id. Empty table: empty result. Other columns are ignored."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut
from .vector_dedup import usable

PROJECTED, SHARD, QUERIES, LEAF, SURE, SEED = 12, 8192, 512, 64, 0.95, 31
#: Vectors that the first level's tree is made from, on the driver (about 16 MB at 128 dimensions); leaves of the first ring of a search.
SAMPLE, RING = 16_384, 8


@lru_cache(maxsize=8)
def chi_square_quantile(dimensions: int, p: float) -> float:
    """Where the chi-square law of an even number of dimensions reaches p: 1 - exp(-x/2) * sum of (x/2)^i / i!, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, dimensions // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < p else (low, x)
    return high


def projected(x: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Projections of vectors with one more coordinate."""
    weights = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1] + 1, PROJECTED))
    return x @ weights[:-1] + lift[:, None] * weights[-1]


def lifts(x: np.ndarray, reach: float) -> np.ndarray:
    return np.sqrt(np.maximum(reach - (x * x).sum(axis=1), 0))


class KdTree:
    """Points split at the median of the widest side until at most `leaf` are together; a point on the cut goes right."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.at, self.child, self.leaves = [], [], [], []
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, inside: np.ndarray, leaf: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.at.append(0.0)
        self.child.append((-1, -1))
        own = points[inside]
        if len(inside) > leaf:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            at = float(np.partition(own[:, axis], len(own) // 2)[len(own) // 2])
            right = own[:, axis] >= at
            if not right.all():
                self.axis[node], self.at[node] = axis, at
                self.child[node] = (self._grow(points, inside[~right], leaf), self._grow(points, inside[right], leaf))
                return node
        self.child[node] = (len(self.leaves), -1)
        self.leaves.append(inside)
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, inside = todo.pop()
            if self.axis[node] < 0:
                out[inside] = self.child[node][0]
            else:
                right = points[inside, self.axis[node]] >= self.at[node]
                todo += [(self.child[node][0], inside[~right]), (self.child[node][1], inside[right])]
        return out


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for m in range(points.shape[1]):
        p = points[:, m : m + 1]
        g = np.maximum(np.maximum(low[:, m] - p, p - high[:, m]), 0)
        out += g * g
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed alike for every pair, so that equal vectors get equal scores."""
    return (x * q).sum(axis=1)


def search(x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, reach: float, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows of q, rows of x, scores, products verified): for each query all of x that the test lets through and whose score is at least the
    k-th of them and `bound`."""
    needed = chi_square_quantile(PROJECTED, sure)
    px, pq = projected(x, lifts(x, reach)), projected(q, np.zeros(len(q)))
    tree = KdTree(px, LEAF)
    order = np.concatenate(tree.leaves)
    begin = np.cumsum([0, *map(len, tree.leaves)])
    x_, px = x[order], px[order]
    low, high = np.minimum.reduceat(px, begin[:-1]), np.maximum.reduceat(px, begin[:-1])
    gap = gaps(pq, low, high)
    place = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1, kind="stable")
    base = reach + (q * q).sum(axis=1)
    lengths_x, lengths_q = (px * px).sum(axis=1), (pq * pq).sum(axis=1)
    score = np.full((len(q), len(x)), -np.inf)
    bound, seen = bound.copy(), 0
    begin_ring, end_ring = 0, len(tree.leaves) if np.isfinite(bound).all() else RING
    while begin_ring < len(tree.leaves):
        limit = np.where(np.isfinite(bound), needed * np.maximum(base - 2 * bound, 0) * (1 + 1e-9) + 1e-12, np.inf)
        ask = (place >= begin_ring) & (place < end_ring) & (gap <= limit[:, None])
        for leaf in np.flatnonzero(ask.any(axis=0)):
            rows, at = np.flatnonzero(ask[:, leaf]), slice(begin[leaf], begin[leaf + 1])
            far = lengths_q[rows, None] + lengths_x[at] - 2 * (pq[rows] @ px[at].T) > limit[rows, None] * (1 + 1e-9)
            some = ~far.all(axis=1)
            if some.any():
                rows = rows[some]
                score[rows, at] = np.where(far[some], -np.inf, q[rows] @ x_[at].T)
                seen += len(rows) * (at.stop - at.start)
        begin_ring, end_ring = end_ring, 4 * end_ring
        if len(x) >= k:
            bound = np.maximum(bound, np.partition(score, len(x) - k, axis=1)[:, len(x) - k] if begin_ring < len(tree.leaves) or not np.isfinite(bound).all() else -np.inf)
    slack = 1e-9 * np.maximum(np.abs(np.where(np.isfinite(bound), bound, 0)), 1e-9)
    qi, xi = np.nonzero((score >= (bound - slack)[:, None]) & (score > -np.inf))
    exact = np.empty(len(qi))
    for lo in range(0, len(qi), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        exact[part] = products(x_[xi[part]], q[qi[part]])
    return qi, order[xi], exact, seen


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def _job(k: int, reach: float, sure: float):
    """For a group of candidates and queries the best k ids (by score, then id) of each query."""

    def run(f):
        import pandas as pd

        x, q = f[~f["query"]], f[f["query"]].reset_index(drop=True)
        cols = ["q1", "q2", "vec_id", "score"]
        if not len(x) or not len(q):
            return pd.DataFrame([], columns=cols)
        qi, xi, score, _ = search(_stack(x["embedding"]), _stack(q["embedding"]), q["bound"].fillna(-np.inf).to_numpy(float), k, reach, sure)
        ids = [np.asarray(v, np.int64) for v in x["ids"]]
        times = np.array([len(v) for v in ids])[xi]
        out = pd.DataFrame({"r": np.repeat(qi, times), "vec_id": np.concatenate([ids[i] for i in xi]) if len(xi) else np.empty(0, np.int64), "score": np.repeat(score, times)})
        out = out.sort_values(["r", "score", "vec_id"], ascending=[True, False, True])
        out = out[out.groupby("r").cumcount() < k]
        out["q1"], out["q2"] = q["c1"].to_numpy()[out["r"]], q["c2"].to_numpy()[out["r"]]
        return out[cols]

    return run


def _best(found: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _classes(df: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Distinct vectors (c1, c2: two hashes) with their k smallest ids, and whether a query is among all ids."""
    rows = df.select("vec_id", F.xxhash64(F.lit(1), "embedding").alias("c1"), F.xxhash64(F.lit(2), "embedding").alias("c2"))
    for salt in (F.pmod(F.xxhash64("vec_id"), F.lit(64)), F.lit(0)):  # a vector that a third of the rows share is first cut down in 64 places
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("c1", "c2", salt).orderBy("vec_id"))).where(F.col("n") <= k)
    ids = rows.groupBy("c1", "c2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    one = df.select("embedding", F.xxhash64(F.lit(1), "embedding").alias("c1"), F.xxhash64(F.lit(2), "embedding").alias("c2"), is_query.alias("asked"))
    one = one.groupBy("c1", "c2").agg(F.first("embedding").alias("embedding"), F.max(F.coalesce("asked", F.lit(False))).alias("asked"))
    return one.join(ids, ["c1", "c2"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sure: float = SURE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row that satisfies is_query (over vec_id) its k nearest others by inner product: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(F.col("vec_id").isNotNull() & usable())
    own = cut(df.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64(F.lit(1), "embedding").alias("q1"), F.xxhash64(F.lit(2), "embedding").alias("q2")).distinct(), "queries")
    most = k + 1  # a query's own id comes off at the end
    classes = cut(_classes(df, is_query, most), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, reach = classes.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0))).first()

    # First level: a tree for each length of vectors, from a sample by hash.
    few = classes.select("embedding").where(F.pmod(F.xxhash64("c1", F.lit(SEED)), F.lit(1 << 30)) < min(1.0, SAMPLE / max(n, 1)) * (1 << 30)).limit(2 * SAMPLE).toArrow()["embedding"].to_pylist()
    by_length: dict[int, list] = {}
    for v in few:
        by_length.setdefault(len(v), []).append(v)
    trees = {}
    for d, some in by_length.items():
        x = np.array(some, float)
        trees[d] = KdTree(projected(x, lifts(x, reach)), max(1, int(SHARD * len(few) / n)))
    dealt = cut(classes.mapInPandas(_dealer(trees, reach), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", d int, cell int, p array<double>"), "cells")
    sides = [f(F.get("p", F.lit(m))).alias(f"{n_}{m}") for n_, f in (("low", F.min), ("high", F.max)) for m in range(PROJECTED)]
    cells = dealt.groupBy("d", "cell").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("asked"), *sides).collect()  # one row per cell
    boxes = {}
    for d in {r["d"] for r in cells}:
        mine = [r for r in cells if r["d"] == d]
        boxes[d] = tuple(np.array(z) for z in ([r["cell"] for r in mine], *([[r[f"{s}{m}"] for m in range(PROJECTED)] for r in mine] for s in ("low", "high"))))
    about = lambda asked: spark.createDataFrame([(r["d"], r["cell"], max(1, -(-r["n"] // SHARD)), -(-a // QUERIES)) for r in cells if (a := asked.get((r["d"], r["cell"]), 0))], "d int, cell int, pieces int, blocks int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))

    def searched(asking: DataFrame, asked: dict) -> DataFrame:
        """asking: query classes with the cell to be searched and a bound."""
        plan = F.broadcast(about(asked))  # one row per cell
        nth = lambda m, salt: F.pmod(F.xxhash64("c1", "c2", F.lit(salt)), F.col(m)).cast("int")
        x = dealt.join(plan, ["d", "cell"]).select("d", "cell", nth("pieces", 3).alias("piece"), every("blocks").alias("block"), F.lit(False).alias("query"), "c1", "c2", "embedding", "ids", F.lit(None).cast("double").alias("bound"))
        q = asking.join(plan, ["d", "cell"]).select("d", "cell", every("pieces").alias("piece"), nth("blocks", 4).alias("block"), F.lit(True).alias("query"), "c1", "c2", "embedding", F.lit(None).cast("array<long>").alias("ids"), "bound")
        return x.union(q).groupBy("d", "cell", "piece", "block").applyInPandas(_job(most, reach, sure), "q1 long, q2 long, vec_id long, score double")

    queries = dealt.where("asked")
    at_home = cut(searched(queries.withColumn("bound", F.lit(None).cast("double")), {(r["d"], r["cell"]): r["asked"] for r in cells}), "home")
    bounds = _best(at_home, ["q1", "q2"], most).where(F.col("rank") == most).select(F.col("q1").alias("c1"), F.col("q2").alias("c2"), F.col("score").alias("bound"))
    known = queries.select("c1", "c2", "embedding", "d", "cell", "p").join(bounds, ["c1", "c2"], "left")
    away = cut(known.mapInPandas(_visits(boxes, reach, sure), "c1 long, c2 long, embedding " + classes.schema["embedding"].dataType.simpleString() + ", d int, cell int, bound double"), "visits")
    asked = {(r["d"], r["cell"]): r["count"] for r in away.groupBy("d", "cell").count().collect()}  # one row per cell
    found = _best(at_home.union(searched(away, asked)), ["q1", "q2"], most).drop("rank")
    mine = own.join(found, ["q1", "q2"]).where("vec_id <> query_id")
    return _best(mine, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _dealer(trees: dict[int, KdTree], reach: float):
    def run(frames):
        for f in frames:
            d = f["embedding"].map(len).to_numpy()
            cell, p = np.zeros(len(f), np.int64), [None] * len(f)
            for length in np.unique(d):
                at = np.flatnonzero(d == length)
                x = _stack(f["embedding"].iloc[at])
                points = projected(x, lifts(x, reach))
                if length in trees:
                    cell[at] = trees[length].leaf_of(points)
                for i, v in zip(at, points):
                    p[i] = v
            yield f.assign(d=d, cell=cell, p=p)

    return run


def _visits(boxes: dict, reach: float, sure: float):
    """The cells that a query has still to be searched in: all others whose box is within the limit of its bound."""
    needed = chi_square_quantile(PROJECTED, sure)

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for d, g in f.groupby("d"):
                names, low, high = boxes[d]
                x = _stack(g["embedding"])
                gap = gaps(projected(x, np.zeros(len(x))), low, high)
                bound = g["bound"].to_numpy(float)
                limit = np.where(np.isnan(bound), np.inf, needed * np.maximum(reach + (x * x).sum(axis=1) - 2 * bound, 0) * (1 + 1e-9) + 1e-12)
                r, c = np.nonzero((gap <= limit[:, None]) & (names[None, :] != g["cell"].to_numpy()[:, None]))
                out.append(g[["c1", "c2", "embedding", "d", "bound"]].iloc[r].assign(cell=names[c]))
            if out:
                yield pd.concat(out)[["c1", "c2", "embedding", "d", "cell", "bound"]]

    return run
