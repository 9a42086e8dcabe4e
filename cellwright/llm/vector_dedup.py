"""Embedding near-dedup by sorted projection passes.

Each pass hashes vectors by the signs of random projections, concatenated to one key, sorts all vectors by their keys
and compares each with its neighbours in a bounded window; links found in any pass are united. A vector linked by a
pass to a chain of others needs no direct comparison to join their component.

Equal vectors are one class from the start. Windows verify cosines in double precision and give out only links that
connect what their block hadn't yet connected. Link counts are then exact within components. Their classes stand in blocks by the
angle to one of them; blocks so near to it that all of their vectors must be linked are counted as a whole, blocks whose
angles differ too much are passed over, and the others are compared, which adds up counts and gives out no pairs.

With sign keys a pair of angle a agrees on b leading bits with probability (1 - a / pi)^b; windows of WINDOW among n
vectors need b = log2(n / WINDOW). From that the number of passes follows such that a pair at `least` is compared
directly with probability RECALL, whatever n is: at cosine 0.9 and n = 10^5, 10^6, 10^7 these are 33, 57 and 97 passes,
and 16 at least. That takes keys as evenly spread; where they crowd, a pair whose links nothing else makes is found less often.

Defined cases. Vectors that are null, empty, zero, or hold null or non-finite components: no links, a component of their
own. Vectors of different lengths: never linked. Null vec_id: takes part; never the smallest id unless all of the component are
null. Repeated rows: linked with each other. Empty table: empty result. Other columns, labels among them, are ignored."""

from __future__ import annotations

from math import acos, ceil, log, log1p, log2, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, cut, numbered

LEAST_PASSES, WINDOW, BLOCK, BITS, SEED = 16, 64, 1024, 62, 29
RECALL = 0.999


def passes_for(n: int, least: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair of cosine `least` among n vectors was in a window together with probability `recall`."""
    agree = 1 - acos(max(-1.0, min(1.0, least))) / pi
    found = agree ** max(0.0, log2(max(n, 1) / window))
    if found >= 1:
        return LEAST_PASSES
    if found <= 0 or recall >= 1:
        raise ValueError(f"no number of passes finds pairs of cosine {least} with probability {recall}")
    return max(LEAST_PASSES, ceil(log(1 - recall) / log1p(-found)))


def usable(v: str = "embedding"):
    """The vector has a length, and all of its components are finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _keys(passes: int, bits: int):
    def run(frames):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for f in frames:
            out = []
            for v in f["embedding"]:
                d = len(v)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((passes * bits, d))
                signs = (planes[d] @ np.asarray(v, float) > 0).reshape(passes, bits)
                out.append(signs @ weights)
            yield f[["cls"]].assign(keys=out)

    return run


def _matrix(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _window_job(window: int, least: float):
    def run(f):
        import pandas as pd

        f = f.sort_values("rank", kind="stable")
        names, out = f["cls"].tolist(), []
        parent = list(range(len(f)))

        def head(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        length = f["embedding"].map(len).to_numpy()
        if len(f) > 1:
            for d in np.unique(length):
                pick = np.flatnonzero(length == d)
                x = _matrix(f["embedding"].iloc[pick])
                for step in range(1, min(window, len(f) - 1) + 1):
                    a = pick[:-step] if step < len(pick) else pick[:0]
                    b = pick[step:]
                    near = np.flatnonzero((b - a <= window) & ((x[:-step] * x[step:]).sum(axis=1) >= least)) if len(a) else []
                    for i in near:
                        p, q = int(a[i]), int(b[i])
                        hp, hq = head(p), head(q)
                        if hp != hq:
                            parent[hp] = hq
                            out.append((names[p], names[q]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _count_job(least: float):
    def run(f):
        import pandas as pd

        out = []
        for _, g in f.groupby(["root", "i", "j"], sort=False):
            own, i, j = g["own"].to_numpy(), g["i"].iloc[0], g["j"].iloc[0]
            x, n, cls = _matrix(g["embedding"]), g["rows"].to_numpy(), g["cls"].to_numpy()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            near = x[left] @ x[right].T >= least
            if i == j:
                np.fill_diagonal(near, False)
            else:
                out += zip(cls[right], near.T @ n[left])
            out += zip(cls[left], near @ n[right])
        return pd.DataFrame(out, columns=["cls", "links"])

    return run


def _cosine(a: str, b: str):
    """Cosine of two array columns of one length, in double precision; scaled first, so that squares neither overflow nor vanish."""
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.array_max(F.transform(v, lambda y: F.abs(y.cast("double")))))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    x = F.array(F.struct(unit(F.col(a)).alias("a"), unit(F.col(b)).alias("b")))
    said = F.transform(x, lambda v: add(F.zip_with(v["a"], v["b"], lambda p, q: p * q)) / F.sqrt(add(F.transform(v["a"], lambda p: p * p)) * add(F.transform(v["b"], lambda q: q * q))))
    return F.get(said, F.lit(0))


def _ranges(least: float):
    """For the blocks of a component, in the order of angles to the pivot: the rows of the blocks that are linked with this one as a whole
    (two angles to the pivot add up to no more than the threshold's), whether it is one of them, and the blocks that must be compared
    with it (the angles differ by no more than the threshold's). In whole numbers, so that both blocks of a pair say the same."""
    unit = 1e9
    limit = acos(max(-1.0, min(1.0, least))) * unit

    def run(f):
        import pandas as pd

        f = f.sort_values("own")
        low, high = np.floor(f["low"].to_numpy() * unit).astype(np.int64) - 1000, np.ceil(f["high"].to_numpy() * unit).astype(np.int64) + 1000
        own = np.arange(len(f))
        whole = np.searchsorted(high, int(limit) - 2000 - high, side="right")  # so many blocks from the first
        rows = np.r_[0, np.cumsum(f["rows"].to_numpy())]
        first = np.maximum(whole, np.searchsorted(high, low - int(limit) - 2000, side="left"))
        last = np.searchsorted(low, high + int(limit) + 2000, side="right") - 1
        return pd.DataFrame({"root": f["root"].to_numpy(), "own": own, "whole": rows[whole], "itself": own < whole, "first": first, "last": last})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, passes: int | None = None, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links (other rows with cosine >= least, found), component_id (least vec_id reachable), kept.

    passes: by default as many as RECALL takes for the number of distinct vectors."""
    df = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda x: x + F.lit(0).cast("float")).alias("embedding"))
    kind = df.schema["vec_id"].dataType.simpleString()
    df = df.withColumn("cls", F.when(usable(), F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256)))
    rows = cut(df.select("vec_id", "cls"), "vector-rows")
    classes = cut(df.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("rows"), F.first("embedding").alias("embedding")), "classes")

    n_classes = classes.count()
    passes = passes_for(n_classes, least, window) if passes is None else passes

    # Sort each pass: ranks go through all passes.
    keys = classes.mapInPandas(_keys(passes, BITS), "cls string, keys array<long>").select(F.posexplode("keys").alias("pass", "key"), "cls")
    ranked = numbered(keys, "pass", "key", "cls").select("cls", "pass", "rank")
    # A block also gets the first `window` rows of the next one.
    own = F.floor(F.col("rank") / block)
    halo = (F.col("rank") % block < window) & (own > 0)
    dealt = ranked.select("cls", "pass", "rank", F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))).alias("block"))
    links = dealt.join(classes.select("cls", "embedding"), "cls").groupBy("block").applyInPandas(_window_job(window, least), "a string, b string")
    found = components(links)

    # Exact link counts within components: their classes stand in blocks, in the order of their angles to one of them (the pivot).
    inside = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rows", "embedding", F.coalesce("root", "cls").alias("root"))
    spread = cut(inside.groupBy("root").agg(F.count("*").alias("n"), F.min("cls").alias("pivot")).where("n > 1"), "components")
    pivots = spread.select("root", "n", F.col("pivot").alias("cls")).join(classes.select("cls", F.col("embedding").alias("pivot")), "cls").drop("cls")
    angles = inside.join(pivots, "root").select("root", "cls", "rows", "n", F.acos(F.least(F.greatest(_cosine("embedding", "pivot"), F.lit(-1.0)), F.lit(1.0))).alias("angle"))
    angles = numbered(angles, "root", "angle", "cls")
    begins = angles.groupBy("root").agg(F.min("rank").alias("begin"))
    angles = angles.join(begins, "root").withColumn("own", F.floor((F.col("rank") - F.col("begin")) / block).cast("int"))
    blocks = angles.groupBy("root", "own").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("rows").alias("rows"))
    ranges = blocks.groupBy("root").applyInPandas(_ranges(least), "root string, own int, whole long, itself boolean, first int, last int")
    part = cut(angles.join(ranges, ["root", "own"]).select("root", "cls", "rows", "n", "own", (F.col("whole") - F.when(F.col("itself"), F.col("rows")).otherwise(0)).alias("whole"), "first", "last"), "angles")
    certain = part.select("cls", F.col("whole").alias("links"))
    part = part.where("first <= last").withColumn("other", F.explode(F.sequence("first", "last"))).join(classes.select("cls", "embedding"), "cls")
    part = part.select("cls", "rows", "embedding", "root", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # Small components share groups; a block pair of a large one is a group.
    most = max(1, n_classes // block)
    group = F.when(F.col("n") > block // 4, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(most)))
    compared = part.withColumn("group", group).drop("n").groupBy("group").applyInPandas(_count_job(least), "cls string, links long")
    counts = certain.union(compared).groupBy("cls").agg(F.sum("links").alias("links"))

    least_id = inside.join(classes.select("cls", "vec_id"), "cls").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = inside.select("cls", "rows", "root").join(least_id, "root").join(counts, "cls", "left").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = rows.join(named, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast(kind).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
