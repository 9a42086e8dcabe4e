"""A softmax over each cell's candidates with one weight per feature (a conditional logit): training and inference.

Features are long rows (ind, attr, val, feature, value); weights a small frame (feature, weight), one row per feature."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EVERY, Config
from ..sources.scratch import cut, file_system, forget
from ..sources.tables import whole
from .features import KEY

#: Cells that training holds at a time.
CELLS = 1024


def initial_weights(names: list[str], seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(len(names))


def weights_frame(spark: SparkSession, names: list[str], weights) -> DataFrame:
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, weight double")


def probabilities(domain: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(ind, attr, val, observed, probability). A candidate without features scores 0. The weights, one row per feature, are broadcast."""
    scores = features.join(F.broadcast(weights), "feature").groupBy(*KEY).agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    cell = Window.partitionBy("ind", "attr")
    out = whole(domain).join(scores, KEY, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = out.withColumn("e", F.exp(F.col("score") - F.max("score").over(cell)))
    return out.select(*KEY, "observed", (F.col("e") / F.sum("e").over(cell)).alias("probability"))


def top(inferred: DataFrame, k: int = 1) -> DataFrame:
    """The k likeliest candidates of each cell, ties to the smaller value; those of probability 0 are dropped."""
    order = Window.partitionBy("ind", "attr").orderBy(F.desc("probability"), "val")
    return inferred.where("probability > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def drawn(cells: DataFrame, config: Config = Config()) -> DataFrame:
    """The cells (ind, attr) to learn from: all, unless config.training_cells names fewer, then those with the least seeded hashes."""
    cells = cells.select("ind", "attr").distinct()
    if config.training_cells == EVERY:
        return cells
    return cells.orderBy(F.xxhash64(F.lit(config.seed), "ind", "attr"), "ind", "attr").limit(config.training_cells)


def train(domain: DataFrame, features: DataFrame, names: list[str], config: Config = Config(), start: np.ndarray | None = None) -> np.ndarray:
    """Weights, by one rule at every size: sequential mini-batches in the order of cells, SGD on the mean cross-entropy with momentum and
    weight decay; a last batch that isn't full is dropped.

    Each step needs the one before, so the steps run in one task. It reads the cells, which stand in the shared folder in their order, once for
    each iteration and holds CELLS of them at a time. start: weights to begin with, by default seeded random ones."""
    start = initial_weights(names, config.seed) if start is None else np.asarray(start, float)
    if not names:
        return start
    rows = domain.select(*KEY, "observed")
    if config.training_cells != EVERY:
        rows = whole(rows).join(drawn(domain, config), ["ind", "attr"], "left_semi")
    code = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("feature"))
    feature = F.when(code.isNotNull(), F.struct(code.alias("code"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))
    candidates = whole(rows).join(features, KEY, "left").groupBy(*KEY).agg(F.max("observed").cast("int").alias("observed"), F.array_sort(F.collect_list(feature)).alias("features"))
    cells = candidates.groupBy("ind", "attr").agg(F.array_sort(F.collect_list(F.struct("val", "observed", "features"))).alias("c"))
    cells = cells.select("ind", "attr", F.col("c.observed").alias("observed"), F.transform("c.features", F.size).alias("sizes"), F.flatten("c.features").alias("f"))
    laid = cells.repartitionByRange("ind", "attr").sortWithinPartitions("ind", "attr").select("observed", "sizes", F.col("f.code").alias("code"), F.col("f.value").alias("value"))
    laid = cut(laid, "cells")
    path = laid.cut_path

    def run(_):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(learnt(*stored(path), start, config))], ["feature", "weight"])

    found = {r[0]: r[1] for r in domain.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "feature string, weight double").collect()}
    forget(laid)
    return np.array([found[n] for n in names])


def stored(path: str) -> tuple[int, Callable[[], Iterator]]:
    """How many cells stand in a folder that Spark wrote, and a function that reads them, CELLS at a time, in the order of its partitions."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, root = file_system(path)
    files = [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")]
    files = [f.path for f in sorted(files, key=lambda f: (int(f.base_name.split("-")[1]), f.base_name))]

    def opened() -> Iterator:
        for f in files:
            with system.open_input_file(f) as at:
                yield pq.ParquetFile(at, buffer_size=1 << 20)

    return sum(f.metadata.num_rows for f in opened()), lambda: (b for f in opened() for b in f.iter_batches(CELLS, use_threads=False))


def learnt(n: int, read: Callable[[], Iterator], start: np.ndarray, config: Config) -> np.ndarray:
    """The steps of `train` over n cells. read: gives them from the first on, as Arrow batches of lists: observed and sizes (number of
    features) of each candidate, code and value of each feature."""
    w, velocity, width = start.copy(), np.zeros(len(start)), len(start)
    if not n:
        return w
    size = min(config.batch_size, n)
    for _ in range(config.learning_iterations):
        grad, open_, left = np.zeros(width), size, n // size * size  # cells that the step and the iteration still want
        for batch in read():
            of, begin, code, value, cand, y = _flat(batch)
            c, end = 0, min(len(of) - 1, left)
            while c < end:
                d = min(end, c + open_)
                at, first, last = slice(begin[c], begin[d]), of[c], of[d]
                f, v, k = code[at], value[at], cand[at] - first
                heads, each = of[c:d] - first, np.diff(of[c : d + 1])
                z = np.bincount(k, v * w[f], last - first)
                p = np.exp(z - np.repeat(np.maximum.reduceat(z, heads), each))
                p /= np.repeat(np.add.reduceat(p, heads), each)
                grad += np.bincount(f, v * (p - y[first:last])[k], width)
                open_, left, c = open_ - (d - c), left - (d - c), d
                if not open_:
                    velocity = config.momentum * velocity + grad / size + config.weight_decay * w
                    w = w - config.learning_rate * velocity
                    grad, open_ = np.zeros(width), size
            if not left:
                break
    return w


def _flat(batch) -> tuple[np.ndarray, ...]:
    """Of a batch of cells: the first candidate and the first feature of each cell and of the end; code, value and candidate of each
    feature; what is observed of each candidate (shares of one a cell)."""
    import pyarrow.compute as pc

    ends = lambda c: np.r_[0, np.cumsum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False))].astype(np.int64)
    numbers = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
    of, begin = ends("sizes"), ends("code")
    cand = np.repeat(np.arange(of[-1]), numbers("sizes"))
    y = (numbers("observed") == 1).astype(float)
    y /= np.repeat(np.maximum(np.add.reduceat(y, of[:-1]), 1), np.diff(of))
    return of, begin, numbers("code"), numbers("value"), cand, y
