"""What several operators of this subpackage share: cut points, connected components, hashing of words."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, file_system, forget, new_folder, plain_read, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows handed to a worker at once (about), where the session names no bound. By Spark's default it is 10,000 rows or 64 MB, which
#: stand in the executor and in the worker at the same time, for each task.
HANDED, _BOUND = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, HANDED)


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with the rows' numbers from 0 in an order: the place in a range partition plus the sizes of those before, one row per partition."""
    inner = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    inner = cut(inner, "ranks").withColumn("__part", F.shiftright("__id", 33))
    sizes = inner.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__ahead"))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return inner.join(F.broadcast(ahead), F.col("__part") == F.col("__p")).withColumn(name, F.col("__ahead") + place).drop("__id", "__part", "__p", "__ahead")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b) as (node, root), root being the least node; isolated nodes don't appear.

    Alternating large-star and small-star steps, each an aggregation and an equi-join, so a hub of any degree is
    split by the skew join. Ends when a round changes nothing; raises if that takes more than `rounds`."""
    kind = edges.schema["a"].dataType
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    stamp = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
    before = stamp(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k"))
        now = cut(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges", (now,))
        after = stamp(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root")).distinct()


def lean(job):
    """job, an iterator of Arrow batches to another, in a worker that gives freed memory back: Arrow's default pool and malloc keep it otherwise,
    and a worker lives on through all stages."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) or (lambda _: 0)

        def read():
            for batch in batches:
                yield batch
                del batch
                trim(0)

        yield from job(read())
        trim(0)

    return run


class WordHashes(dict):
    """64-bit hashes of words by look-up; the table is emptied when it is full, which costs time and changes nothing."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit integers (murmur's, public domain): every bit depends on every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8, A-Z lower-cased: exactly what bytes.lower and bytes.split do. Null: none."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()
