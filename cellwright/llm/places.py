"""Rows by their places in Parquet files, so that a decision on a row goes to where the row is read.

A row's place is its file (a hash of the path) and its number there. Decisions are small: they are dealt to buckets by file and
block of BLOCK rows, about BUCKET decisions each, and the tasks that read a table look up those of their own rows. So choosing or
dropping rows moves no text, broadcasts nothing and needs memory for one bucket's decisions.

Tables that aren't plain reads of Parquet are written to the shared folder first. Empty table: empty result. Rows are
told apart by nothing but their places: ids may be null or shared, and columns may have any names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, file_system, forget, lean, new_folder, plain_read

BLOCK, BUCKET, LEAST_BUCKETS = 1 << 16, 1 << 19, 4


def at_rest(docs: DataFrame) -> DataFrame:
    """docs itself if each of its rows is a row of a Parquet file, else docs written and read again."""
    if plain_read(docs) == "parquet":
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]  # Parquet takes no names that differ in case alone
    return cut(docs.toDF(*names), "rows").toDF(*docs.columns)


def place(docs: DataFrame) -> tuple[Column, Column]:
    """The columns file and row of a table at rest."""
    found = docs.metadataColumn("_metadata")
    return F.xxhash64(found["file_path"]).alias("file"), found["row_index"].cast("long").alias("row")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.pmod(F.col("file"), F.lit(buckets)) + F.col("block"), F.lit(buckets))


def marked(places: DataFrame) -> tuple[str, int, int]:
    """Write places (file, row) and any further long columns for the tasks that read the rows; return their folder, the number of buckets and the rows of a block."""
    places = cut(places.withColumn("block", F.shiftright("row", BLOCK.bit_length() - 1)), "marks")
    path, buckets = new_folder(places.sparkSession, "places"), max(LEAST_BUCKETS, -(-places.count() // BUCKET))
    dealt = places.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "file", "row")
    dealt.write.partitionBy("bucket").parquet(path)
    forget(places)
    return path, buckets, BLOCK


class Marks:
    """Reads what `marked` wrote, a bucket at a time."""

    def __init__(self, marks: tuple[str, int, int], further: tuple[str, ...] = ()):
        self.system, self.root = file_system(marks[0])
        self.buckets, self.size, self.names = marks[1], marks[2], ["file", "row", *further]
        self.held, self.table = -1, [np.empty(0, np.int64) for _ in self.names]

    def block(self, file: int, block: int) -> list[np.ndarray]:
        """The rows marked there, in order, and their further columns."""
        from pyarrow import fs
        from pyarrow import parquet as pq

        bucket = (file % self.buckets + block) % self.buckets
        if self.held != bucket:
            found = self.system.get_file_info(fs.FileSelector(f"{self.root}/bucket={bucket}", allow_not_found=True))
            parts = [pq.read_table(f.path, columns=self.names, filesystem=self.system, partitioning=None) for f in found if f.path.endswith(".parquet")]
            self.held, self.table = bucket, [np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.empty(0, np.int64) for c in self.names]
        files, rows, *values = self.table
        at = np.flatnonzero((files == file) & (rows // self.size == block))
        at = at[np.unique(rows[at], return_index=True)[1]]
        return [rows[at], *(v[at] for v in values)]

    def look_up(self, files: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which places are marked, and the further columns there (0 elsewhere)."""
        hit, further = np.zeros(len(rows), bool), [np.zeros(len(rows), np.int64) for _ in self.names[2:]]
        blocks = rows // self.size
        edges = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])]) if len(rows) else []
        for lo, hi in zip(edges, [*edges[1:], len(rows)]):
            known, *values = self.block(int(files[lo]), int(blocks[lo]))
            if len(known):
                at = np.minimum(np.searchsorted(known, rows[lo:hi]), len(known) - 1)
                hit[lo:hi] = same = known[at] == rows[lo:hi]
                for out, v in zip(further, values):
                    out[lo:hi] = np.where(same, v[at], 0)
        return hit, further


def chosen(docs: DataFrame, marks: tuple[str, int, int], columns: list[Column], job: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None, schema, wanted: bool = True, further: tuple[str, ...] = ()) -> DataFrame:
    """The given columns of the rows of docs (at rest) that are marked, or those that aren't, passed through job; behind them the further columns marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Marks(marks, further)

        def left() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit, values = known.look_up(batch.column(1).to_numpy(), batch.column(2).to_numpy())
                hit = hit == wanted
                if hit.any():
                    rows = batch.column(0) if hit.all() else batch.column(0).filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([*rows.flatten(), *(pa.array(v[hit]) for v in values)], names=[*(f.name for f in rows.type), *further])

        return job(left()) if job else left()

    return docs.select(F.struct(*columns).alias("value"), *place(docs)).mapInArrow(lean(run), schema)


def without(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs (at rest) without the rows at the given places (file, row); all columns, in their order."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return chosen(docs, marked(places.select("file", "row")), columns, None, docs.schema, wanted=False)


def tagged(docs: DataFrame, places: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The rows of docs (at rest) that have places (file, row, and long columns of the given names), with those columns behind their own."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return chosen(docs, marked(places.select("file", "row", *names)), columns, None, schema, further=names)
