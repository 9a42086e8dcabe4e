"""What rewrite puts into files: all columns, whatever their names, whole shards, slots in order."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cellwright.llm import queries, resharding


def test_columns_and_rows_survive(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 9 else None, "x" * int(rng.integers(0, 300)) if i % 7 else None, f"keep{i}", int(i), f"s{i % 3}") for i in rng.integers(0, 60, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long, To_Shard string")
    path, affected = resharding.rewrite(df, shards=5)
    assert affected == list(range(5))
    back = spark.read.parquet(path)
    assert set(back.columns) == {*df.columns, "to_shard_", "to_slot"}
    assert Counter(tuple(r) for r in back.select(*df.columns).collect()) == Counter(rows)
    plan = Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in resharding.reshard(df, 5).collect())
    got = Counter((r.doc_id, len(r.text or "") + 8, zlib.crc32((r.text or "").encode()), r.to_shard_) for r in back.collect())
    assert got == plan
    for n in affected:
        assert sorted(r.to_slot for r in back.where(F.col("to_shard_") == n).collect()) == list(range(back.where(F.col("to_shard_") == n).count()))


def test_shards_that_keep_their_rows_are_left_alone(spark):
    df = spark.createDataFrame([(i, "x" * 12) for i in range(40)], "doc_id long, text string")
    path, affected = resharding.rewrite(df, shards=4, old=F.col("doc_id") % 4)
    assert affected == [] and resharding.rewrite(df.limit(0), shards=4)[1] == []


def test_query_against_its_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    rows = queries.op10_resharding(spark, sf).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    most = max(r["size"] for r in rows)
    mean = sum(loads.values()) / resharding.SHARDS
    assert all(abs(loads[n] - mean) <= most for n in range(resharding.SHARDS))
    for n in range(resharding.SHARDS):
        assert sorted(r.slot for r in rows if r.shard == n) == list(range(sum(r.shard == n for r in rows)))
