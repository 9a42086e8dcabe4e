"""Rows by their places, over several files, blocks and buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.llm import places


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 19), (1 << 4, 1 << 3)])
def test_choosing_and_tagging(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(places, "BLOCK", sizes[0])
    monkeypatch.setattr(places, "BUCKET", sizes[1])
    df = spark.range(500).withColumn("text", F.concat(F.lit("t"), "id")).withColumn("Row", F.col("id") % 7)
    df.repartition(3).write.parquet(str(tmp_path / "x"))
    docs = places.at_rest(spark.read.parquet(str(tmp_path / "x")))
    assert docs.select(*places.place(docs)).distinct().count() == 500
    some = docs.select("id", *places.place(docs)).where("id % 3 = 0")
    again = places.without(docs, some.union(some))
    assert again.columns == docs.columns and sorted(r.id for r in again.collect()) == [i for i in range(500) if i % 3]
    tags = some.select("file", "row", (F.col("id") * 10).alias("ten"), F.lit(1).cast("long").alias("one"))
    assert sorted((r.id, r.text, r.ten, r.one) for r in places.tagged(docs, tags, ("ten", "one")).collect()) == [(i, f"t{i}", 10 * i, 1) for i in range(0, 500, 3)]
    assert places.without(docs, some.limit(0)).count() == 500 and places.tagged(docs, tags.limit(0), ("ten", "one")).count() == 0


def test_what_is_no_plain_read_is_written_first(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "Id long, id_ string")
    rest = places.at_rest(df.union(df))
    assert rest.columns == df.columns and rest.select(*places.place(rest)).distinct().count() == 6
    both = spark.createDataFrame(np.array([[1, 2]]).tolist(), "a long, A long")
    assert places.at_rest(both).columns == ["a", "A"]
