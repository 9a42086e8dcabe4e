"""What near_duplicates hands to a worker at once, outside the pipeline too."""

from cellwright.llm import text_dedup


def test_rows_are_handed_over_in_small_batches(spark, monkeypatch, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, sketcher = spark.conf.get(key, None), text_dedup._sketcher
    most = 5_000_000

    def watched(k):
        job = sketcher(k)

        def small(batches):
            for b in batches:
                if b.nbytes > most:
                    raise ValueError(f"{b.nbytes} bytes at once")
                yield b

        return lambda batches: job(small(batches))

    monkeypatch.setattr(text_dedup, "_sketcher", watched)
    spark.conf.unset(key)
    try:
        spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 400) as text").write.parquet(str(tmp_path / "d"))
        out = text_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).where("kept").collect()
        assert [r.doc_id for r in out] == [0]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
