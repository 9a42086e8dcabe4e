"""What the pipeline hands to a worker at once, and what a worker holds after near duplicates."""

import pyarrow as pa

import corpus_pipeline
from cellwright.llm import text_dedup


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})


def test_stages_hand_rows_over_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 1000) as text")
        packed = corpus_pipeline.packed(spark, docs, "")
        assert max(r[0] for r in docs.mapInArrow(_sizes, "size long").collect()) < 5e6
        assert packed.agg({"length": "sum"}).first()[0] == 3000 * packed.first()["doc_tokens"]
        spark.conf.set(key, "9m")  # what the session names stays
        corpus_pipeline.packed(spark, docs, "")
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_worker_remembers_no_hashes_after_a_task():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "file": [0], "row": [0], "text": ["some words, some more words"]})
    for job in (text_dedup._sketcher(4), text_dedup._setter(4)):
        assert sum(b.num_rows for b in job(iter([batch]))) == 1
        assert not text_dedup._hashes
