"""Long texts take time in proportion, and redaction agrees with the spans."""

import time

from pyspark.sql import functions as F

from cellwright.llm import pii


def seconds(spark, text, job):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    df.count()
    best = 1e9
    for _ in range(2):
        began = time.time()
        job(df).write.format("noop").mode("overwrite").save()
        best = min(best, time.time() - began)
    return best


def test_four_times_the_text_takes_about_four_times_the_time(spark):
    one = "write to ann.b{0}@mail{0}.org or call +1 202 555 01{1:02d} about 4111 1111 1111 1111, iban DE89 3704 0044 0532 0130 00. "
    texts = ["".join(one.format(i, i % 100) for i in range(n)) for n in (100, 5_000, 20_000)]
    for job in (pii.find, pii.redact):
        seconds(spark, texts[0], job)
        small, large = (seconds(spark, t, job) for t in texts[1:])
        assert large < 8 * small + 1, (job, small, large)


def test_redaction_and_spans(spark):
    texts = ["a@b.co 1.2.3.4", "x +44 20 7946 0958 y", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", "ssn 123-45-6789, 123-45-6789", "é😀 a@b.co,c@d.eu"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for r in pii.find(df).collect():
        text, at = "", 0
        for x in r.spans:
            text, at = text + r.text[at : x.start] + f"[{x.kind.upper()}]", x.end
        assert clean[r.doc_id] == text + r.text[at:]
    assert clean[2] == "[IBAN] and [IBAN]" and pii.redact(df.select(F.lit(None).cast("string").alias("text"))).first().text is None
