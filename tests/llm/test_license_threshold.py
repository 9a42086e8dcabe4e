"""License matches at the threshold itself are not lost to the prefilter."""

from cellwright.llm import license_scan


def test_a_text_that_misses_just_the_trigger_word(spark):
    rows = [(1, "Licensed under the MIT License"), (2, "it is released; under the MIT License"), (3, "Licensed under the MIT terms")]
    got = license_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got if r.doc_id != 2] == [(1, "mit", 0.8)]


def test_no_set_of_missing_words_escapes_the_triggers():
    for n in range(5, 41):
        for least in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
            t = license_scan.Template("x", " ".join(f"word{i}" for i in range(n)), least)
            most_missing = max(m for m in range(n + 1) if (n - m) / n >= least)
            assert len(t.triggers) == most_missing + 1
