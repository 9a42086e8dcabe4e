"""near_duplicates of the pipeline with null and shared ids."""

from collections import Counter

import numpy as np

import corpus_pipeline


def prose(seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, 60))


def test_one_row_of_each_group_stays(spark):
    a, b, c, d, e = (prose(i) for i in range(5))
    rows = [
        (1, a), (None, a), (None, a + " end"),  # a group with an id
        (None, b), (None, b), (None, b),  # exact copies without any id
        (None, ""), (None, None),  # groups of their own
        (2, c), (5, c + " end"), (5, d), (5, d),  # 5 is shared by a near copy of 2 and a text of its own
        (None, e),
        (8, None), (8, None), (9, ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    out = corpus_pipeline.without_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, a), (None, b), (None, ""), (None, None), (2, c), (5, d), (None, e), (8, None), (9, "")])
