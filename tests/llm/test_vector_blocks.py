"""Link counts over several blocks of one component, against all pairs."""

import numpy as np

from cellwright.llm import vector_dedup


def test_near_far_and_middling_blocks(spark):
    rng = np.random.default_rng(21)
    base = rng.standard_normal(24)
    rows = [base + s * rng.standard_normal(24) for s in np.repeat([0.02, 0.1, 0.2, 0.3], 60)]
    chain = [base + i * 0.1 * rng.standard_normal(24) for i in range(20)]
    x = np.array([*rows, *chain, *rows[:30], *rng.standard_normal((40, 24))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min(root[i], *root[link[i]]) if link[i].any() else root[i] for i in range(len(x))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, block=32, window=16).collect()}
    assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()


def test_no_pair_of_a_tight_group_is_compared():
    import pandas as pd

    f = pd.DataFrame({"root": ["r"] * 5, "own": range(5), "low": [0.0, 0.05, 0.1, 0.3, 0.9], "high": [0.05, 0.1, 0.12, 0.6, 1.0], "rows": [10] * 5})
    got = vector_dedup._ranges(0.9)(f)
    assert got["whole"].tolist() == [30, 30, 30, 0, 0] and got["itself"].tolist() == [True] * 3 + [False] * 2
    assert list(zip(got["first"], got["last"])) == [(3, 3), (3, 3), (3, 3), (0, 4), (3, 4)]
