"""Training takes all cells, however many, and holds few of them at a time."""

import numpy as np
import pyarrow as pa

from cellwright.config import Config
from cellwright.operators import model

from .test_training_sizes import plain


def test_more_than_a_hundred_thousand_cells_all_teach(spark):
    n = 100_500
    domain = spark.range(n).selectExpr("id as ind", "'a' as attr", "explode(array('x', 'y')) as val").selectExpr("*", "int(val = 'x') as observed")
    feats = domain.where("val = 'x'").selectExpr("ind", "attr", "val", "'f' as feature", "double(ind % 3) as value")
    assert model.drawn(domain).count() == n
    config = Config(batch_size=500, learning_iterations=1, learning_rate=0.1, weight_decay=0.0)
    w = 0.0
    for c in range(0, n, 500):
        v = np.arange(c, c + 500) % 3
        w += 0.1 * np.mean(v / (1 + np.exp(v * w)))
    assert np.allclose(model.train(domain, feats, ["f"], config, [0.0]), [w], rtol=0, atol=1e-9)


def test_batches_go_over_what_is_held_at_a_time():
    rng = np.random.default_rng(5)
    cells = [(rng.random((int(k), 3)), np.eye(int(k))[0]) for k in rng.integers(1, 5, 41)]

    def read(held):
        for lo in range(0, len(cells), held):
            some = cells[lo : lo + held]
            yield pa.RecordBatch.from_pydict({"observed": [y.astype(int).tolist() for _, y in some], "sizes": [[3] * len(x) for x, _ in some], "code": [[0, 1, 2] * len(x) for x, _ in some], "value": [x.ravel().tolist() for x, _ in some]})

    start = np.array([0.2, -0.1, 0.3])
    for batch in (1, 4, 7, 40, 41, 1000):
        config = Config(batch_size=batch, learning_iterations=3, learning_rate=0.1, momentum=0.4)
        for held in (1, 3, 10, 41):
            assert np.allclose(model.learnt(41, lambda: read(held), start, config), plain(cells, start, config), rtol=0, atol=1e-9)
