"""Training against plain numpy steps, with the default settings, batches, and a bound on the cells."""

import numpy as np

from cellwright.config import Config
from cellwright.operators import model


def plain(cells, w, config):
    """cells: (matrix of candidates by features, truth) in order."""
    velocity, size = np.zeros(len(w)), min(config.batch_size, len(cells))
    for _ in range(config.learning_iterations):
        for b in range(len(cells) // size):
            grad = np.zeros(len(w))
            for x, y in cells[b * size : (b + 1) * size]:
                p = np.exp(x @ w - (x @ w).max())
                grad += x.T @ (p / p.sum() - y)
            velocity = config.momentum * velocity + grad / size + config.weight_decay * w
            w = w - config.learning_rate * velocity
    return w


def test_steps_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    names = ["f1", "f2", "f3"]
    domain = [(i, a, v, int(v == "x")) for i in range(150) for a in "ab" for v in "wxyz"]
    feats = [(i, a, v, f, float(rng.random() * 0.5 + (v == "x") * (f == "f1") * 0.5)) for i, a, v, _ in domain if (i, v) != (7, "w") for f in names if rng.random() < 0.8]
    known = {(i, a, v, f): x for i, a, v, f, x in feats}
    cells = {(i, a): (np.array([[known.get((i, a, v, f), 0.0) for f in names] for v in "wxyz"]), np.array([0.0, 1, 0, 0])) for i in range(150) for a in "ab"}
    df = spark.createDataFrame(domain, "ind long, attr string, val string, observed int").repartition(5)
    feats = spark.createDataFrame(feats, "ind long, attr string, val string, feature string, value double").repartition(5)
    for config in (Config(), Config(batch_size=7, momentum=0.5), Config(training_cells=40, batch_size=3)):
        some = sorted((r.ind, r.attr) for r in model.drawn(df, config).collect())
        assert len(some) == min(300, config.training_cells)
        got = model.train(df, feats, names, config)
        start = model.initial_weights(names, config.seed)
        assert np.allclose(got, plain([cells[c] for c in some], start, config), rtol=0, atol=1e-9)
        assert np.abs(got - start).max() > 0.01
    start = np.array([0.3, -0.2, 0.1])
    assert np.allclose(model.train(df, feats, names, Config(learning_iterations=2), start), plain([cells[c] for c in sorted(cells)], start, Config(learning_iterations=2)), rtol=0, atol=1e-9)
