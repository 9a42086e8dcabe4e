"""A session's statistics and training cells: what joins may broadcast of them, and when cells are drawn at all."""

from cellwright import queries as Q
from cellwright.operators import detect
from cellwright.sources import tables

from .test_broadcasts import SF, broadcast_scans, plans  # noqa: F401


def test_given_weights_draw_no_training_cells(spark):
    """The cells drawn, 100,000 at most, are broadcast: only training needs them."""
    session = Q._session(spark, Q.noisy(spark, SF))
    session.add_denial_constraint(Q.RULE)
    session.detect_errors([detect.ConstraintDetector(session.constraints), detect.NullDetector()])
    session.repair(Q.WEIGHTS)
    made = {c.cut_path.rsplit("/", 1)[1].split("-")[0] for c in session.cuts}
    assert {"values", "pairs", "lookup", "suspect", "inferred"} <= made and not made & {"drawn", "training"}
    session.reset()


def test_many_statistics_are_not_broadcast(spark, plans, monkeypatch):  # noqa: F811
    """Statistics have as many rows as cells where values are distinct; their files may be small nevertheless."""
    monkeypatch.setattr(tables, "FEW", 3)
    session = Q._session(spark, Q.noisy(spark, SF))
    session.add_denial_constraint(Q.RULE)
    session.detect_errors([detect.ConstraintDetector(session.constraints), detect.NullDetector()])
    out = session.repair(Q.WEIGHTS)
    for plan in (*plans, out):
        assert broadcast_scans(plan) == []
    assert out.count() == session.init.count()
    session.reset()
