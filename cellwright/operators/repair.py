"""Repair of a table from inferred values, and the session that leads from a dirty table to a repaired one."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..plans.constraint import Constraint, load, parse
from ..sources import tables
from ..sources.scratch import cut, forget
from ..sources.tables import INDEX, attributes
from . import domain as dom
from . import evaluate, features, model
from .detect import Detector, LabelledCells, detect

log = logging.getLogger(__name__)


def repaired(df: DataFrame, map_values: DataFrame, ind: str = INDEX, attrs: list[str] | None = None, keep_index: bool = True) -> DataFrame:
    """df with the cells of map_values (ind, attr, val; one row per cell) overwritten; types are kept."""
    attrs = attrs or attributes(df, ind)
    wide = map_values.groupBy(F.col("ind").alias("__cell")).agg(*[F.max(F.when(F.col("attr") == a, F.col("val"))).alias(f"__new_{i}") for i, a in enumerate(attrs)])
    joined = tables.whole(df).join(wide, F.col(f"`{ind}`") == F.col("__cell"), "left")
    new = {a: F.coalesce(F.col(f"__new_{i}").cast(df.schema[a].dataType), F.col(f"`{a}`")).alias(a) for i, a in enumerate(attrs)}
    return joined.select(*[new.get(c, F.col(f"`{c}`")) for c in df.columns if keep_index or c != ind])


class Session:
    """One cleaning run: load, constrain, detect, repair, compare. Its intermediate tables stand in the shared folder until reset."""

    def __init__(self, spark: SparkSession, config: Config = Config(), ind: str = INDEX):
        self.spark, self.config, self.ind = spark, config, ind
        self.catalog = tables.Catalog(spark)
        self.constraints: list[Constraint] = []
        self.featurizers: list[features.Featurizer] = []
        self.init = self.clean = self.dk = self.inferred = self.map_values = self.weights = None
        self.cuts: list[DataFrame] = []

    @contextmanager
    def _timed(self, what: str):
        began = time.monotonic()
        yield
        log.log(logging.WARNING if self.config.verbose else logging.DEBUG, "%s took %.3f s", what, time.monotonic() - began)

    def _cut(self, df: DataFrame, what: str) -> DataFrame:
        self.cuts.append(cut(df, what))
        return self.cuts[-1]

    def load_data(self, path: str, **options) -> DataFrame:
        with self._timed("loading"):
            return self.use(tables.read(self.spark, path, index=True, **options))

    def use(self, df: DataFrame) -> DataFrame:
        """Take a table that has the row number already."""
        self.init = self.catalog.add("Init", df)
        self.catalog.add("Map_schema", tables.map_schema(df, self.ind))
        return df

    def load_dirty_data(self, path: str) -> tuple[DataFrame, DataFrame]:
        """(clean, dk) by a CSV of suspect cells (ind, attr), in place of detection; all others are clean."""
        return self.detect_errors([LabelledCells(tables.read_cells(self.spark, path))])

    def load_clean_data(self, path: str) -> tuple[DataFrame, DataFrame]:
        """(clean, dk) by a CSV of clean cells (ind, attr), in place of detection; all others are suspect."""
        return self.detect_errors([LabelledCells(tables.read_cells(self.spark, path), clean=True)])

    def load_denial_constraints(self, path: str) -> list[Constraint]:
        lines = [r[0] for r in self.spark.read.text(path).collect()]
        self.constraints += load(lines, self.init.columns, [c.text for c in self.constraints])
        return self.constraints

    def add_denial_constraint(self, text: str) -> list[Constraint]:
        self.constraints.append(parse(text, self.init.columns))
        return self.constraints

    def remove_denial_constraint(self, index: int) -> Constraint:
        if not 0 <= index < len(self.constraints):
            raise IndexError(f"no constraint {index}: there are {len(self.constraints)}")
        return self.constraints.pop(index)

    def add_featurizer(self, featurizer: features.Featurizer) -> None:
        self.featurizers.append(featurizer)

    def detect_errors(self, detectors: list[Detector]) -> tuple[DataFrame, DataFrame]:
        """(clean, dk) by the detectors given now, whatever was detected before."""
        with self._timed("error detection"):
            clean, dk = detect(self.init, detectors, self.ind)
            self.clean, self.dk = self.catalog.add("C_clean", self._cut(clean, "clean")), self.catalog.add("C_dk", self._cut(dk, "dk"))
        return self.clean, self.dk

    def domains(self, learn: bool = True) -> tuple[DataFrame | None, DataFrame, list[str]]:
        """(training domain, suspect domain, dirty attributes). Counts are over the whole table; the training domain is that of all cells to learn from.

        learn: without it there is no training domain."""
        dirty = dom.dirty_attributes(self.init, self.dk, self.ind)
        statistics = lambda df, what: tables.few_or_whole(self._cut(df, what))
        self.values = statistics(dom.value_counts(self.init, self.ind), "values")
        self.pairs = statistics(dom.pair_counts(self.init, dirty, self.ind), "pairs")
        lookup = statistics(dom.cooccurrence(self.pairs, self.values, self.config.pruning_threshold1), "lookup")
        training = self._training(lookup, dirty) if learn else None
        return training, self._cut(dom.dk_domain(self.init, self.dk, lookup, self.config, self.ind), "suspect"), dirty

    def _training(self, lookup: DataFrame, dirty: list[str]) -> DataFrame:
        training = tables.whole(tables.cells(self.init, self.ind, dirty or None)).join(self.dk, ["ind", "attr"], "left_anti")
        if self.config.train_on_clean_only:
            training = tables.whole(training).join(self.clean, ["ind", "attr"], "left_semi")
        training = self._cut(model.drawn(training, self.config), "drawn")
        return self._cut(dom.clean_domain(self.init, training, lookup, self.config, self.ind), "training")

    def repair(self, weights: dict[str, float] | None = None) -> DataFrame:
        """The repaired table. Where no cell can be learned from, the weights stay as drawn, with a warning; cells without candidates stay as they are.

        weights: by feature, in place of training."""
        if self.dk is None:
            raise RuntimeError("detect errors first")
        with self._timed("domains"):
            training, suspect, dirty = self.domains(learn=weights is None)
        signals = [features.Observed(), *([features.Violations(self.constraints)] if self.constraints else []), features.Cooccurrence(dirty, self.pairs, self.values), *self.featurizers]
        names = [n for f in signals for n, _, _ in f.names()]
        self.feature_map = self.catalog.add("Feature_id_map", features.feature_map(self.spark, signals))
        with self._timed("training"):
            if weights is not None:
                w = [float(weights.get(n, 0.0)) for n in names]
            elif training.isEmpty():
                log.warning("no clean cell has a choice of candidates: nothing to learn from")
                w = model.initial_weights(names, self.config.seed)
            else:
                w = model.train(training, features.normalized(features.featurize(self.init, training, signals, self.ind)), names, self.config)
        self.weights = model.weights_frame(self.spark, names, w)
        with self._timed("inference"):
            chances = model.probabilities(suspect, features.normalized(features.featurize(self.init, suspect, signals, self.ind)), self.weights)
            self.inferred = self.catalog.add("Inferred_values", self._cut(model.top(chances, self.config.k_inferred), "inferred"))
        self.map_values = self.catalog.add("Inferred_map", self.inferred.where("rank = 1"))
        return self.catalog.add("Repaired_dataset", repaired(self.init, self.map_values, self.ind))

    def compare_to_truth(self, truth: DataFrame | str) -> DataFrame:
        """Precision and recall of the values inferred, and of the likeliest ones."""
        truth = tables.read_truth(self.spark, truth) if isinstance(truth, str) else truth
        return evaluate.compare(self.init, self.dk, self.inferred, truth, self.ind)

    def reset(self) -> None:
        """Drop the session's tables and delete what it wrote to the shared folder."""
        self.catalog.reset()
        forget(*self.cuts)
        self.cuts = []
