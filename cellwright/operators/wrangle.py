"""The wrangler: functions over columns, then clusters of similar strings replaced by their most frequent member."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.tables import read, write_csv

LEVENSHTEIN = "levenshtein"


def jaccard(a: str, b: str) -> float:
    """1 minus the share of common characters."""
    x, y = set(a), set(b)
    return 1 - len(x & y) / len(x | y) if x | y else 0.0


@dataclass(frozen=True)
class Transformer:
    """Functions from column to column, in order, over string columns; other columns stay as they are."""

    functions: tuple[Callable[[Column], Column], ...]
    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            if isinstance(df.schema[c].dataType, T.StringType):
                new[c] = text.folded(self.functions, F.col(f"`{c}`"))
        return df.withColumns(new)


@dataclass(frozen=True)
class ColumnNorm:
    """How to cluster a column. distance: levenshtein, or a function of two strings, which needs a threshold."""

    column: str
    distance: str | Callable[[str, str], float] = LEVENSHTEIN
    threshold: float | None = None

    def __post_init__(self):
        if self.threshold is None:
            if self.distance != LEVENSHTEIN:
                raise ValueError("a distance other than levenshtein needs a threshold")
            object.__setattr__(self, "threshold", 3)


def close_pairs(values: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b), a < b, of values (val) within Levenshtein distance `most`: joined on their lengths, which differ no more."""
    left = values.select(F.col("val").alias("a"), F.explode(F.sequence(F.length("val") - most, F.length("val") + most)).alias("n"))
    right = values.select(F.col("val").alias("b"), F.length("val").alias("n"))
    return left.join(right, "n").where("a < b").where(F.levenshtein("a", "b", most) >= 0).select("a", "b")


def clusters(counts: list[tuple[str, int]], pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Value to exemplar: the most frequent value of its connected component, ties to the smaller one."""
    parent = {v: v for v, _ in counts}

    def head(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[head(a)] = head(b)
    best: dict[str, tuple[int, str]] = {}
    for v, n in counts:
        best[head(v)] = min(best.get(head(v), (1, "")), (-n, v))
    return {v: best[head(v)][1] for v, _ in counts}


@dataclass(frozen=True)
class Normalizer:
    """Columns with 2 to max_distinct distinct values (null counts as the empty string) are clustered; others stay. Null cells stay null."""

    columns: tuple[ColumnNorm, ...]
    max_distinct: int = 1000

    def mapping(self, df: DataFrame, norm: ColumnNorm) -> DataFrame | None:
        """(val, exemplar), at most max_distinct rows, or None for a column that stays."""
        spark, c = df.sparkSession, F.coalesce(F.col(f"`{norm.column}`").cast("string"), F.lit(""))
        counts = df.groupBy(c.alias("val")).agg(F.count("*").alias("n"))
        rows = [(r[0], r[1]) for r in counts.limit(self.max_distinct + 1).collect()]
        if not 1 < len(rows) <= self.max_distinct:
            return None
        if norm.distance == LEVENSHTEIN:
            values = spark.createDataFrame([(v,) for v, _ in rows], "val string")
            pairs = [(r[0], r[1]) for r in close_pairs(values, int(norm.threshold)).collect()]
        else:
            names = sorted(v for v, _ in rows)
            pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if norm.distance(a, b) <= norm.threshold]
        return spark.createDataFrame(sorted(clusters(rows, pairs).items()), "val string, exemplar string")

    def normalize(self, df: DataFrame) -> DataFrame:
        for norm in self.columns:
            found = self.mapping(df, norm)
            if found is not None:
                names = [f"`{c}`" for c in df.columns]
                map_ = F.broadcast(found.toDF("__val", "__new"))  # max_distinct rows at most
                joined = df.join(map_, F.col(f"`{norm.column}`").cast("string") == F.col("__val"), "left")
                kind = df.schema[norm.column].dataType
                df = joined.select(*[F.coalesce(F.col("__new").cast(kind), F.col(n)).alias(c) if c == norm.column else F.col(n) for n, c in zip(names, df.columns)])
        return df


class Wrangler:
    """Transformers in order, then one normalizer; setting it again replaces it."""

    def __init__(self):
        self.transformers: list[Transformer] = []
        self.normalizer: Normalizer | None = None

    def add_transformer(self, t: Transformer) -> None:
        self.transformers.append(t)

    def set_normalizer(self, n: Normalizer) -> None:
        self.normalizer = n

    def wrangle(self, df: DataFrame) -> DataFrame:
        for t in self.transformers:
            df = t.transform(df)
        return self.normalizer.normalize(df) if self.normalizer else df


def default_wrangler(columns: list[str]) -> Wrangler:
    """Lower case and trim every column, then cluster each by Levenshtein distance."""
    w = Wrangler()
    w.add_transformer(Transformer((text.lowercase, text.trim), tuple(columns)))
    w.set_normalizer(Normalizer(tuple(ColumnNorm(c) for c in columns)))
    return w


def wrangle_file(spark: SparkSession, source: str, target: str) -> None:
    """Lower-case, trim and cluster every column of a table and write it as CSV with a header."""
    table = read(spark, source)
    write_csv(default_wrangler(table.columns).wrangle(table), target)
