"""Statistics of values and pairs, and the candidates ("domain") of cells drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..sources.tables import INDEX, attributes, flatten, whole, with_index


def value_counts(df: DataFrame, ind: str = INDEX, attrs: list[str] | None = None) -> DataFrame:
    """(attr, val, n); null is a value."""
    return flatten(df, ind, attrs).groupBy("attr", "val").agg(F.count("*").alias("n"))


def pair_counts(df: DataFrame, dirty: list[str], ind: str = INDEX, attrs: list[str] | None = None) -> DataFrame:
    """(attr, val, attr2, val2, n) for each attribute and each dirty attribute beside it: how many rows have both values.

    Pairs are made within the row and added up before they are shuffled; no self-join."""
    attrs = attrs or attributes(df, ind)
    pairs = [F.struct(F.lit(a).alias("attr"), F.col(f"`{a}`").cast("string").alias("val"), F.lit(b).alias("attr2"), F.col(f"`{b}`").cast("string").alias("val2")) for a in attrs for b in dirty if a != b]
    if not pairs:
        return df.sparkSession.createDataFrame([], "attr string, val string, attr2 string, val2 string, n long")
    return df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.attr", "p.val", "p.attr2", "p.val2").agg(F.count("*").alias("n"))


def cooccurrence(pairs: DataFrame, values: DataFrame, least: float = 0.0, nulls: bool = False) -> DataFrame:
    """(attr, val, attr2, val2, p): how often val2 comes with val, if more often than `least`. Nulls come with nothing unless asked for."""
    counts = values.select(F.col("attr").alias("a"), F.col("val").alias("v"), F.col("n").alias("all"))
    if not nulls:
        pairs = pairs.where("val is not null and val2 is not null")
    same = F.col("val").eqNullSafe(F.col("v")) if nulls else F.col("val") == F.col("v")
    out = pairs.join(counts, (F.col("attr") == F.col("a")) & same)
    return out.select("attr", "val", "attr2", "val2", (F.col("n") / F.col("all")).alias("p")).where(F.col("p") > least)


def dirty_attributes(df: DataFrame, dk: DataFrame, ind: str = INDEX) -> list[str]:
    """Attributes with a suspect cell, in the table's order; at most as many rows as attributes are collected."""
    found = {r[0] for r in dk.select("attr").distinct().collect()}
    return [a for a in attributes(df, ind) if a in found]


def candidates(df: DataFrame, of: DataFrame, lookup: DataFrame, ind: str = INDEX, attrs: list[str] | None = None) -> DataFrame:
    """(ind, attr, val, p) for cells `of` (ind, attr): values that come with the other values of the cell's row, p the largest probability."""
    row = flatten(df, ind, attrs).select("ind", F.col("attr").alias("a"), F.col("val").alias("v")).where("v is not null")
    near = of.select("ind", F.col("attr").alias("b")).join(whole(row), "ind").where("a <> b")
    look = lookup.select(F.col("attr").alias("a"), F.col("val").alias("v"), F.col("attr2").alias("b"), F.col("val2").alias("val"), "p")
    return near.join(look, ["a", "v", "b"]).groupBy("ind", F.col("b").alias("attr"), "val").agg(F.max("p").alias("p"))


def _observed(df: DataFrame, of: DataFrame, ind: str, attrs: list[str] | None) -> DataFrame:
    return whole(flatten(df, ind, attrs)).join(of.select("ind", "attr"), ["ind", "attr"], "left_semi")


def _with_observed(found: DataFrame, own: DataFrame) -> DataFrame:
    """Candidates and observed values (ind, attr, val, observed)."""
    return found.select("ind", "attr", "val", F.lit(0).alias("observed")).unionByName(own.where("val is not null").select("ind", "attr", "val", F.lit(1).alias("observed")))


def _others(found: DataFrame, own: DataFrame) -> DataFrame:
    return whole(found).join(own.select("ind", "attr", "val"), ["ind", "attr", "val"], "left_anti")


def likeliest(lookup: DataFrame, least: float, k: int) -> DataFrame:
    """What of a lookup can matter where each cell keeps its k likeliest candidates of probability `least` and more.

    A candidate's probability is the largest of those that single values give it. So it reaches `least` only if one does, and a
    value that isn't among the k likeliest of any value isn't among the k likeliest of a cell. k = 0: no limit."""
    lookup = lookup.where(F.col("p") >= least)
    if not k:
        return lookup
    order = Window.partitionBy("attr", "val", "attr2").orderBy(F.desc("p"), "val2")
    return lookup.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def dk_domain(df: DataFrame, dk: DataFrame, lookup: DataFrame, config: Config = Config(), ind: str = INDEX, attrs: list[str] | None = None) -> DataFrame:
    """(ind, attr, val, observed) of suspect cells: the observed value and the likeliest others, at least threshold2 likely,
    up to the breakoff. A null observed value takes a place, too. Ties go to the smaller value."""
    k = config.pruning_dk_breakoff
    own = _observed(df, dk, ind, attrs)
    # k - 1 others are kept; the observed value may be one more of the k likeliest.
    found = _others(candidates(df, dk, likeliest(lookup, config.pruning_threshold2, k), ind, attrs), own)
    if k:
        order = Window.partitionBy("ind", "attr").orderBy(F.desc("p"), "val")
        found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k - 1)
    return _with_observed(found, own)


def clean_domain(df: DataFrame, clean: DataFrame, lookup: DataFrame, config: Config = Config(), ind: str = INDEX, attrs: list[str] | None = None) -> DataFrame:
    """(ind, attr, val, observed) of training cells: the observed value, the likeliest others up to half the breakoff, the rest
    drawn by a seeded hash. Cells with a null value or one candidate teach nothing and are left out."""
    own = _observed(df, clean, ind, attrs).where("val is not null")
    found = _others(candidates(df, own, lookup, ind, attrs), own)
    k = config.pruning_clean_breakoff
    if k:
        half = max(k // 2 - 1, 0) if k > 1 else 0
        place = F.row_number().over(Window.partitionBy("ind", "attr").orderBy(F.desc("p"), "val"))
        drawn = F.when(F.col("r") <= half, F.lit(None)).otherwise(F.md5(F.concat_ws("|", F.lit(str(config.seed)), "ind", "attr", "val")))
        order = Window.partitionBy("ind", "attr").orderBy(F.col("drawn").asc_nulls_first(), "r")
        found = found.withColumn("r", place).withColumn("drawn", drawn).withColumn("s", F.row_number().over(order)).where(F.col("s") <= k - 1)
    both = _with_observed(found, own)
    return both.withColumn("k", F.count("*").over(Window.partitionBy("ind", "attr"))).where("k > 1").drop("k")


def domain_sizes(domain: DataFrame) -> DataFrame:
    """(ind, attr, k_ij)."""
    return domain.groupBy("ind", "attr").agg(F.count("*").alias("k_ij"))


def numbered(domain: DataFrame, attrs: list[str]) -> DataFrame:
    """domain with vid, from 1 in the order of rows and attributes, and domain_id, from 1 in the order of values."""
    place = F.element_at(F.create_map(*[x for i, a in enumerate(attrs) for x in (F.lit(a), F.lit(i))]), F.col("attr"))
    ids = with_index(domain.select("ind", "attr").distinct().withColumn("place", place), "vid", ["ind", "place"]).drop("place")
    own = F.row_number().over(Window.partitionBy("ind", "attr").orderBy("val"))
    return whole(domain).join(ids, ["ind", "attr"]).select("vid", "ind", "attr", "val", "observed", own.alias("domain_id"))
