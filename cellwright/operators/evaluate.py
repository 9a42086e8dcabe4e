"""Precision and recall against true values (tid, attr_name, attr_val)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import INDEX, flatten


def compare(df: DataFrame, dk: DataFrame, inferred: DataFrame, truth: DataFrame, ind: str = INDEX) -> DataFrame:
    """One row: cells inferred with a known truth, how many correctly, errors detected and in all, precision and recall,
    and both again for the likeliest values alone.

    A cell is correct if any of its inferred values is the true one. Errors are observed values other than the true
    ones, nulls left out. Recall is 1 minus the share of detected errors whose repair is wrong; 1 without detected errors."""
    truth = truth.select(F.col("tid").alias("ind"), F.col("attr_name").alias("attr"), F.col("attr_val").alias("truth"))
    key = ["ind", "attr"]
    judged = inferred.join(truth, key).groupBy(*key).agg(F.max((F.col("val") == F.col("truth")).cast("int")).alias("hit"), F.max(F.when(F.col("rank") == 1, (F.col("val") == F.col("truth")).cast("int"))).alias("map_hit"))
    wrong = flatten(df, ind).join(truth, key).where("val <> truth").select(*key, F.lit(1).alias("error"))
    seen = dk.select("ind", "attr").distinct().withColumn("dk", F.lit(1))
    every = judged.join(wrong, key, "full").join(seen, key, "left")
    detected = (F.col("error") == 1) & (F.col("dk") == 1)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = every.agg(one(F.col("hit").isNotNull()).alias("inferred"), one(F.col("hit") == 1).alias("correct"), one(F.col("map_hit") == 1).alias("map_correct"), one(detected).alias("detected_errors"), one(F.col("error") == 1).alias("total_errors"), one(detected & (F.col("hit") == 0)).alias("missed"), one(detected & (F.col("map_hit") == 0)).alias("map_missed"))
    ratio = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    return sums.fillna(0).select("inferred", "correct", "detected_errors", "total_errors", ratio("correct", "inferred", 0.0).alias("precision"), (1 - ratio("missed", "detected_errors", 0.0)).alias("recall"), ratio("map_correct", "inferred", 0.0).alias("map_precision"), (1 - ratio("map_missed", "detected_errors", 0.0)).alias("map_recall"))
