"""How well groups and scores agree with the truth (AG16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_agreement(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(pairs_found, pairs_true, pairs_both, precision, recall) of two clusterings (item, group).

    Pairs are counted from the sizes of groups and of their overlaps, never listed.
    """
    pairs = lambda n: n * (n - 1) / 2

    def total(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("p"))

    p = predicted.select("item", F.col("group").alias("g"))
    t = truth.select("item", F.col("group").alias("h"))
    found, true, both = total(p, "g").withColumnRenamed("p", "pairs_found"), total(t, "h").withColumnRenamed("p", "pairs_true"), total(p.join(t, "item"), "g", "h").withColumnRenamed("p", "pairs_both")
    one = found.join(F.broadcast(true)).join(F.broadcast(both))  # one row each
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return one.select("*", rate("pairs_both", "pairs_found").alias("precision"), rate("pairs_both", "pairs_true").alias("recall"))


def detection(flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """(hits, false_alarms, missed, precision, recall) of flagged items (item) against (item, positive)."""
    rows = truth.join(flagged.select("item", F.lit(True).alias("said")).distinct(), "item", "left").withColumn("said", F.coalesce("said", F.lit(False)))
    counts = rows.agg(F.count_if(F.col("said") & F.col("positive")).alias("hits"), F.count_if(F.col("said") & ~F.col("positive")).alias("false_alarms"), F.count_if(~F.col("said") & F.col("positive")).alias("missed"))
    rate = lambda other: F.when(F.col("hits") + F.col(other) > 0, F.col("hits") / (F.col("hits") + F.col(other))).otherwise(1.0)
    return counts.select("*", rate("false_alarms").alias("precision"), rate("missed").alias("recall"))
