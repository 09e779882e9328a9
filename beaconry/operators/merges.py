"""Operator merges followed to their survivor (A5, GR6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def survivors(merges: DataFrame) -> DataFrame:
    """(absorbed, survivor) with every chain followed to its end.

    A chain that runs into a cycle stops at the last id before one comes again, so
    an id on a cycle that leads back to itself stands for itself. Each round follows
    one step for all ids at once until no chain goes on, which must come, for no id
    comes twice in a path; the decisions are few, chains are short.
    """
    ensure_checkpoint_dir(merges.sparkSession)
    step = merges.filter(F.col("absorbed").isNotNull() & F.col("survivor").isNotNull()).groupBy("absorbed").agg(F.max("survivor").alias("next"))
    state = step.select("absorbed", F.array("absorbed").alias("path"), F.lit(True).alias("open"))
    following = step.select(F.col("absorbed").alias("last"), "next")
    while True:
        told = state.withColumn("last", F.element_at("path", -1)).join(following, "last", "left")
        goes = F.col("open") & F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        state = told.select("absorbed", F.when(goes, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"), goes.alias("open")).checkpoint()
        if state.filter("open").isEmpty():
            break
    # Back at the start of a cycle the start itself is the survivor.
    end = F.element_at("path", -1)
    ended = state.select("absorbed", end.alias("last"), "path").join(following, "last", "left")
    start = F.col("path")[0]
    return ended.select("absorbed", F.when(F.col("next") == start, start).otherwise(F.col("last")).alias("survivor"))


def resolved(df: DataFrame, column: str, closed: DataFrame) -> DataFrame:
    """``df`` with ids of ``column`` replaced by their survivors; the decisions are few and checked by the caller's table."""
    renamed = closed.select(F.col("absorbed").alias(column), "survivor")
    return df.join(renamed, column, "left").withColumn(column, F.coalesce("survivor", column)).drop("survivor")
