"""Pacing of a replayed day (S17, T5, W6, ST8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minutes_of(number: Column) -> Column:
    """A monotone clock in minutes of a DDHHMM number; null when it is none."""
    part = lambda i: F.substring(number, i, 2).try_cast("int")
    return F.when(number.rlike(r"^\d{6}$"), part(1) * 1440 + part(3) * 60 + part(5))


def schedule(messages: DataFrame, speed: float, least_gap_s: float) -> DataFrame:
    """(file, at_s): when each message is sent again, in order and never closer than the gap.

    The running rule at_i = max(ideal_i, at_{i-1} + gap) in closed form. Messages of a
    minute share their ideal time, so only the first of a minute can move the ones
    after it: places and running maximum are carried over a table of minutes, which
    the number's six digits bound, and messages are only ranked within their minute.
    """
    timed = messages.select("file", minutes_of(F.col("tnr")).alias("m")).filter(F.col("m").isNotNull())
    clock = Window.orderBy("m")  # over minutes, never messages
    counted = timed.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.select("m", (F.sum("n").over(clock) - F.col("n")).alias("before"), ((F.col("m") - F.min("m").over(clock)) * 60 / speed).alias("ideal"))
    late = F.max(F.col("ideal") - F.col("before") * least_gap_s).over(clock)
    minutes = F.broadcast(placed.select("m", "before", late.alias("late")))
    nth = F.row_number().over(Window.partitionBy("m").orderBy("file")) - 1
    ranked = timed.select("file", "m", nth.alias("nth")).join(minutes, "m")
    return ranked.select("file", F.round((F.col("before") + F.col("nth")) * least_gap_s + F.col("late"), 6).alias("at_s"))
