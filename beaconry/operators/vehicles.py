"""Vehicles re-identified by plate, partly read plates included (J1, AG1, AG2).

A partly read plate has one of few masks, the places of it that were read. Every whole
plate is written under each mask that occurs, unread places as dots, so that a partial
equals the whole plates it fits: one equality, counted before the shuffle. Only a
partial with exactly one whole plate is merged into it.

The planner does not know that a plate becomes a row per mask and would broadcast
them as if they were one, so joins with them are told to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identifiers import plates


#: What a sighting tells of its report.
TOLD = ("tnr", "tidpunkt", "plats", "sagesman")


#: Letters and digits of a plate.
PLACES = 6


def _masked(plate: str, mask: str) -> Column:
    return F.concat(*[F.substring(plate, i, 1) if seen != "." else F.lit(".") for i, seen in enumerate(mask, 1)])


def _fitting(mentions: DataFrame) -> DataFrame:
    """(partial, plate): whole plates as every mask of the partials shows them."""
    shape = F.regexp_replace("plate", r"[^.]", "x")
    # Six places, read or not: at most 64 masks.
    masks = [r["mask"] for r in mentions.filter(F.col("partial") & (F.length("plate") == PLACES)).select(shape.alias("mask")).distinct().collect()]
    wholes = mentions.filter(~F.col("partial") & (F.length("plate") == PLACES)).select("plate").distinct()
    shown = F.array(*[_masked("plate", m) for m in sorted(masks)]).cast("array<string>")
    return wholes.select(F.explode(shown).alias("partial"), "plate")


def partial_matches(mentions: DataFrame) -> DataFrame:
    """(partial, n, only): how many whole plates each partial fits, and which if it is one."""
    partials = mentions.filter("partial").select(F.col("plate").alias("partial")).distinct()
    fits = _fitting(mentions).groupBy("partial").agg(F.count(F.lit(1)).alias("n"), F.min("plate").alias("least"))
    return partials.join(fits.hint("merge"), "partial", "left").select("partial", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("least")).alias("only"))


def candidates(mentions: DataFrame) -> DataFrame:
    """(partial, plate): the whole plates of each partial that fits several."""
    several = partial_matches(mentions).filter("n > 1").select("partial")
    return _fitting(mentions).hint("merge").join(several, "partial")


def observations(reports: DataFrame) -> DataFrame:
    """One row per sighting of a vehicle: (canonical, kind, file, tnr, tidpunkt, plats, sagesman, as_read)."""
    return observed(plates(reports, *TOLD))


def observed(seen: DataFrame) -> DataFrame:
    """``observations`` of plates that were read with the columns of ``TOLD``."""
    told = ["file", *TOLD]
    whole = seen.filter(~F.col("partial")).select(F.col("plate").alias("canonical"), F.lit("fordon-reg-full").alias("kind"), *told, F.lit(None).cast("string").alias("as_read"))
    fits = partial_matches(seen).select(F.col("partial").alias("plate"), "only")
    merged = F.col("only").isNotNull()
    read = seen.filter("partial").join(fits.hint("merge"), "plate").select(
        F.coalesce("only", "plate").alias("canonical"), F.when(merged, "fordon-reg-full").otherwise("fordon-reg-partiell").alias("kind"), *told, F.col("plate").alias("as_read")
    )
    return whole.unionByName(read)


def entities(seen: DataFrame) -> DataFrame:
    """Vehicles of ``observations``: (canonical, kind, count, first_seen, last_seen, observers, resolved)."""
    time = F.nullif(F.col("tidpunkt"), F.lit(""))
    return seen.groupBy("canonical", "kind").agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.min(time), F.lit("")).alias("first_seen"),
        F.coalesce(F.max(time), F.lit("")).alias("last_seen"),
        F.array_sort(F.collect_set(F.nullif(F.col("sagesman"), F.lit("")))).alias("observers"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "fordon-reg-full", F.col("as_read")))).alias("resolved"),
    )
