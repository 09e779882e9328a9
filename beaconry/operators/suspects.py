"""Elevated reports grouped by the agent they show (J3, AG5, AG6, P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import level, safe_name, trimmed
from .identifiers import with_items


def agents(reports: DataFrame) -> DataFrame:
    """(file, agent, kind, label): a report's first plate (a whole one before a partial), else its described person, else itself."""
    base = with_items(reports, "symbol", "tnr")
    plates = F.array_sort(F.transform(F.filter("items", lambda i: i["type"] == "plate"), lambda i: F.struct(i["partial"].alias("partial"), i["value"].alias("value"))))
    plate = F.get(plates, F.lit(0))["value"]
    said = F.nullif(trimmed(F.coalesce("symbol", F.lit(""))), F.lit(""))
    number = F.coalesce("tnr", F.lit(""))
    return base.withColumns({"plate": plate, "said": said}).select(
        "file",
        F.when(F.col("plate").isNotNull(), F.concat(F.lit("fordon:"), "plate")).otherwise(F.concat(F.lit("person:"), F.coalesce(F.lower("said"), number))).alias("agent"),
        F.when(F.col("plate").isNotNull(), "fordon").otherwise("person").alias("kind"),
        F.coalesce("plate", "said", F.concat(F.lit("okänd (TNR"), number, F.lit(")"))).alias("label"),
    )


def sightings(reports: DataFrame, elevated: DataFrame) -> DataFrame:
    """Elevated reports with their agent."""
    return elevated.join(agents(reports.join(elevated.select("file"), "file", "left_semi")), "file")


def suspects(seen: DataFrame) -> DataFrame:
    """Agents of ``sightings``: (agent, kind, label, n, first_seen, last_seen, top, level, behaving, lat, lon)."""
    order = F.struct("tidpunkt", "tnr", "file")
    behaving = F.exists("reasons", lambda r: r["key"].startswith("beteende:"))
    grouped = seen.groupBy("agent").agg(
        F.min_by("kind", order).alias("kind"),
        F.min_by("label", order).alias("label"),
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.coalesce("tidpunkt", F.lit("")), order).alias("first_seen"),
        F.max_by(F.coalesce("tidpunkt", F.lit("")), order).alias("last_seen"),
        F.max("score").alias("top"),
        F.bool_or(behaving).alias("behaving"),
        F.max_by(F.struct("lat", "lon"), order).alias("at"),
    )
    band = F.coalesce(F.nullif(level(F.col("top")), F.lit("")), F.lit("Att bevaka"))
    return grouped.select("agent", "kind", "label", "n", "first_seen", "last_seen", "top", band.alias("level"), "behaving", "at.lat", "at.lon")


def candidate() -> Column:
    """A suspect to nominate as an actor: seen again, or behaving so."""
    return (F.col("n") > 1) | F.col("behaving")


def hypotheses(found: DataFrame) -> DataFrame:
    """Candidates as actors of one facet: (id, facet, label, vehicles, marks, n, first_seen, last_seen, lat, lon)."""
    vehicle = F.col("kind") == "fordon"
    return found.filter(candidate()).select(
        F.concat(F.lit("suspect-"), safe_name(F.col("agent"))).alias("id"),
        F.col("agent").alias("facet"),
        "label",
        vehicle.cast("int").alias("vehicles"),
        (~vehicle).cast("int").alias("marks"),
        "n", "first_seen", "last_seen", "lat", "lon",
    )


