"""Places with the reports made at them or near them (J5, J7, AG7, AG8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import bare_grid, trimmed
from . import cells
from ..session import stored
from .identifiers import with_items


def nearest_place(reports: DataFrame, places: DataFrame) -> DataFrame:
    """(file, seq, distance_m): the nearest predefined place whose radius covers a report; ties go to the first place."""
    covering = cells.within(reports.select("file", "lat", "lon"), places, "file", "seq")
    return covering.groupBy("file").agg(F.min(F.struct("distance_m", "seq")).alias("m")).select("file", "m.seq", "m.distance_m")


def claims(reports: DataFrame, elevated: DataFrame, places: DataFrame) -> DataFrame:
    """(place, file, tnr, tidpunkt, elevated, plates, lat, lon, named, predefined): every report a place claims; ``named`` is the place it names itself.

    A predefined place claims all reports that name it and those it is the nearest
    covering place of; another place only elevated reports and ones with a plate.
    """
    whole = F.transform(F.filter("items", lambda i: (i["type"] == "plate") & ~i["partial"]), lambda i: i["value"])
    base = with_items(reports, "tnr", "tidpunkt", "plats", "lat", "lon").select(
        "file", "tnr", "tidpunkt", trimmed(F.coalesce("plats", F.lit(""))).alias("place"), "lat", "lon", F.array_sort(whole).alias("plates")
    )
    base = stored(base.join(elevated.select("file", F.lit(True).alias("hot")), "file", "left").withColumn("elevated", F.coalesce("hot", F.lit(False))).drop("hot"))
    # Whether places are few enough to broadcast is left to the planner, which knows the table's size.
    named = places.select(F.col("name").alias("place"), F.lit(True).alias("predefined"))
    base = base.withColumn("named", F.col("place"))
    own = base.join(named, "place", "left").withColumn("predefined", F.coalesce("predefined", F.lit(False)))
    own = own.filter((F.col("place") != "") & (F.col("predefined") | F.col("elevated") | (F.size("plates") > 0)))
    near = nearest_place(reports, places).join(places.select("seq", "name"), "seq").select("file", "name")
    vicinity = base.join(near, "file").filter(F.col("name") != F.col("place")).withColumn("place", F.col("name")).drop("name").withColumn("predefined", F.lit(True))
    return own.unionByName(vicinity)


def locations(claimed: DataFrame, places: DataFrame) -> DataFrame:
    """(place, reports, elevated, plates, lat, lon, predefined): every place, predefined ones without reports included."""
    # A report's first plate, or its lack of any, stands for the report: one pass counts reports and distinct plates.
    rows = claimed.select("place", "file", "elevated", "lat", "lon", "predefined", F.posexplode_outer("plates").alias("i", "plate"))
    once = F.coalesce("i", F.lit(0)) == 0
    grouped = rows.groupBy("place").agg(
        F.count_if(once).alias("reports"),
        F.count_if(once & F.col("elevated")).alias("elevated"),
        F.countDistinct("plate").alias("plates"),
        F.min(F.when(F.col("lat").isNotNull(), F.struct("file", "lat", "lon"))).alias("at"),
    )
    own = places.select(F.col("name").alias("place"), F.struct("lat", "lon").alias("placed"))
    every = grouped.join(own, "place", "full")
    at = F.coalesce("placed", F.struct("at.lat", "at.lon"))
    return every.select(
        "place", F.coalesce("reports", F.lit(0)).alias("reports"), F.coalesce("elevated", F.lit(0)).alias("elevated"), F.coalesce("plates", F.lit(0)).alias("plates"),
        at["lat"].alias("lat"), at["lon"].alias("lon"), F.col("placed").isNotNull().alias("predefined"),
    )


def moved(claimed: DataFrame, closed: DataFrame) -> DataFrame:
    """Claims after places were merged (absorbed, survivor): a report that both claimed counts once."""
    renamed = claimed.join(closed.withColumnRenamed("absorbed", "place"), "place", "left").withColumn("place", F.coalesce("survivor", "place")).drop("survivor")
    # A row per claim, whose columns but the last are the report's own.
    return renamed.groupBy("place", "file").agg(*[F.first(c).alias(c) for c in renamed.columns if c not in ("place", "file", "predefined")], F.bool_or("predefined").alias("predefined"))


def near_of(claimed: DataFrame) -> DataFrame:
    """(file, near): the predefined place that claimed a report for its position though it names another."""
    return claimed.filter("predefined and place <> named").groupBy("file").agg(F.min("place").alias("near"))


def vehicle_recurrence(claimed: DataFrame) -> DataFrame:
    """(place, plate, n) of plates in two or more of a place's reports."""
    return claimed.select("place", F.explode("plates").alias("plate")).groupBy("place", "plate").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def actor_recurrence(chain: DataFrame, located: DataFrame) -> DataFrame:
    """(place, actor, n) of actors whose chains have two or more steps at a known place."""
    steps = chain.select("actor", trimmed(F.coalesce("plats", F.lit(""))).alias("place")).groupBy("place", "actor").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return steps.join(located.select("place"), "place", "left_semi")


def nearest_nameless(located: DataFrame, nicknames: DataFrame, spots: DataFrame) -> DataFrame:
    """The nearest grid place without a nickname within reach of each spot (seq, lat, lon): (seq, place, distance_m), none where there is none."""
    open_ = located.filter(bare_grid(F.col("place"))).join(nicknames.select("place"), "place", "left_anti").select("place", "lat", "lon")
    near = cells.within(open_, spots.withColumn("radius_m", F.lit(V.NAMELESS_WITHIN_M)), "place", "seq")
    return near.groupBy("seq").agg(F.min(F.struct("distance_m", "place")).alias("m")).select("seq", "m.place", "m.distance_m")
