"""Operators' decisions as a log, and the state that follows from it (S16, P11, 2.14).

A decision is a row (map, key, value, at, seq): what is decided about, its key, the value or
null to take it back, and when. The state is the latest value per map and key. Nothing
is ever changed in place, so a decision can be taken twice or out of order.

Defined cases: of two decisions of one time the larger seq counts; a null map or key
decides nothing; an empty log leaves everything undecided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import coordinate
from ..functions.text import trimmed

LOG = "map string, key string, value string, at string, seq long"
#: The maps that hold a judgement, which a new area of operation wipes.
JUDGEMENTS = (
    "actor", "mark", "nickname", "name-asked", "actor-name", "actor-merge", "place-merge", "place", "seen-alert", "map-seed", "photo-plate", "photo-note", "behaviour", "flag", "text-mark", "watch",
)
#: A decision about every key of a map at once.
EVERY = "*"
#: The least and the usual radius of a place an operator adds.
LEAST_RADIUS_M, USUAL_RADIUS_M = 10, 100


def append(log: str, decisions: DataFrame) -> None:
    """Adds decisions to a stored log."""
    decisions.select("map", "key", "value", "at", "seq").write.mode("append").parquet(log)


def read(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log)


def state(log: DataFrame) -> DataFrame:
    """(map, key, value): the decisions that stand. A reset of a whole map (key ``*``) undoes what came before it."""
    known = log.filter(F.col("map").isNotNull() & F.col("key").isNotNull())
    when = F.struct("at", "seq")
    last = known.groupBy("map", "key").agg(F.max_by(F.struct("value"), when).alias("v"), F.max(when).alias("when"))
    wiped = last.filter(F.col("key") == EVERY).select("map", F.col("when").alias("wiped"))
    standing = last.filter(F.col("key") != EVERY).join(wiped, "map", "left").filter(F.col("wiped").isNull() | (F.col("when") > F.col("wiped")))
    return standing.select("map", "key", F.col("v.value").alias("value")).filter(F.col("value").isNotNull())


def of(standing: DataFrame, name: str) -> DataFrame:
    """(key, value) of one map."""
    return standing.filter(F.col("map") == name).select("key", "value")


def decided(found: DataFrame, standing: DataFrame, name: str, key: str) -> DataFrame:
    """``found`` with a column ``decision`` from one map, null where nothing is decided."""
    told = of(standing, name).select(F.col("key").alias(key), F.col("value").alias("decision"))
    return found.join(told, key, "left")


def reset_rows(names: tuple[str, ...], spark: SparkSession, at: str, seq: int) -> DataFrame:
    """Log rows that wipe whole maps."""
    return spark.createDataFrame([(n, EVERY, None, at, seq) for n in names], LOG)


def any_judgement(standing: DataFrame) -> DataFrame:
    """One row (any): whether there is anything a new area would wipe."""
    return standing.filter(F.col("map").isin(*JUDGEMENTS)).agg((F.count(F.lit(1)) > 0).alias("any"))


def area_changes(log: DataFrame) -> DataFrame:
    """The log with the wipes that changes of the area of operation bring: a moved area wipes every judgement before it, a renamed one none.

    Areas are the decisions of map ``area`` with key ``lat,lon``; there are few of them.
    """
    from pyspark.sql import Window

    areas = log.filter((F.col("map") == "area") & F.col("value").isNotNull())
    moved = areas.withColumn("was", F.lag("key").over(Window.partitionBy("map").orderBy("at", "seq"))).filter(F.col("was").isNull() | (F.col("was") != F.col("key")))
    wipes = moved.select(F.explode(F.array(*map(F.lit, JUDGEMENTS))).alias("map"), F.lit(EVERY).alias("key"), F.lit(None).cast("string").alias("value"), "at", "seq")
    return log.select("map", "key", "value", "at", "seq").unionByName(wipes)


def placed(entered: DataFrame) -> DataFrame:
    """Places as typed (name, at, radius) checked: adds (lat, lon, radius_m, problem); problem is null for a good one."""
    name, where = trimmed(F.coalesce("name", F.lit(""))), coordinate(F.coalesce("at", F.lit("")))
    radius = F.floor(F.coalesce(F.col("radius").try_cast("double"), F.lit(float(USUAL_RADIUS_M))) + 0.5)
    problem: Column = F.when(name == "", "name").when(F.col("where").isNull(), "position").when(~(radius >= LEAST_RADIUS_M), "radius")
    return entered.withColumn("where", where).select("*", F.col("where.lat").alias("lat"), F.col("where.lon").alias("lon"), radius.cast("long").alias("radius_m"), problem.alias("problem")).drop("where")
