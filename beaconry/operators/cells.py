"""Points within discs by space-filling-curve codes (problem 6).

Every point gets the Morton code of its finest cell. A disc is covered, at a cell
size fitted to it, by the cells of its bounding boxes, which become ranges of
codes; neighbouring cells under one parent are one range. The join matches
(level, parent) for equality and the code against the sorted range, and the
great-circle distance then decides exactly. Points are not shuffled while the
ranges are few (checked); beyond that they are salted by parent.

Defined cases: null, NaN or out-of-range positions and regions without a radius,
or with a negative one, give nothing; a region at a pole or across the date line
is covered by more than one box; copies and equal distances all count; an empty
side gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
FINEST = 24
#: Ranges up to this many are broadcast: a range takes about 60 bytes, so at most some 12 MB.
BROADCAST_RANGES = 200_000
SALTS = 32


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def _spread(n: Column) -> Column:
    """The bits of a number below 2**24, moved to the even places."""
    n = n.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def morton(x: Column, y: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def _step(value: Column, low: float, span: float, level: Column | int) -> Column:
    """Row or column of a coordinate among 2**level."""
    cells = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
    return F.least(F.floor((value - low) / span * cells), cells - 1).cast("long")


def point_codes(points: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, lat, lon, code) of the points that have a valid position."""
    return points.filter(valid(F.col(lat), F.col(lon))).select(
        key, F.col(lat).alias("lat"), F.col(lon).alias("lon"), morton(_step(F.col(lon), -180, 360, FINEST), _step(F.col(lat), -90, 180, FINEST)).alias("code")
    )


def cover(regions: DataFrame, key: str, lat: str = "lat", lon: str = "lon", radius: str = "radius_m") -> DataFrame:
    """Code ranges of the discs: (key, r_lat, r_lon, r_radius, level, parent, low, high)."""
    base = regions.filter(valid(F.col(lat), F.col(lon)) & (F.col(radius) >= 0)).select(
        key, F.col(lat).alias("r_lat"), F.col(lon).alias("r_lon"), F.col(radius).alias("r_radius")
    )
    # A little wider than the radius, so that rounding never loses a point on the rim.
    angle = F.least(F.col("r_radius") * (1 + 1e-9) / EARTH_M + 1e-9, F.lit(math.pi))
    south, north = F.radians("r_lat") - angle, F.radians("r_lat") + angle
    polar = (south <= -math.pi / 2) | (north >= math.pi / 2)
    half = F.when(polar, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("r_lat")))))))
    boxed = base.withColumns(
        {"s": F.greatest(F.lit(-90.0), F.degrees(south)), "n": F.least(F.lit(90.0), F.degrees(north)), "half": half}
    ).withColumn("level", F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.least(180 / (F.col("n") - F.col("s")), 180 / F.col("half")))) + 2)).cast("int"))
    west, east = F.col("r_lon") - F.col("half"), F.col("r_lon") + F.col("half")
    whole = F.array(F.struct(F.lit(-180.0).alias("w"), F.lit(180.0).alias("e")))
    spans = (
        F.when(F.col("half") >= 180, whole)
        .when(west < -180, F.array(F.struct(F.lit(-180.0).alias("w"), east.alias("e")), F.struct((west + 360).alias("w"), F.lit(180.0).alias("e"))))
        .when(east > 180, F.array(F.struct(west.alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), (east - 360).alias("e"))))
        .otherwise(F.array(F.struct(west.alias("w"), east.alias("e"))))
    )
    cells = (
        boxed.withColumn("span", F.explode(spans))
        .withColumn("x", F.explode(F.sequence(_step(F.col("span.w"), -180, 360, F.col("level")), _step(F.col("span.e"), -180, 360, F.col("level")))))
        .withColumn("y", F.explode(F.sequence(_step(F.col("s"), -90, 180, F.col("level")), _step(F.col("n"), -90, 180, F.col("level")))))
        .select(key, "r_lat", "r_lon", "r_radius", "level", morton(F.col("x"), F.col("y")).alias("cell"))
        .distinct()
    )
    # Islands of consecutive cells under one parent (16 cells) are one range.
    own = Window.partitionBy(key, "level", F.shiftright("cell", 4)).orderBy("cell")
    islands = cells.withColumn("island", F.col("cell") - F.row_number().over(own)).groupBy(
        key, "r_lat", "r_lon", "r_radius", "level", F.shiftright("cell", 4).alias("parent"), "island"
    )
    # Spark has no shift by a column; a power of four does the same.
    width = F.pow(F.lit(4.0), FINEST - F.col("level")).cast("long")
    return islands.agg(F.min("cell").alias("a"), F.max("cell").alias("b")).select(
        key, "r_lat", "r_lon", "r_radius", "level", "parent", (F.col("a") * width).alias("low"), ((F.col("b") + 1) * width - 1).alias("high")
    )


def within(points: DataFrame, regions: DataFrame, point_key: str = "file", region_key: str = "seq") -> DataFrame:
    """One row per point and region that holds it: (point_key, region_key, distance_m)."""
    ranges = cover(regions, region_key)
    spark = points.sparkSession
    counted = ranges.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 25 rows
    levels = sorted(r["level"] for r in counted)
    if not levels:
        return spark.createDataFrame([], f"{point_key} {dict(points.dtypes)[point_key]}, {region_key} {dict(regions.dtypes)[region_key]}, distance_m double")
    few = sum(r["n"] for r in counted) <= BROADCAST_RANGES
    placed = point_codes(points, point_key).withColumn(
        "at", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("code", 2 * (FINEST - n) + 4).alias("parent")) for n in levels]))
    ).select(point_key, "lat", "lon", "code", F.col("at.level").alias("level"), F.col("at.parent").alias("parent"))
    on = ["level", "parent"]
    if few:
        ranges = F.broadcast(ranges)
    else:
        on.append("salt")
        placed = placed.withColumn("salt", F.pmod(F.xxhash64(point_key), F.lit(SALTS)).cast("int"))
        ranges = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    metres = distance_m(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon"))
    return (
        placed.join(ranges, on)
        .filter(F.col("code").between(F.col("low"), F.col("high")))
        .filter(metres <= F.col("r_radius"))
        .select(point_key, region_key, metres.alias("distance_m"))
    )
