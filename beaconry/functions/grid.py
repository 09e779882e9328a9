"""Military grid references as positions, in column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import bounded, half_up

COLUMNS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
ROWS = "ABCDEFGHJKLMNPQRSTUV"
BANDS = "CDEFGHJKLMNPQRSTUVWX"
#: The least northing of each latitude band, in km.
BAND_NORTHING_KM = (1100, 2000, 2800, 3700, 4600, 5500, 6400, 7300, 8200, 9100, 0, 800, 1500, 2300, 3300, 4100, 4800, 5500, 6300, 7000)
#: Fixed values of the ellipsoid and the projection.
A, E2, K0 = 6378137.0, 0.00669438, 0.9996


def _geographic(zone: Column, northern: Column, easting: Column, northing: Column) -> Column:
    """Inverse transverse Mercator (Snyder's series) as a struct of lat and lon."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    ep2 = E2 / (1 - E2)
    y = northing - F.when(northern, 0.0).otherwise(10_000_000.0)
    mu = y / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    series = ((3 * e1 / 2 - 27 * e1**3 / 32, 2), (21 * e1**2 / 16 - 55 * e1**4 / 32, 4), (151 * e1**3 / 96, 6))

    def at_foot(phi: Column) -> Column:
        sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
        curve = 1 - E2 * sin * sin
        n, r = A / F.sqrt(curve), A * (1 - E2) / F.pow(curve, 1.5)
        t, c = tan * tan, ep2 * cos * cos
        d = (easting - 500_000.0) / (n * K0)
        lat = phi - n * tan / r * (
            d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720
        )
        lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / cos
        return F.struct(F.degrees(lat).alias("lat"), ((zone - 1) * 6 - 177 + F.degrees(lon)).alias("lon"))

    foot = F.transform(F.array(mu), lambda m: m + sum((F.sin(m * k) * w for w, k in series), F.lit(0.0)))
    return F.transform(foot, at_foot)[0]


def position(grid: Column) -> Column:
    """(lat, lon) of a grid reference, null when it is none or has an odd number of digits."""
    text = F.upper(F.regexp_replace(grid, r"\s+", ""))
    shape = r"^(\d{1,2})([C-X])([A-Z])([A-Z])(\d+)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    zone, digits = part(1).try_cast("int"), part(5)
    half = (F.length(digits) / 2).cast("int")
    scale = F.pow(F.lit(10.0), 5 - half)
    # Column letters run in three sets of eight; row letters start five later in even zones.
    column = F.instr(F.lit(COLUMNS), part(3))
    column = F.pmod(column - 1 - 8 * F.pmod(zone - 1, F.lit(3)), F.lit(24)) + 1
    row = F.instr(F.lit(ROWS), part(4))
    north = F.pmod(row - 1 - F.when(zone % 2 == 0, 5).otherwise(0), F.lit(20)) * 100_000
    band = F.instr(F.lit(BANDS), part(2))
    least = F.element_at(F.array(*[F.lit(k * 1000) for k in BAND_NORTHING_KM]), F.greatest(band, F.lit(1)))
    north = north + F.ceil(F.greatest(least - north, F.lit(0)) / 2_000_000) * 2_000_000
    easting = column * 100_000 + F.substring(digits, F.lit(1), half).try_cast("double") * scale
    northing = north + F.substring(digits, half + 1, half).try_cast("double") * scale
    good = text.rlike(shape) & zone.between(1, 60) & (F.length(digits) % 2 == 0) & (row > 0) & (band > 0) & (F.length(digits) <= 18)
    return F.when(good, _geographic(zone, part(2) >= "N", easting, northing))


def coordinate(text: Column) -> Column:
    """(lat, lon) that a person typed or pasted: a pair, one after ``geo:`` or ``location:``, or a grid reference; else null."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    number = r"(-?\d+(?:\.\d+)?)"
    shapes = (rf"geo:\s*{number}\s*,\s*{number}", rf'location:\s*"?{number}\s*,\s*{number}"?', rf"^{number}\s*,\s*{number}$")
    pair = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(bare, s, i), F.lit("")) for s in shapes]).try_cast("double")
    at = position(bare)
    return F.when(pair(1).isNotNull() & pair(2).isNotNull(), F.struct(pair(1).alias("lat"), pair(2).alias("lon"))).otherwise(
        F.transform(F.array(at), lambda p: F.when(p.isNotNull(), F.struct(half_up(p["lat"], 5).alias("lat"), half_up(p["lon"], 5).alias("lon"))))[0]
    )


def first_position(text: Column) -> Column:
    """(lat, lon), to five decimals, of the first grid reference in a text; no later one is tried."""
    found = position(F.nullif(F.regexp_extract(text, bounded(V.GRID), 0), F.lit("")))
    return F.transform(F.array(found), lambda p: F.when(p.isNotNull(), F.struct(half_up(p["lat"], 5).alias("lat"), half_up(p["lon"], 5).alias("lon"))))[0]
