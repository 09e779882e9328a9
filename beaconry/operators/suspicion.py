"""An explained score per report (J6, AG9, AG10).

Reasons are kept as an array in a fixed order: proximity, time of day, behaviour,
confirmed behaviour, craft. Proximity looks at the protected object and at every
sensitive place, whose reach is found by spatial cells rather than by comparing
all pairs, and counts once: the heaviest band, then the nearest anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import first_stem, half_up, hour_of, quoted
from . import cells
from .craft import kinds, prose

REASONS = "array<struct<key:string,label:string,weight:int>>"


def _reason(key: Column | str, label: Column | str, weight: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(key).alias("key"), lit(label).alias("label"), lit(weight).cast("int").alias("weight"))


def anchors(places: DataFrame) -> DataFrame:
    """The protected object and the sensitive places, with the reach of their widest band."""
    spark = places.sparkSession
    own = spark.range(1).select(
        F.lit(-1).alias("seq"), F.lit("objektet").alias("name"), F.lit(V.OBJECT_LAT).alias("lat"), F.lit(V.OBJECT_LON).alias("lon"), F.array(*map(F.lit, V.OBJECT_BANDS_M)).alias("bands")
    )
    radius = F.greatest(F.lit(1.0), F.col("radius_m"))
    sensitive = places.filter(F.col("sensitive") & F.col("radius_m").isNotNull()).select(
        "seq", "name", "lat", "lon", F.array(*[radius * f for f in V.SENSITIVE_FACTORS]).alias("bands")
    )
    return own.unionByName(sensitive).withColumn("radius_m", F.col("bands")[2])


def proximity(reports: DataFrame, places: DataFrame) -> DataFrame:
    """(file, near): the one proximity reason of each report within any anchor's bands."""
    known = anchors(places)
    reach = cells.within(reports.select("file", "lat", "lon"), known, "file", "seq")
    d, bands = F.col("distance_m"), F.col("bands")
    weight = F.when(d < bands[0], V.BAND_WEIGHTS[0]).when(d < bands[1], V.BAND_WEIGHTS[1]).when(d < bands[2], V.BAND_WEIGHTS[2])
    own = F.col("seq") == -1
    metres = F.concat(F.lit(" (~"), half_up(d).cast("long").cast("string"), F.lit(" m)"))
    place = F.when(own, F.lit("objektet")).otherwise(F.col("name"))
    words = F.when(weight == 3, F.concat(F.lit("nära "), place)).when(
        weight == 2, F.when(own, F.lit("i närområdet")).otherwise(F.concat(F.lit("i närområdet av "), place))
    ).otherwise(F.when(own, F.lit("i vidare område")).otherwise(F.concat(F.lit("i vidare område kring "), place)))
    reason = _reason(F.when(own, "proximity").otherwise("känslig-plats"), F.concat(words, metres), weight)
    told = reach.join(known.select("seq", "name", "bands"), "seq").filter(weight.isNotNull())
    return told.groupBy("file").agg(F.max_by(reason, F.struct(weight, -d, -F.col("seq"))).alias("near"))


def _by_text() -> Column:
    """Behaviour reasons; expects a column ``said``, the lower-case event and symbol."""
    found = []
    for i in V.INDICATORS:
        label = f"concat({quoted(f'hotindikator: {i.label} (')}, '\"', {first_stem('said', i.stems)}, '\")')"
        found.append(f"named_struct('key', {quoted(f'beteende:{i.key}')}, 'label', {label}, 'weight', {i.weight})")
    # Without a stem there is no label.
    return F.expr(f"filter(array({', '.join(found)}), r -> r.label is not null)")


def _by_time() -> Column:
    hour = hour_of(F.col("tidpunkt"))
    at = F.concat(F.lit(" (kl "), F.lpad(hour.cast("string"), 2, "0"), F.lit(")"))
    return F.when((hour >= 22) | (hour < 5), _reason("natt", F.concat(F.lit("nattaktivitet"), at), 2)).when(
        (hour < 7) | (hour >= 21), _reason("skymning", F.concat(F.lit("gryning/skymning"), at), 1)
    )


def score(reports: DataFrame, places: DataFrame) -> DataFrame:
    """(file, tnr, tidpunkt, plats, sagesman, lat, lon, score, reasons) of every report."""
    said = F.lower(F.concat(F.coalesce("handelse", F.lit("")), F.lit(" "), F.coalesce("symbol", F.lit(""))))
    base = reports.select(
        "file", "tnr", "tidpunkt", "plats", "sagesman", "lat", "lon", "confirmed_behaviours", said.alias("said"), F.lower(prose()).alias("things")
    ).join(proximity(reports, places), "file", "left")
    keyed = lambda list_: F.transform(list_, lambda r: r["key"])
    base = base.withColumns({"text_reasons": _by_text(), "craft_kinds": F.filter(kinds("things"), lambda k: k["threat"] > 0), "hour_reason": _by_time()})
    confirmed = F.coalesce(F.col("confirmed_behaviours").cast(REASONS), F.array().cast(REASONS))
    by_craft = F.transform("craft_kinds", lambda k: _reason(F.concat(F.lit("farkost:"), k["type"]), F.concat(F.lit("farkost: "), k["type"]), k["threat"]))
    first = F.concat(F.array_compact(F.array("near", "hour_reason")).cast(REASONS), F.col("text_reasons").cast(REASONS))
    base = base.withColumn("first", first)
    # Of confirmed behaviours with one key, the first counts, and none that the text already shows.
    once = F.filter(confirmed, lambda r, i: ~F.array_contains(keyed("first"), r["key"]) & ~F.array_contains(F.slice(keyed(confirmed), F.lit(1), i), r["key"]))
    base = base.withColumn("second", F.concat("first", once))
    rest = F.filter(by_craft.cast(REASONS), lambda r: ~F.array_contains(keyed("second"), r["key"]))
    reasons = base.withColumn("reasons", F.concat("second", rest))
    total = F.aggregate("reasons", F.lit(0), lambda s, r: s + F.coalesce(r["weight"], F.lit(0)))
    return reasons.select("file", "tnr", "tidpunkt", "plats", "sagesman", "lat", "lon", total.alias("score"), "reasons")


def elevated(scored: DataFrame, threshold: int = V.ELEVATED_FROM) -> DataFrame:
    return scored.filter(F.col("score") >= threshold)


def rollup(scored: DataFrame) -> DataFrame:
    """One row: reports, elevated ones, ones right by an anchor."""
    near = F.exists("reasons", lambda r: r["key"].isin("proximity", "känslig-plats"))
    return scored.agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col("score") >= V.ELEVATED_FROM).alias("elevated"), F.count_if(near).alias("near"))
