"""Identifiers of a report from its links, prose, photos and sender (X1-X3), within the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import bounded, link_target, squeezed

SORTED = "struct<type:string,value:string,partial:boolean,turn:int,raw:string,source:string>"
ITEM = "struct<type:string,value:string,partial:boolean,raw:string,source:string,turn:int>"


def _item(type_: str, value: Column, partial: Column, raw: Column, source: str, turn: int) -> Column:
    return F.struct(
        F.lit(type_).alias("type"), value.alias("value"), partial.alias("partial"), raw.alias("raw"), F.lit(source).alias("source"), F.lit(turn).alias("turn")
    )


def prose_items(text: Column, source: str, turn: int) -> Column:
    """Plates, person numbers and grids in prose, as an array."""
    text = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(f"({bounded(pattern)})"), F.lit(1))
    no = F.lit(False)
    person = lambda raw: F.regexp_replace(raw, r"\+", "-")
    return F.concat(
        F.transform(found(V.PLATE_PROSE), lambda raw: _item("plate", squeezed(raw), no, raw, source, turn)),
        F.transform(found(V.PERSON_NUMBER), lambda raw: _item("personnummer", person(raw), no, raw, source, turn)),
        F.transform(found(V.GRID), lambda raw: _item("mgrs", squeezed(raw), no, raw, source, turn)),
    )


def items_of_report() -> Column:
    """All identifiers of a report, a linked one before any other of the same value, else the first met."""
    none = F.array().cast(f"array<{ITEM}>")
    linked = F.transform(
        F.filter(F.coalesce("links", F.array().cast("array<struct<raw:string,kind:string>>")), lambda x: x["kind"].startswith("plate-")),
        lambda x: _item("plate", squeezed(link_target(x["raw"])), x["kind"] == "plate-partial", link_target(x["raw"]), "link", 0),
    )
    photos = F.transform(
        F.filter(F.coalesce("photo_plates", F.array().cast("array<string>")), lambda p: squeezed(p) != ""), lambda p: _item("plate", squeezed(p), F.lit(False), p, "photo", 4)
    )
    sender = F.when(
        F.col("signal_avsandare_id") != "", F.array(_item("sender", F.col("signal_avsandare_id"), F.lit(False), F.col("signal_avsandare_id"), "frontmatter", 5))
    ).otherwise(none)
    return F.concat(
        linked.cast(f"array<{ITEM}>"),
        prose_items(F.col("handelse"), "prose-handelse", 1).cast(f"array<{ITEM}>"),
        prose_items(F.col("stalle"), "prose-stalle", 2).cast(f"array<{ITEM}>"),
        prose_items(F.col("symbol"), "prose-symbol", 3).cast(f"array<{ITEM}>"),
        photos.cast(f"array<{ITEM}>"),
        sender.cast(f"array<{ITEM}>"),
    )


def with_items(reports: DataFrame, *keep: str) -> DataFrame:
    """(file, *keep, items): each report with its distinct identifiers as an array."""
    # Sorted by identity and rank, the first of each run is kept; one pass folds the runs, so nothing is extracted twice.
    ordered = F.array_sort(F.transform(items_of_report(), lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["partial"].alias("partial"), x["turn"].alias("turn"), x["raw"].alias("raw"), x["source"].alias("source"))))
    same = lambda a, b: (a["type"] == b["type"]) & (a["value"] == b["value"]) & (a["partial"] == b["partial"])
    start = F.array().cast(f"array<{SORTED}>")
    runs = F.aggregate(ordered, start, lambda done, x: F.when((F.size(done) > 0) & same(F.element_at(done, -1), x), done).otherwise(F.array_append(done, x)))
    return reports.select("file", *keep, runs.alias("items"))


def identifiers(reports: DataFrame) -> DataFrame:
    """One row per report and identifier: (file, type, value, partial, raw, source)."""
    return with_items(reports).select("file", F.inline_outer("items")).filter(F.col("type").isNotNull()).drop("turn")


def plates(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per report and plate: (file, *keep, plate, partial, source)."""
    rows = with_items(reports, *keep).select("file", *keep, F.explode_outer("items").alias("i")).filter("i.type = 'plate'")
    return rows.select("file", *keep, F.col("i.value").alias("plate"), F.col("i.partial").alias("partial"), F.col("i.source").alias("source"))


def prose_plates(reports: DataFrame) -> DataFrame:
    """(file, plate, source) of every plate a report links and every one its prose names, once each."""
    rows = reports.select("file", F.inline_outer(items_of_report())).filter((F.col("type") == "plate") & (F.col("turn") <= 3))
    return rows.select("file", F.col("value").alias("plate"), F.when(F.col("turn") == 0, "link").otherwise("prose").alias("source")).distinct()
