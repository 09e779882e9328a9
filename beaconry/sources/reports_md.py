"""Report files: Markdown with a flat header and labelled fields.

Parsing is column expressions over the whole text of a file; unknown keys are
ignored, missing ones become empty, and problems are listed instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.grid import first_position
from ..functions.text import link_kind, repaired, trimmed

#: The labels of a report's fields and their columns.
FIELDS = {"Styrka": "styrka", "Slag": "slag", "Sysselsättning": "sysselsattning", "Händelse": "handelse", "Sedan": "sedan", "Ställe": "stalle", "Symbol": "symbol"}
HEADER = ("id", "typ", "tnr", "tidpunkt", "plats", "sagesman")
IMAGE = r"(?i)\.(jpe?g|png|webp)$"


def scan(spark: SparkSession, folder: str, replayed: str = "demo/") -> DataFrame:
    """(file, text) of every Markdown file below a folder, the replay folder left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).filter(~F.col("file").contains(f"/{replayed}"))


def header_of(text: Column) -> Column:
    """The header between the fences; null without one. An empty header counts as none."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    end = F.locate("\n---", unix, 5)
    return F.when(unix.startswith("---\n") & (end > 0), F.substring(unix, F.lit(5), end - 5))


def body_of(text: Column) -> Column:
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    end = F.locate("\n---", unix, 5)
    after = F.locate("\n", F.substring(unix, end + 1, F.length(unix)))
    rest = F.when(after > 0, F.substring(unix, end + 1 + after, F.length(unix))).otherwise("")
    return F.when(unix.startswith("---\n") & (end > 0), rest).otherwise(unix)


def unquoted(value: Column) -> Column:
    return F.regexp_replace(trimmed(value), r"""^(?:"(.*)"|'(.*)')$""", "$1$2")


def pairs_of(header: Column) -> Column:
    """Keys and values of a flat header, a later key winning. Lines without a colon and comments are skipped."""
    lines = F.filter(F.split(F.coalesce(header, F.lit("")), "\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    entry = lambda x: F.struct(trimmed(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(x, "^[^:]*:", "").alias("value"))
    return F.transform(lines, entry)


def value_of(pairs: Column, key: str) -> Column:
    """The last value of a key, without quotes; null if absent."""
    return unquoted(F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"])


def list_of(value: Column) -> Column:
    """An inline list, split at every comma; a plain value is a list of one."""
    inner = trimmed(F.regexp_replace(value, r"^\[|\]$", ""))
    return F.when(value.rlike(r"^\[.*\]$"), F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), unquoted))).otherwise(F.array(value))


def field_of(body: Column, label: str) -> Column:
    """The last ``**Label:** value`` of a body; null if absent."""
    found = F.regexp_extract_all(body, F.lit(rf"\*\*\s*{label}\s*:\*\*[ \t]*([^\n]*)"), F.lit(1))
    return F.when(F.size(found) > 0, trimmed(F.element_at(found, -1)))


def parse(files: DataFrame) -> DataFrame:
    """Reports of ``files`` (file, text), whatever their type."""
    base = files.select("file", repaired(F.col("text")).alias("text"))
    base = base.select("file", pairs_of(header_of(F.col("text"))).alias("pairs"), body_of(F.col("text")).alias("body"))
    own = {key: F.coalesce(value_of(F.col("pairs"), key), F.lit("")) for key in HEADER}
    number = lambda key: F.nullif(value_of(F.col("pairs"), key), F.lit("")).try_cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    links = F.regexp_extract_all("body", F.lit(r"(!?\[\[[^\]]+?\]\])"), F.lit(1))
    raw = lambda x: trimmed(F.regexp_replace(x, r"^!?\[\[|\]\]$", ""))
    parsed = base.select(
        "file",
        *[c.alias(key) for key, c in own.items()],
        finite(number("lat")).alias("own_lat"),
        finite(number("lon")).alias("own_lon"),
        value_of(F.col("pairs"), "källa").alias("kalla"),
        F.when(F.exists("pairs", lambda p: p["key"] == "bilagor"), list_of(value_of(F.col("pairs"), "bilagor"))).alias("bilagor"),
        value_of(F.col("pairs"), "signal_avsandare_id").alias("signal_avsandare_id"),
        value_of(F.col("pairs"), "signal_tidpunkt").alias("signal_tidpunkt"),
        *[field_of(F.col("body"), label).alias(name) for label, name in FIELDS.items()],
        F.transform(F.filter(links, lambda x: ~x.startswith("!")), lambda x: F.struct(raw(x).alias("raw"), link_kind(raw(x)).alias("kind"))).alias("links"),
        F.transform(F.filter(links, lambda x: x.startswith("!")), raw).alias("embeds"),
    )
    grid = F.coalesce(first_position(F.coalesce("stalle", F.lit(""))), first_position(F.col("plats")))
    have = F.col("own_lat").isNotNull() & F.col("own_lon").isNotNull()
    placed = parsed.withColumn("grid", F.when(~have, grid))
    return placed.select(
        "*", F.coalesce("grid.lat", "own_lat").alias("lat"), F.coalesce("grid.lon", "own_lon").alias("lon"), F.col("grid").isNotNull().alias("coords_from_mgrs")
    ).drop("grid", "own_lat", "own_lon")


def issues(parsed: DataFrame) -> DataFrame:
    """(file, message) of what a report lacks."""
    lacks = F.array_compact(F.array(*[F.when(F.col(k) == "", F.lit(f"missing frontmatter: {k}")) for k in ("id", "tnr")]))
    return parsed.select("file", F.explode(lacks).alias("message"))


def reports(files: DataFrame, photo_plates: DataFrame, confirmed: DataFrame, flagged: DataFrame) -> DataFrame:
    """Reports proper with what operators decided about them; the decisions are (file, plate), (file, key, label, weight) and (file)."""
    plates = photo_plates.groupBy("file").agg(F.array_sort(F.collect_set("plate")).alias("photo_plates"))
    flag = flagged.select("file", F.lit("operatörsflagga").alias("key"), F.lit("flaggad av operatör").alias("label"), F.lit(V.FLAG_WEIGHT).alias("weight")).distinct()
    shown = confirmed.select("file", "key", "label", "weight").unionByName(flag).groupBy("file").agg(F.collect_list(F.struct("key", "label", "weight")).alias("confirmed_behaviours"))
    return parse(files).filter(F.col("typ") == V.REPORT_TYPE).join(plates, "file", "left").join(shown, "file", "left")


def map_seed(text: Column) -> Column:
    """(lat, lon) of a note that only marks a position: a location in its header, no type and no generator."""
    pairs = pairs_of(header_of(text))
    names = F.transform(pairs, lambda p: p["key"])
    bare = F.regexp_replace(value_of(pairs, "location"), r"""[\[\]"'\s]""", "")
    pair = lambda i: F.regexp_extract(bare, r"^(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)$", i).try_cast("double")
    good = ~F.array_contains(names, "typ") & ~F.array_contains(names, "generator") & (F.abs(pair(1)) <= 90) & (F.abs(pair(2)) <= 180)
    return F.when(good, F.struct(pair(1).alias("lat"), pair(2).alias("lon")))


def images(report: DataFrame) -> DataFrame:
    """(file, image) of a report's attachments and embeds that are pictures."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("bilagor", none), F.coalesce("embeds", none)))
    return report.select("file", F.explode(F.filter(both, lambda x: x.rlike(IMAGE))).alias("image"))


def rendered(report: DataFrame) -> DataFrame:
    """(file, text): reports as files, for operators' own observations and for replay."""
    line = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f"{key}: "), c))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    head = [line(k, F.col(k) if k != "tnr" else quoted(F.col(k))) for k in HEADER] + [line("lat", F.col("lat").cast("string")), line("lon", F.col("lon").cast("string"))]
    head += [line("signal_avsandare_id", F.col("signal_avsandare_id")), line("signal_tidpunkt", F.col("signal_tidpunkt"))]
    body = [F.when(F.col(name).isNotNull(), F.concat(F.lit(f"**{label}:** "), F.regexp_replace(F.col(name), r"[\r\n]+", " "))) for label, name in FIELDS.items()]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n"), F.concat_ws("\n\n", *body), F.lit("\n"))
    return report.select("file", text.alias("text"))


def file_names(observations: DataFrame) -> DataFrame:
    """(…, name): TNR names, later ones of the same number with a running suffix."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("tnr").orderBy("tidpunkt", "file"))
    return observations.withColumn("name", F.concat(F.lit("TNR"), "tnr", F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.lit(".md")))
