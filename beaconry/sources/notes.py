"""Owned notes: what to write, keep, skip and prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import agent_name, escaped, safe_name, stem_of

#: Ownership is told from the start of a note.
HEAD = 600


def owned(text: Column) -> Column:
    return F.substring(text, 1, HEAD).rlike(rf"(?m)^generator:\s*{V.GENERATOR}\s*$")


def method(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(text, 1, HEAD), r"(?m)^metod:\s*(\S+)\s*$", 1), F.lit(""))


def upsert(current: DataFrame, desired: DataFrame, metod: str) -> DataFrame:
    """(path, action, text) that takes ``current`` (path, text) to ``desired`` (path, text).

    A path is written if absent, blank or owned and different, unchanged if equal,
    skipped if someone else's; an owned note of the same method that is no longer
    desired is pruned. Everything else is left alone and not listed.
    """
    both = current.select("path", F.col("text").alias("old")).join(desired.select("path", F.col("text").alias("new")), "path", "full")
    ours = F.col("old").isNull() | (F.trim("old") == "") | owned(F.col("old"))
    action = (
        F.when(F.col("new").isNull(), F.when(owned(F.col("old")) & (method(F.col("old")) == metod), "pruned"))
        .when(F.col("old") == F.col("new"), "unchanged")
        .when(ours, "written")
        .otherwise("skipped")
    )
    return both.select("path", action.alias("action"), F.when(action == "written", F.col("new")).alias("text")).filter(F.col("action").isNotNull())


def applied(current: DataFrame, actions: DataFrame) -> DataFrame:
    """The notes after the actions."""
    changed = actions.filter(F.col("action").isin("written", "pruned"))
    return current.select("path", "text").join(changed.select("path"), "path", "left_anti").unionByName(changed.filter("action = 'written'").select("path", "text"))


#: The note of the protected object, which others link so that none stands alone.
AREA = "Objektet"
AREA_LINK = f"**Operationsområde:** [[{AREA}]]"


def note(metod: str, kind: str, tag: str, title: Column, head: Column, lines: Column) -> Column:
    """The text of an owned note: header, title, an array of facts and an array of lines."""
    front = f"---\ntyp: {kind}\ngenerator: {V.GENERATOR}\nmetod: {metod}\ntags: [{tag}]\n---\n\n# "
    return F.concat(F.lit(front), escaped(title), F.lit("\n\n"), F.array_join(F.filter(head, lambda x: x.isNotNull()), "\n"), F.lit("\n\n## Observationer\n"), F.array_join(lines, "\n"), F.lit("\n"))


def fact(name: str, value: Column) -> Column:
    """A line of the head, null when there is nothing to tell."""
    return F.when(value != "", F.concat(F.lit(f"**{name}:** "), value))


def link(stem: Column, shown: Column) -> Column:
    return F.concat(F.lit("[["), stem, F.lit("|"), escaped(shown), F.lit("]]"))


def citation(file: Column, number: Column) -> Column:
    return F.concat(F.lit("[["), stem_of(file), F.lit("|TNR"), escaped(F.coalesce(number, F.lit(""))), F.lit("]]"))


def seen(extra: Column | None = None) -> Column:
    """An observation as a line: citation, time and place."""
    told = F.concat(F.lit("- "), citation(F.col("file"), F.col("tnr")), F.lit(" — "), escaped(F.coalesce("tidpunkt", F.lit(""))), F.lit(" — "), escaped(F.coalesce("plats", F.lit(""))))
    return told if extra is None else F.concat(told, F.coalesce(extra, F.lit("")))


def lined(rows: DataFrame, line: Column, *key: str) -> DataFrame:
    """(*key, n, span, lines): the observations of a note (O1: by time, number and file); a note is one text, whatever its size."""
    order = F.struct(F.coalesce("tidpunkt", F.lit("")).alias("t"), F.coalesce("tnr", F.lit("")).alias("u"), "file", line.alias("line"))
    time = F.nullif(F.col("tidpunkt"), F.lit(""))
    grouped = rows.groupBy(*key).agg(F.array_sort(F.collect_list(order)).alias("o"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min(time), F.lit("")).alias("first"), F.coalesce(F.max(time), F.lit("")).alias("last"))
    return grouped.select(*key, "n", F.concat("first", F.lit(" → "), "last").alias("span"), F.transform("o", lambda x: x["line"]).alias("lines"))


def _count() -> Column:
    return fact("Antal observationer", F.col("n").cast("string"))


def path(name: Column) -> Column:
    return F.concat(name, F.lit(".md")).alias("path")


def vehicle_notes(observations: DataFrame, entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Notes of vehicles: sightings as they were read, observers, partials merged into them or plates they may be (K3).

    Lists of plates and observers are longer than the planner takes them for, so they are shuffled and never broadcast.
    """
    as_read = F.when(F.col("as_read") != F.col("canonical"), F.concat(F.lit("  — sedd som `"), "as_read", F.lit("`")))
    may_be = candidates.groupBy(F.col("partial").alias("canonical")).agg(F.array_join(F.array_sort(F.collect_set("plate")), ", ").alias("may_be"))
    rows = lined(observations, seen(as_read), "canonical", "kind").join(entities.select("canonical", "kind", "observers", "resolved").hint("merge"), ["canonical", "kind"]).join(may_be.hint("merge"), "canonical", "left")
    head = F.array(
        fact("Slag", F.col("kind")), _count(), fact("Tidsspann", F.col("span")), fact("Sagesmän", F.array_join("observers", ", ")), fact("Partiella observationer", F.array_join("resolved", ", ")),
        F.when(F.col("kind") == "fordon-reg-partiell", F.coalesce(fact("Möjliga registreringsnummer", F.col("may_be")), F.lit("_Ingen matchande fullständig regplåt observerad._"))),
    )
    return rows.select(path(safe_name(F.col("canonical"))), note("jobb-a", "entitet", "fordon", F.col("canonical"), head, F.col("lines")).alias("text"))


def mark_notes(members: DataFrame, nominated: DataFrame) -> DataFrame:
    """Notes of confirmed marks (K4)."""
    rows = lined(members, seen(), "signature").join(nominated.select("signature", "object", "label", "observers"), "signature")
    head = F.array(fact("Kategori", F.col("object")), _count(), fact("Tidsspann", F.col("span")), fact("Sagesmän", F.array_join("observers", ", ")), F.lit(AREA_LINK))
    return rows.select(path(safe_name(F.col("signature"))), note("jobb-b", "entitet", "kännetecken", F.col("label"), head, F.col("lines")).alias("text"))


def suspect_notes(sightings: DataFrame, suspects: DataFrame) -> DataFrame:
    """Notes of suspects; one that is a vehicle links the vehicle's note, another one the area's (K6)."""
    rows = lined(sightings, seen(), "agent").join(suspects.select("agent", "kind", "label", "level"), "agent")
    own = F.when(F.col("kind") == "fordon", fact("Fordon", link(safe_name(F.col("label")), F.col("label")))).otherwise(F.lit(AREA_LINK))
    head = F.array(fact("Bedömd nivå", F.col("level")), _count(), fact("Tidsspann", F.col("span")), own)
    return rows.select(path(agent_name(F.concat(F.lit("⚠️ "), "label"), F.col("agent"))), note("larm", "misstänkt", "larm", F.concat(F.lit("⚠️ "), "label"), head, F.col("lines")).alias("text"))


def place_stem(place: Column) -> Column:
    """The name of a place's note."""
    return agent_name(F.concat(F.lit("📍 "), place), F.concat(F.lit("plats:"), place))


def recurrence_stem(entity: Column, entity_stem: Column, place: Column, n: Column) -> Column:
    """The name of the note of an entity that came back to a place; told apart by both notes' names, not by how often."""
    shown = F.concat(F.lit("🔁 "), entity, F.lit(" ×"), n.cast("string"), F.lit(" · "), place)
    return agent_name(shown, F.concat(entity_stem, F.lit("@@"), place_stem(place)))


def routes(claimed: DataFrame, recurring: DataFrame) -> DataFrame:
    """(place, file, plate, stem): what a plate in a place's report links: the recurrence's note if it came back, else the vehicle's."""
    rows = claimed.select("place", "file", F.explode("plates").alias("plate")).join(recurring.select("place", "plate", "n"), ["place", "plate"], "left")
    stem = F.when(F.col("n").isNotNull(), recurrence_stem(F.col("plate"), safe_name(F.col("plate")), F.col("place"), F.col("n"))).otherwise(safe_name(F.col("plate")))
    return rows.select("place", "file", "plate", stem.alias("stem"))


def place_notes(claimed: DataFrame, located: DataFrame, routed: DataFrame) -> DataFrame:
    """Notes of places with the vehicles seen there, elevated reports marked (K7); a place without reports gets one too."""
    plates = routed.groupBy("place", "file").agg(F.array_join(F.array_sort(F.collect_set(link(F.col("stem"), F.col("plate")))), ", ").alias("linked"))
    line = F.concat(
        F.lit("- "), F.when(F.col("elevated"), "⚠ ").otherwise(""), citation(F.col("file"), F.col("tnr")), F.lit(" — "), escaped(F.coalesce("tidpunkt", F.lit(""))), F.coalesce(F.concat(F.lit(" — "), "linked"), F.lit(""))
    )
    rows = located.select("place", "predefined", F.col("elevated").alias("hot")).join(lined(claimed.join(plates, ["place", "file"], "left"), line, "place"), "place", "left")
    count = F.coalesce("n", F.lit(0)).cast("string")
    head = F.array(fact("Rapporter", count), fact("Misstänkta observationer", F.col("hot").cast("string")), F.when(F.col("predefined"), AREA_LINK))
    lines = F.coalesce("lines", F.array(F.lit("_Inga observationer ännu._")))
    return rows.select(path(place_stem(F.col("place"))), note("plats", "plats", "plats", F.concat(F.lit("📍 "), "place"), head, lines).alias("text"))


def recurrence_notes(pairs: DataFrame) -> DataFrame:
    """Notes of entities that came back to a place: pairs are (kind, entity, entity_stem, place, n) (K8)."""
    stem = recurrence_stem(F.col("entity"), F.col("entity_stem"), F.col("place"), F.col("n"))
    title = F.concat(F.lit("🔁 "), "entity", F.lit(" ×"), F.col("n").cast("string"), F.lit(" · "), "place")
    head = F.array(F.concat(F.when(F.col("kind") == "fordon", "**Fordon:** ").otherwise("**Aktör:** "), link(F.col("entity_stem"), F.col("entity"))), fact("Plats", link(place_stem(F.col("place")), F.col("place"))), fact("Antal observationer här", F.col("n").cast("string")))
    return pairs.select(path(stem), note("aterkomst", "återkomst", "återkomst", title, head, F.array().cast("array<string>")).alias("text"))


def actor_notes(held: DataFrame, chain: DataFrame, counted: DataFrame, near: DataFrame, placed: DataFrame) -> DataFrame:
    """Notes of actors (K5): facets, and messages with the place they name and the one whose reach they lie in.

    ``counted`` is (actor, vehicles, marks), ``near`` (file, near), ``placed`` (place) of places that have a note.
    """
    facets = held.groupBy("actor").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), escaped(F.col("facet"))))), "\n").alias("facets"))
    named = chain.withColumn("place", F.trim(F.coalesce("plats", F.lit("")))).join(placed.select("place", F.lit(True).alias("known")), "place", "left").join(near, "file", "left")
    at = F.when(F.col("known"), link(place_stem(F.col("place")), F.col("place"))).otherwise(escaped(F.col("place")))
    close = F.when(F.col("near").isNotNull(), F.concat(F.lit(" _(nära "), link(place_stem(F.col("near")), F.col("near")), F.lit(")_")))
    line = F.concat(F.lit("- "), citation(F.col("file"), F.col("tnr")), F.lit(" — "), escaped(F.coalesce("tidpunkt", F.lit(""))), F.lit(" — "), at, F.coalesce(close, F.lit("")))
    rows = lined(named, line, "actor").join(counted, "actor").join(facets, "actor")
    told = F.concat(F.col("vehicles").cast("string"), F.lit(" fordon, "), F.col("marks").cast("string"), F.lit(" kännetecken"))
    head = F.array(told, fact("Tidsspann", F.col("span")), F.lit("## Facetter"), F.col("facets"))
    return rows.select(path(agent_name(F.concat(F.lit("🕸️ "), "actor"), F.col("actor"))), note("aktor", "entitet", "aktör", F.concat(F.lit("🕸️ "), "actor"), head, F.col("lines")).alias("text"))


def text_mark_notes(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Notes of marks read from free text (K9): members are (key, file, tnr, tidpunkt, plats, label), clusters (key, label)."""
    named = members.join(clusters.select("key", F.col("label").alias("shown")), "key")
    other = F.when(F.col("label") != F.col("shown"), F.concat(F.lit(" — ”"), escaped(F.col("label")), F.lit("”")))
    rows = lined(named, seen(other), "key", "shown")
    return rows.select(path(agent_name(F.concat(F.lit("🎒 "), "shown"), F.concat(F.lit("textmark:"), "key"))), note("textmarke", "entitet", "kännetecken", F.concat(F.lit("🎒 "), "shown"), F.array(_count(), F.lit(AREA_LINK)), F.col("lines")).alias("text"))


def area_note(spark: SparkSession, lat: float = V.OBJECT_LAT, lon: float = V.OBJECT_LON, name: str = "") -> DataFrame:
    """The note of the protected object (K9)."""
    head = F.array(fact("Operation", F.lit(name)), F.lit(f"**Koordinat:** {lat}, {lon}"))
    return spark.range(1).select(path(F.lit(AREA)), note("objektet", "objektet", "objektet", F.lit(f"🎯 {AREA}"), head, F.array().cast("array<string>")).alias("text"))


def shown_on_map(notes: DataFrame) -> DataFrame:
    """Notes that the map view asks for by their tag."""
    tag = F.regexp_extract("text", r"(?m)^tags: \[([^\]]*)\]$", 1)
    return notes.filter(tag.isin("objektet", "larm", "aktör", "fördefinierad", "karta")).select("path")


def unlinked(notes: DataFrame) -> DataFrame:
    """Notes that the graph view hides: ones without a link to anything but messages, which nothing links either."""
    stem = F.regexp_replace("path", r"\.md$", "")
    ends = notes.select(stem.alias("stem"), F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))).alias("to")).filter(~F.col("to").startswith("TNR"))
    tied = ends.select("stem").unionByName(ends.select(F.col("to").alias("stem"))).distinct()
    return notes.select("path", stem.alias("stem")).join(tied, "stem", "left_anti").select("path")


def alert_list(alerts: DataFrame) -> DataFrame:
    """(rank, key, line): alerts as lines of Markdown, heaviest first."""
    return alerts.select("rank", "key", F.concat(F.lit("- **"), escaped(F.col("title")), F.lit("**")).alias("line")).orderBy(F.col("rank").desc(), "key")
