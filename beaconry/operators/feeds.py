"""Alerts, the feed and the watch list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import bare_grid, reason_phrases, trimmed
from ..functions.instants import epoch_seconds

#: The time of the first pinned row; the others come right below it.
PINNED = 2**53 - 1
#: What follows an actor's, a mark's, a picture's and a text's pending row.
PINNED_KINDS = 4


def alerts(elevated: DataFrame, actors: DataFrame, nominations: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(key, kind, title, rank) of everything worth an alert now."""
    close = F.filter("reasons", lambda r: r["key"].isin("proximity", "känslig-plats") & (r["weight"] == 3))
    near = F.regexp_replace(F.get(close, F.lit(0))["label"], r"\s*\(~\d+\s*m\)", "")
    title = F.concat(F.lit("Misstänkt aktivitet"), F.coalesce(F.concat(F.lit(" — "), near), F.lit("")), F.lit(" — "), F.coalesce("plats", F.lit("")))
    row = lambda key, kind, text, rank: (key.alias("key"), F.lit(kind).alias("kind"), text.alias("title"), rank.cast("long").alias("rank"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = lambda c: F.col(c).cast("string")
    return (
        elevated.select(*row(text("förhöjd:", F.col("file")), "förhöjd", title, F.col("score") + 100))
        .unionByName(
            actors.select(*row(text("aktör:", F.col("id")), "aktör", text("Aktörsförslag: ", n("vehicles"), " fordon + ", n("marks"), " kännetecken"), F.col("facets") + 80))
        )
        .unionByName(
            nominations.select(
                *row(text("märke:", F.col("signature")), "märke", text("Återkommande kännetecken: ", F.col("label"), " (", n("count"), " observationer)"), F.col("count") + 60)
            )
        )
        .unionByName(
            vehicles.filter("count > 1").select(
                *row(text("fordon:", F.col("canonical")), "fordon", text("Återkommande fordon ", F.col("canonical"), " (", n("count"), " observationer)"), F.col("count") + 40)
            )
        )
    )


def unseen(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Alerts whose key was never seen."""
    return current.join(seen.select("key").filter(F.col("key").isNotNull()), "key", "left_anti")


def feed(items: DataFrame, most: int = V.FEED_ROWS) -> DataFrame:
    """The newest items, one per path (of equal times the first by seq, then kind): (path, kind, time, seq), in order of time, seq and path."""
    newest = items.groupBy("path").agg(F.min_by(F.struct(*[c for c in items.columns if c != "path"]), F.struct(-F.col("time"), "seq", "kind")).alias("x")).select("path", "x.*")
    return newest.orderBy(F.col("time").desc(), "seq", "path").limit(most)


def report_items(reports: DataFrame, elevated: DataFrame) -> DataFrame:
    """Feed items of reports: an alarm for an elevated one, else its arrival."""
    hot = elevated.select("file", F.lit(True).alias("hot"))
    time = F.coalesce(epoch_seconds(F.col("tidpunkt")), F.lit(0).cast("long"))
    rows = reports.select("file", time.alias("time")).join(hot, "file", "left")
    return rows.select(F.col("file").alias("path"), F.when(F.col("hot"), "larm").otherwise("mottaget").alias("kind"), "time", F.lit(0).cast("long").alias("seq"))


def _items(rows: DataFrame, path: Column, kind: Column | str, time: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(path.alias("path"), kind.alias("kind"), F.coalesce(time, F.lit(0)).cast("long").alias("time"), F.lit(0).cast("long").alias("seq"))


def _note(name: Column) -> Column:
    """The file of an entity's note."""
    return F.concat(F.regexp_replace(name, r'[\\/:*?"<>|.\s]', "_"), F.lit(".md"))


def vehicle_items(vehicles: DataFrame) -> DataFrame:
    """Feed items of identified vehicles, at their last sighting."""
    return _items(vehicles, _note(F.col("canonical")), "fordon", epoch_seconds(F.col("last_seen")))


def confirmed_items(found: DataFrame, decisions: DataFrame, kind: str) -> DataFrame:
    """Feed items of marks or actors (ref, last_seen) whose decision (ref, decision) is ``confirmed``."""
    yes = decisions.filter("decision = 'confirmed'").select("ref").distinct()
    return _items(found.join(yes, "ref", "left_semi"), _note(F.col("ref")), kind, epoch_seconds(F.col("last_seen")))


def watch_items(watched: DataFrame) -> DataFrame:
    """Feed items of watched things with new activity, of ``watch``; the thing's own row stays."""
    return _items(watched.filter("fresh > 0"), F.concat_ws(":", F.lit("bevakad"), "kind", "ref"), "bevakad", epoch_seconds(F.col("last_seen")))


def pending_items(waiting: DataFrame, kind: str, place: int, decisions: DataFrame | None = None) -> DataFrame:
    """The pinned row of suggestions (ref) without a decision (ref, decision), if there are any: actors 0, marks 1, pictures 2, texts 3."""
    review = {"förslag-aktör": "actors", "förslag-märke": "marks", "förslag-bild": "photos", "förslag-text": "texts"}[kind]
    # A decision taken back is blank and counts as none.
    rest = waiting if decisions is None else waiting.join(decisions.filter("decision <> ''").select("ref").distinct(), "ref", "left_anti")
    return _items(rest.agg(F.count(F.lit(1)).alias("n")).filter("n > 0"), F.lit(f"review:{review}"), kind, F.lit(PINNED - place))


def pinned_in_turn(rows: DataFrame, prefix: str, kind: str, after: int, most: int = V.FEED_ROWS) -> DataFrame:
    """Pinned items (key, turn) one below the other; more than the feed shows are not numbered, for they'd come below its end."""
    first = rows.orderBy("turn", "key").limit(most)
    nth = F.row_number().over(Window.orderBy("turn", "key")) - 1  # of at most the feed's rows
    return _items(first.withColumn("nth", nth), F.concat(F.lit(prefix), "key"), kind, F.lit(PINNED - after) - F.col("nth"))


def place_items(reports: DataFrame, elevated: DataFrame, plates: DataFrame, named: DataFrame | None = None, running: int = 0, most: int = V.FEED_ROWS) -> DataFrame:
    """Pinned items of grid places with an elevated report or a whole plate that have no name and weren't asked for (place).

    In the order of their first such report; ``running`` rows of analyses come before.
    """
    place = trimmed(F.coalesce("plats", F.lit("")))
    at_grid = reports.select("file", "tnr", "tidpunkt", place.alias("key")).filter(bare_grid(F.col("key")))
    relevant = elevated.select("file").unionByName(plates.filter(~F.col("partial")).select("file")).distinct()
    first = at_grid.join(relevant, "file", "left_semi").groupBy("key").agg(F.min(F.struct(F.coalesce("tidpunkt", F.lit("")), F.coalesce("tnr", F.lit("")), "file")).alias("turn"))
    if named is not None:
        first = first.join(named.select(F.col("place").alias("key")).distinct(), "key", "left_anti")
    return pinned_in_turn(first, "review:place:", "namnge-plats", PINNED_KINDS + running, most)


def running_items(running: DataFrame, kind: str, after: int, most: int = V.FEED_ROWS) -> DataFrame:
    """Pinned items of reports (file) being analysed right now, by file; kind is bildanalys or textanalys."""
    rows = running.select(F.col("file").alias("turn"), F.col("file").alias("key")).distinct()
    return pinned_in_turn(rows, f"{kind}:", kind, after, most)


def labelled(rows: DataFrame) -> DataFrame:
    """Feed rows with the text people read (F16) and how urgent it is: adds (text, severity).

    Expects kind, tnr, plats, label, count and phrases beside the feed's own columns.
    """
    kind, lit = F.col("kind"), F.lit
    at = F.when(F.coalesce("plats", lit("")) != "", F.concat(lit(" — "), "plats")).otherwise("")
    n = F.col("count").cast("string")
    waiting = lambda what: F.concat(n, lit(f" {what} att granska →"))
    texts = {
        "mottaget": F.concat(lit("Meddelande TNR"), F.coalesce("tnr", lit("")), lit(" mottaget"), at),
        "fordon": F.concat(lit("Fordon "), "label", lit(" identifierat"), F.when(F.col("count") > 0, F.concat(lit(" ("), n, lit(" observationer)"))).otherwise("")),
        "kännetecken": F.concat(lit("Kännetecken bekräftat: "), "label"),
        "aktör": F.concat(lit("Aktör bekräftad: "), "label"),
        "larm": F.concat(lit("⚠ Misstänkt aktivitet"), at, F.when(F.col("phrases") != "", F.concat(lit(" ("), "phrases", lit(")"))).otherwise("")),
        "bevakad": F.concat(lit("🔭 Bevakad: "), "label", lit(" — +"), n, lit(" nya observationer")),
        "bildanalys": F.concat(lit("📷 Bild mottagen, analys startad — TNR"), F.coalesce("tnr", lit("?")), at),
        "textanalys": F.concat(lit("📝 Meddelande mottaget, analyseras — TNR"), F.coalesce("tnr", lit("?")), at),
        "förslag-aktör": F.concat(lit("🔗 "), waiting("aktörsförslag")),
        "förslag-märke": F.concat(lit("🎒 "), waiting("kopplingsförslag")),
        "förslag-bild": F.concat(lit("📷 "), waiting("bildfynd")),
        "förslag-text": F.concat(lit("📝 "), waiting("textfynd")),
        "namnge-plats": F.concat(lit("📍 Namnge plats "), "label", lit(" →")),
    }
    text = reduce(lambda done, each: done.when(kind == each[0], each[1]), texts.items(), F.when(lit(False), ""))
    severity = F.when(kind.startswith("förslag") | (kind == "namnge-plats"), "review").when(kind.isin("larm", "bevakad"), kind).otherwise("info")
    return rows.withColumns({"text": text, "severity": severity})


def watch(entries: DataFrame, states: DataFrame) -> DataFrame:
    """(kind, ref, count, last_seen, fresh) of watched things.

    ``entries`` is (kind, ref, baseline), ``states`` (kind, ref, count, last_seen). A
    negative baseline starts at the present count; a single report never gains.
    """
    told = entries.join(states, ["kind", "ref"], "left").select("kind", "ref", "baseline", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("last_seen", F.lit("")).alias("last_seen"))
    fresh = F.when((F.col("kind") == "händelse") | (F.col("baseline") < 0), 0).otherwise(F.greatest(F.lit(0), F.col("count") - F.col("baseline")))
    return told.select("kind", "ref", "count", "last_seen", fresh.alias("fresh"))
