"""Named queries over the core operators, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as V
from ..functions.instants import SQL_EPOCH
from ..operators import actors, cells, craft, delivery, evaluation, feeds, identifiers, late_events, marks, places, suspects, suspicion, vehicles
from ..sources import models, notes, reports_md
from ..session import read_table, stored
from . import checking, derived, questions
from .pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.corrections(read_table(spark, d, "reports"))


def p1_triangle(spark: SparkSession, d: str) -> DataFrame:
    return late_events.triangle(read_table(spark, d, "reports"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.surplus(read_table(spark, d, "reports"))


def p4_new_messages(spark: SparkSession, d: str) -> DataFrame:
    """The new messages of every batch, against what all batches before it stored."""
    return delivery.stored_by_batch(read_table(spark, d, "reports"), "batch_no")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cells.within(read_table(spark, d, "reports"), read_table(spark, d, "predefined_places")).select("file", "seq")


# --- the pipeline over a data folder -----------------------------------------


def reports_of(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "reports")


def places_of(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "predefined_places")


def scored_of(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).scored


def elevated_of(spark: SparkSession, d: str) -> DataFrame:
    return suspicion.elevated(scored_of(spark, d))


def vehicles_of(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).vehicles


def suspects_of(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).suspects


def claims_of(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).claims


def alerts_of(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    return feeds.alerts(whole.elevated, whole.actors, whole.nominations, whole.vehicles)


# --- queries ------------------------------------------------------------------

def _keys() -> Column:
    """The keys of a row's reasons, in their order."""
    return F.array_join(F.transform("reasons", lambda r: r["key"]), ",").alias("keys")


def q_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return identifiers.identifiers(reports_of(spark, d)).select("file", "type", "value", "partial")


def q_plates(spark: SparkSession, d: str) -> DataFrame:
    return identifiers.plates(reports_of(spark, d)).select("file", "plate", "partial")


def q_plate_entities(spark: SparkSession, d: str) -> DataFrame:
    return vehicles_of(spark, d).select("canonical", "kind", "count", "first_seen", "last_seen", F.array_join("observers", ",").alias("observers"))


def q_plate_partials(spark: SparkSession, d: str) -> DataFrame:
    matched = vehicles.partial_matches(identifiers.plates(reports_of(spark, d)))
    return matched.select("partial", "n", F.when(F.col("n") == 1, "merged").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("state"))


def q_craft(spark: SparkSession, d: str) -> DataFrame:
    return craft.craft(reports_of(spark, d)).select("file", "type", "medium", "plated", "threat", "plate")


def q_score(spark: SparkSession, d: str) -> DataFrame:
    return scored_of(spark, d).select("file", "score", _keys())


def q_elevated(spark: SparkSession, d: str) -> DataFrame:
    """Which reports are elevated, and why, the heaviest first."""
    rows = elevated_of(spark, d).select("file", "tnr", "tidpunkt", "score", text.level(F.col("score")).alias("level"), _keys())
    return rows.orderBy(F.col("score").desc(), "tidpunkt", "tnr")


def q_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Elevated reports with the reasons as people read them."""
    return elevated_of(spark, d).select("file", F.array_join(text.reason_phrases(F.col("reasons")), ", ").alias("phrases"))


def q_bands(spark: SparkSession, d: str) -> DataFrame:
    return scored_of(spark, d).groupBy(text.level(F.col("score")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    return suspicion.rollup(scored_of(spark, d))


def q_proximity(spark: SparkSession, d: str) -> DataFrame:
    return suspicion.proximity(reports_of(spark, d), places_of(spark, d)).select("file", "near.key", "near.weight")


def q_marks(spark: SparkSession, d: str) -> DataFrame:
    found = marks.marks(reports_of(spark, d))
    return found.select("file", "object", "signature", "distinctive", F.size("clauses").cast("long").alias("clauses"))


def q_nominations(spark: SparkSession, d: str) -> DataFrame:
    return marks.nominations(marks.marks(reports_of(spark, d))).select("signature", "object", "count", "first_seen", "last_seen")


def q_mark_labels(spark: SparkSession, d: str) -> DataFrame:
    return marks.nominations(marks.marks(reports_of(spark, d))).select("signature", "label", F.array_join("observers", ",").alias("observers"))


def q_suspects(spark: SparkSession, d: str) -> DataFrame:
    return suspects_of(spark, d).select("agent", "kind", "n", "top", "level", "first_seen", "last_seen")


def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    return suspects.hypotheses(suspects_of(spark, d)).select("facet", "vehicles", "marks", "n")


def q_nearest_place(spark: SparkSession, d: str) -> DataFrame:
    near = places.nearest_place(reports_of(spark, d), places_of(spark, d))
    return near.select("file", "seq", text.half_up(F.col("distance_m")).cast("long").alias("metres"))


def q_locations(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).locations.select("place", "reports", "elevated", "plates", "predefined")


def q_vehicle_recurrence(spark: SparkSession, d: str) -> DataFrame:
    return places.vehicle_recurrence(claims_of(spark, d))


def q_facet_edges(spark: SparkSession, d: str) -> DataFrame:
    return actors.edges(Pipeline(spark, d).sighted)


def q_actors(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).tied_actors.select("root", "facets", "vehicles", "marks", F.array_join("types", ",").alias("types"))


def q_actors_2(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d, 2).tied_actors.select("root", "facets", "vehicles", "marks", F.array_join("types", ",").alias("types"))


def q_actor_chains(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    tied = whole.chains.join(whole.tied_actors.select(F.col("id").alias("actor"), "root"), "actor")
    return actors.spans(tied).join(whole.tied_actors.select(F.col("id").alias("actor"), "root"), "actor").select("root", "messages", "first_seen", "last_seen")


def q_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts_of(spark, d).select("kind", "key", "title", "rank")


def q_alerts_new(spark: SparkSession, d: str) -> DataFrame:
    """What is new against a seen-set: here all alerts of the first half of the batches.

    A report's own reasons, plates and marks don't depend on other reports, so they are
    read once for both sides; everything that counts reports is derived for each.
    """
    whole = Pipeline(spark, d)
    middle = F.broadcast(whole.reports.agg(((F.min("batch_no") + F.max("batch_no")) / 2).alias("middle")))
    earlier = stored(whole.reports.join(middle).filter("batch_no <= middle").select("file"))
    seen = Pipeline(spark, d)
    for step in ("reports", "elevated", "plates", "marks", "suspect_sightings"):
        seen.__dict__[step] = getattr(whole, step).join(earlier, "file", "left_semi")
    told = lambda x: feeds.alerts(x.elevated, x.actors, x.nominations, x.vehicles).select("key", "rank")
    return feeds.unseen(told(whole), told(seen))


def _watched(spark: SparkSession, known: DataFrame) -> DataFrame:
    """Vehicles seen three times or more, watched since their second sighting, and one never seen."""
    states = known.select(F.lit("fordon").alias("kind"), F.col("canonical").alias("ref"), "count", "last_seen")
    watched = known.filter("count >= 3").select(F.lit("fordon").alias("kind"), F.col("canonical").alias("ref"), F.lit(2).alias("baseline"))
    never = spark.range(1).select(F.lit("fordon").alias("kind"), F.lit("ZZZ00Z").alias("ref"), F.lit(-1).alias("baseline"))
    return feeds.watch(watched.unionByName(never), states)


def q_watch(spark: SparkSession, d: str) -> DataFrame:
    return _watched(spark, vehicles_of(spark, d))


def q_mojibake(spark: SparkSession, d: str) -> DataFrame:
    reports = reports_of(spark, d)
    return reports.filter(F.col("plats").contains("Ã") | F.col("handelse").contains("Ã")).select("file", text.repaired(F.col("plats")).alias("plats"), text.repaired(F.col("handelse")).alias("handelse"))


def q_text_mark_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Marks of one key in two reports or more; the longest wording names them."""
    return derived.text_mark_clusters(derived.text_mark_members(read_table(spark, d, "text_marks")))


def q_link_kinds(spark: SparkSession, d: str) -> DataFrame:
    links = reports_of(spark, d).select("file", F.posexplode("links").alias("pos", "l"))
    return links.select("file", "pos", text.link_kind(F.col("l.raw")).alias("kind"))


def q_night_window(spark: SparkSession, d: str) -> DataFrame:
    """Reports between 22:00 and 05:00, both ends included."""
    minute = text.minute_of_day(F.col("tidpunkt"))
    return reports_of(spark, d).select("file", minute.alias("minute")).filter(text.in_window(F.col("minute"), 22 * 60, 5 * 60))


def q_observer(spark: SparkSession, d: str) -> DataFrame:
    return reports_of(spark, d).filter(F.upper("sagesman").contains("AQ")).select("file", "sagesman")


def q_search(spark: SparkSession, d: str) -> DataFrame:
    """Reports that mention a word in event, symbol, place or link."""
    term = "skåpbil"
    has = lambda c: F.coalesce(F.lower(c).contains(term), F.lit(False))
    linked = F.coalesce(F.exists("links", lambda x: F.lower(x["raw"]).contains(term)), F.lit(False))
    return reports_of(spark, d).filter(has("handelse") | has("symbol") | has("plats") | linked).select("file")


def q_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of reports, from attachments and embeds."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("bilagor", none), F.coalesce("embeds", none)))
    return reports_of(spark, d).select("file", F.explode(F.filter(both, lambda x: x.rlike(r"(?i)\.(jpe?g|png|webp)$"))).alias("image"))


def q_quiet(spark: SparkSession, d: str) -> DataFrame:
    """Reports that are not elevated."""
    return reports_of(spark, d).select("file").join(elevated_of(spark, d).select("file"), "file", "left_anti")


def q_parse_files(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as files and read again."""
    back = reports_md.parse(reports_md.rendered(reports_of(spark, d)))
    return back.select("file", "tnr", "plats", "sagesman", "typ")


def q_recurring_vehicles(spark: SparkSession, d: str) -> DataFrame:
    """The question for vehicles seen three times or more."""
    return questions.answer(questions.parse("återkommande fordon minst 3"), Pipeline(spark, d).views).select("ref", "n", "tidpunkt")


def q_timeline_larm(spark: SparkSession, d: str) -> DataFrame:
    """The question for a timeline of alarms in the night."""
    asked = questions.parse("tidslinje larm på natten mellan 22 och 5")
    return questions.answer(asked, Pipeline(spark, d).views).select("ref", "n")


def q_place_question(spark: SparkSession, d: str) -> DataFrame:
    """The question for an observer's reports at a place."""
    asked = questions.parse("vilka rapporter från AQ vid Berga")
    return questions.answer(asked, Pipeline(spark, d).views).select("ref")


def q_haversine(spark: SparkSession, d: str) -> DataFrame:
    """How far each place is from the protected object."""
    metres = cells.distance_m(F.lit(V.OBJECT_LAT), F.lit(V.OBJECT_LON), F.col("lat"), F.col("lon"))
    return places_of(spark, d).filter(cells.valid(F.col("lat"), F.col("lon"))).select("seq", text.half_up(metres).cast("long").alias("metres"))


def q_eval_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two groupings of reports, by observer and by delivery batch."""
    rows = reports_of(spark, d).filter(F.col("sagesman").isNotNull())
    by = lambda c: rows.select(F.col("file").alias("item"), F.col(c).cast("string").alias("group"))
    agreed = evaluation.pair_agreement(by("sagesman"), by("batch_no"))
    return agreed.select("pairs_found", "pairs_true", "pairs_both", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def q_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Plates read from pictures against those a report links or names: confirmed, in conflict, or alone."""
    reports = reports_of(spark, d)
    photos = reports.select("file", F.explode("photo_plates").alias("plate")).select("file", text.plate_read(F.col("plate")).alias("plate")).filter("plate <> ''").distinct()
    return models.corroboration(photos, identifiers.prose_plates(reports).select("file", "plate"))


def _vehicle_notes(read: DataFrame) -> DataFrame:
    seen = vehicles.observed(read)
    return notes.vehicle_notes(seen, vehicles.entities(seen), vehicles.candidates(read))


def q_vehicle_notes(spark: SparkSession, d: str) -> DataFrame:
    """What would be written, kept and pruned if the second half of the batches were taken back."""
    reports = reports_of(spark, d)
    middle = F.broadcast(reports.agg(((F.min("batch_no") + F.max("batch_no")) / 2).alias("middle")))
    halved = reports.join(middle).withColumn("early", F.col("batch_no") <= F.col("middle"))
    # Plates are read from the texts once, for both halves.
    read = stored(identifiers.plates(halved, *vehicles.TOLD, "early"))
    return notes.upsert(_vehicle_notes(read), _vehicle_notes(read.filter("early")), "jobb-a").select("path", "action")


def q_demo_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When each report is replayed: its own time at 60 times the speed, never closer than 2 s."""
    from ..streaming.replay import schedule

    return schedule(reports_of(spark, d).select("file", "tnr"), 60.0, 2.0)


_TIMES = f"SELECT file, {SQL_EPOCH.format(c='tidpunkt')} AS e, {SQL_EPOCH.format(c='signal_tidpunkt')} AS s FROM reports"
_CELLS = f"""WITH t AS ({_TIMES}),
c AS (SELECT file, strftime(TIMESTAMP '1970-01-01' + to_seconds(e), '%Y-%m-%dT%H') AS period,
  greatest(CAST(floor((s - (e // 3600 + 1) * 3600 - 900) / 900.0) AS BIGINT) + 1, 0) AS cell FROM t WHERE e IS NOT NULL AND s IS NOT NULL)
"""


_MESSAGES = f"""WITH b AS (SELECT file, received_at, {SQL_EPOCH.format(c='signal_tidpunkt')} AS sent,
  lower(regexp_replace(id, '[^0-9A-Za-z]', '', 'g')) AS i, nullif(lower(regexp_replace(signal_avsandare_id, '[^0-9A-Za-z]', '', 'g')), '') AS s0 FROM reports),
k AS (SELECT file, received_at, sent, coalesce(nullif(regexp_extract(s0, '([0-9a-f]{{32}})$', 1), ''), s0) AS s,
  nullif(regexp_extract(i, '([0-9a-f]{{32}})$', 1), '') AS hex, nullif(regexp_extract(i, '^(?:7s)?0*([0-9]{{1,31}})$', 1), '') AS num FROM b),
m AS (SELECT *, CASE WHEN hex IS NOT NULL THEN 'h:' || hex WHEN num IS NOT NULL AND s IS NOT NULL THEN 'n:' || s || ':' || num END AS msg FROM k),
f AS (SELECT s AS fs, sent AS fsent, arg_min(msg, (received_at, msg)) AS fm FROM m WHERE msg IS NOT NULL AND s IS NOT NULL AND sent IS NOT NULL GROUP BY s, sent),
a AS (SELECT file, received_at, CASE WHEN msg IS NOT NULL OR num IS NOT NULL THEN msg
  WHEN s IS NOT NULL AND sent IS NOT NULL THEN coalesce(fm, 's:' || s || ':' || sent) END AS message FROM m LEFT JOIN f ON fs = s AND fsent = sent),
r AS (SELECT file, message, row_number() OVER (PARTITION BY message ORDER BY received_at NULLS LAST, file NULLS LAST) AS n FROM a)
"""
#: The same with batches before arrival times.
_STORED = (
    _MESSAGES.replace("SELECT file, received_at", "SELECT file, batch_no, received_at")
    .replace("arg_min(msg, (received_at, msg))", "arg_min(msg, (batch_no IS NULL, coalesce(batch_no, 0), received_at IS NULL, coalesce(received_at, TIMESTAMP '1970-01-01'), msg))")
    .replace("SELECT file, message, row_number() OVER (PARTITION BY message ORDER BY", "SELECT file, message, batch_no, row_number() OVER (PARTITION BY message ORDER BY batch_no NULLS LAST,")
)


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_triangle": p1_triangle,
        "p4_found": p4_found,
        "p4_new_messages": p4_new_messages,
        "p6_found": p6_found,
        "identifiers": q_identifiers,
        "plates_only": q_plates,
        "plate_entities": q_plate_entities,
        "plate_partials": q_plate_partials,
        "craft_obs": q_craft,
        "score_all": q_score,
        "score_elevated": q_elevated,
        "reason_phrases": q_reasons,
        "level_bands": q_bands,
        "score_rollup": q_rollup,
        "proximity_band": q_proximity,
        "marks_all": q_marks,
        "mark_nominations": q_nominations,
        "mark_labels": q_mark_labels,
        "suspects": q_suspects,
        "actor_candidates": q_candidates,
        "vicinity_nearest": q_nearest_place,
        "locations": q_locations,
        "recurrence_vehicle": q_vehicle_recurrence,
        "facet_edges": q_facet_edges,
        "actor_components": q_actors,
        "actor_threshold2": q_actors_2,
        "actor_chains": q_actor_chains,
        "alerts_all": q_alerts,
        "alerts_new": q_alerts_new,
        "watch_status": q_watch,
        "mojibake": q_mojibake,
        "text_mark_clusters": q_text_mark_clusters,
        "link_kinds": q_link_kinds,
        "q_time_window": q_night_window,
        "q_observer": q_observer,
        "q_search": q_search,
        "attachments": q_attachments,
        "quiet_reports": q_quiet,
        "demo_schedule": q_demo_schedule,
        "parse_files": q_parse_files,
        "q_recurring_vehicles": q_recurring_vehicles,
        "q_timeline_larm": q_timeline_larm,
        "q_place_question": q_place_question,
        "haversine": q_haversine,
        "eval_pairs": q_eval_pairs,
        "plate_corroboration": q_corroboration,
        "vehicle_notes": q_vehicle_notes,
    } | derived.QUERIES


_BAND = "CASE WHEN score >= 9 THEN 'Hög' WHEN score >= 6 THEN 'Förhöjd' WHEN score >= 5 THEN 'Att bevaka' ELSE '' END"
_ALERTS = """SELECT 'förhöjd' AS kind, 'förhöjd:' || e.file AS key, 'Misstänkt aktivitet' || coalesce(CASE WHEN n.weight = 3 THEN ' — nära ' || n.name END, '') || ' — ' || coalesce(e.plats, '') AS title, CAST(100 + score AS BIGINT) AS rank
  FROM elevated e LEFT JOIN near n ON n.file = e.file
UNION ALL SELECT 'aktör', 'aktör:' || id, 'Aktörsförslag: ' || vehicles || ' fordon + ' || marks || ' kännetecken', 80 + facets FROM allacts
UNION ALL SELECT 'märke', 'märke:' || signature, 'Återkommande kännetecken: ' || label || ' (' || count || ' observationer)', 60 + count FROM noms
UNION ALL SELECT 'fordon', 'fordon:' || canonical, 'Återkommande fordon ' || canonical || ' (' || count || ' observationer)', 40 + count FROM ents WHERE count > 1"""
#: The same over the first half of the batches, as a table of its own.
_FIRST_HALF = "reports AS (SELECT * FROM main.reports WHERE batch_no <= (SELECT (min(batch_no) + max(batch_no)) / 2.0 FROM main.reports)),\n"
_SEEN = checking.actors(f"SELECT key FROM ({_ALERTS})", "near", "noms", "ents").replace("WITH RECURSIVE ", "WITH RECURSIVE " + _FIRST_HALF, 1)


def oracle_sql() -> dict[str, str]:
    sql = checking.sql
    mended = lambda c: "".join("replace(" for _ in _MISREAD) + c + "".join(f", '{m}', '{r}')" for m, r in _MISREAD)
    guard = lambda c: f"CASE WHEN contains({c}, 'Ã') OR contains({c}, 'Â') THEN {mended(c)} ELSE {c} END"
    return {
        "p1_found": _CELLS + "SELECT period, file FROM c WHERE cell >= 1 AND cell < 192",
        "p1_triangle": _CELLS
        + """SELECT period, cell, count(*) AS arrived, CAST(sum(count(*)) OVER (PARTITION BY period ORDER BY cell) AS BIGINT) AS total
FROM c WHERE cell < 192 GROUP BY period, cell""",
        "p4_found": _MESSAGES + "SELECT file FROM r WHERE message IS NOT NULL AND n > 1",
        "p4_new_messages": _STORED + "SELECT file, message, batch_no FROM r WHERE message IS NULL OR n = 1",
        "p6_found": f"""SELECT r.file, p.seq FROM (SELECT file, lat, lon FROM reports WHERE {checking.VALID}) r
JOIN (SELECT * FROM predefined_places WHERE {checking.VALID}) p ON {checking.distance("r", "p")} <= p.radius_m""",
        "identifiers": sql("SELECT file, type, value, partial FROM ids", "ids"),
        "plates_only": sql("SELECT file, plate, partial FROM plates", "plates"),
        "plate_entities": sql("SELECT * FROM ents", "ents"),
        "plate_partials": sql("SELECT partial, n, CASE WHEN n = 1 THEN 'merged' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state FROM fits", "fits"),
        "craft_obs": sql(
            """SELECT c.file, type, medium, plated, threat, CASE WHEN plated AND k = 1 THEN p END AS plate FROM crafts c
LEFT JOIN (SELECT file, count(DISTINCT plate) AS k, min(plate) AS p FROM plates WHERE NOT partial GROUP BY file) w ON w.file = c.file""", "crafts", "plates"),
        "score_all": sql("SELECT file, score, keys FROM scores", "scores"),
        "score_elevated": sql(f"SELECT file, tnr, tidpunkt, score, {_BAND} AS level, keys FROM elevated", "elevated"),
        "level_bands": sql(f"SELECT {_BAND} AS level, count(*) AS n FROM scores GROUP BY 1", "scores"),
        "score_rollup": sql("SELECT count(*) AS reports, count(*) FILTER (WHERE score >= 5) AS elevated, count(*) FILTER (WHERE keys LIKE 'proximity%' OR keys LIKE 'känslig-plats%') AS near FROM scores", "scores"),
        "proximity_band": sql("SELECT file, CASE WHEN seq = -1 THEN 'proximity' ELSE 'känslig-plats' END AS key, weight FROM near", "near"),
        "marks_all": sql("SELECT file, object, signature, distinctive, clauses FROM marks", "marks"),
        "mark_nominations": sql(
            """SELECT signature, min(object) AS object, count(*) AS count, coalesce(min(nullif(tidpunkt, '')), '') AS first_seen, coalesce(max(nullif(tidpunkt, '')), '') AS last_seen
FROM members GROUP BY signature""", "members"),
        "suspects": sql(
            f"SELECT agent, kind, n, top, coalesce(nullif({_BAND.replace('score', 'top')}, ''), 'Att bevaka') AS level, first_seen, last_seen FROM suspects", "suspects"),
        "actor_candidates": sql(
            "SELECT agent AS facet, CAST(kind = 'fordon' AS INT) AS vehicles, CAST(kind <> 'fordon' AS INT) AS marks, n FROM suspects WHERE n > 1 OR behaving", "suspects"),
        "vicinity_nearest": sql("SELECT file, seq, CAST(floor(d + 0.5) AS BIGINT) AS metres FROM covering", "covering"),
        "locations": sql(
            """SELECT coalesce(c.place, p.name) AS place, coalesce(n, 0) AS reports, coalesce(e, 0) AS elevated, coalesce(k, 0) AS plates, p.name IS NOT NULL AS predefined
FROM (SELECT place, count(*) AS n, count(*) FILTER (WHERE elevated) AS e, len(list_distinct(flatten(list(plates)))) AS k FROM claims GROUP BY place) c FULL JOIN predefined_places p ON p.name = c.place""", "claims"),
        "recurrence_vehicle": sql("SELECT place, plate, count(*) AS n FROM (SELECT place, unnest(plates) AS plate FROM claims) GROUP BY place, plate HAVING count(*) >= 2", "claims"),
        "facet_edges": sql("SELECT a, b, weight FROM tied", "tied"),
        "actor_components": checking.actors("SELECT root, facets, vehicles, marks, types FROM acts"),
        "actor_threshold2": checking.actors("SELECT root, facets, vehicles, marks, types FROM acts", least=2),
        "actor_chains": checking.actors("""SELECT a.root, count(*) AS messages, coalesce(min(nullif(tidpunkt, '')), '') AS first_seen, coalesce(max(nullif(tidpunkt, '')), '') AS last_seen
FROM allsteps s JOIN acts a ON a.id = s.actor GROUP BY a.root"""),
        "alerts_all": checking.actors(_ALERTS, "near", "noms", "ents"),
        "alerts_new": checking.actors(f"SELECT key, rank FROM ({_ALERTS}) WHERE key NOT IN (SELECT key FROM ({_SEEN}))", "near", "noms", "ents"),
        "vehicle_notes": f"""WITH held AS ({derived.SQL["notes_vehicle"]}), wanted AS ({derived.SQL["notes_vehicle"].replace("WITH ", "WITH " + _FIRST_HALF, 1)})
SELECT coalesce(h.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'pruned' WHEN h.text = w.text THEN 'unchanged' ELSE 'written' END AS action FROM held h FULL JOIN wanted w ON w.path = h.path""",
        "reason_phrases": sql("SELECT e.file, coalesce(phrases, '') AS phrases FROM elevated e LEFT JOIN phrased USING (file)", "elevated", "phrased"),
        "mark_labels": sql("SELECT signature, label, observers FROM noms", "noms"),
        "watch_status": sql(
            """SELECT 'fordon' AS kind, canonical AS ref, count, last_seen, count - 2 AS fresh FROM ents WHERE count >= 3
UNION ALL SELECT 'fordon', 'ZZZ00Z', coalesce((SELECT count FROM ents WHERE canonical = 'ZZZ00Z'), 0), coalesce((SELECT last_seen FROM ents WHERE canonical = 'ZZZ00Z'), ''), 0""", "ents"),
        "mojibake": f"SELECT file, {guard('plats')} AS plats, {guard('handelse')} AS handelse FROM reports WHERE contains(plats, 'Ã') OR contains(handelse, 'Ã')",
        "text_mark_clusters": r"""WITH w AS (SELECT file, mark_id, label, array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(label), '[.,;:!?()"'']', ' ', 'g'), '\s+'),
  lambda x: x <> '' AND x NOT IN ('en', 'ett', 'den', 'det', 'med', 'och', 'i', 'på', 'av'))), ' ') AS key FROM text_marks WHERE label IS NOT NULL),
f AS (SELECT key, file, arg_min(label, mark_id) AS label, min(mark_id) AS mark_id FROM w WHERE key <> '' GROUP BY key, file)
SELECT key, count(*) AS count, arg_max(label, (length(label), -mark_id)) AS label FROM f GROUP BY key HAVING count(*) >= 2""",
        "link_kinds": f"""SELECT file, CAST(pos - 1 AS INT) AS pos, CASE WHEN NOT regexp_full_match(t, '{V.PLATE_LINK}') THEN 'mark' WHEN contains(t, '.') THEN 'plate-partial' ELSE 'plate-full' END AS kind
FROM (SELECT file, pos, trim(split_part(l.raw, '|', 1)) AS t FROM (SELECT file, unnest(links) AS l, generate_subscripts(links, 1) AS pos FROM reports))""",
        "q_time_window": r"""SELECT * FROM (SELECT file, try_cast(nullif(regexp_extract(tidpunkt, 'T(\d{2}):(\d{2})', 1), '') AS INT) * 60 + try_cast(nullif(regexp_extract(tidpunkt, 'T(\d{2}):(\d{2})', 2), '') AS INT) AS minute FROM reports)
WHERE minute >= 1320 OR minute <= 300""",
        "q_observer": "SELECT file, sagesman FROM reports WHERE contains(upper(sagesman), 'AQ')",
        "q_search": """SELECT file FROM reports WHERE coalesce(contains(lower(handelse), 'skåpbil'), false) OR coalesce(contains(lower(symbol), 'skåpbil'), false) OR coalesce(contains(lower(plats), 'skåpbil'), false)
OR len(list_filter(links, lambda x: contains(lower(x.raw), 'skåpbil'))) > 0""",
        "attachments": r"""SELECT DISTINCT file, image FROM (SELECT file, unnest(list_concat(coalesce(bilagor, []), coalesce(embeds, []))) AS image FROM reports) WHERE regexp_matches(image, '(?i)\.(jpe?g|png|webp)$')""",
        "quiet_reports": sql("SELECT file FROM scores WHERE score < 5", "scores"),
        "parse_files": f"""SELECT file, coalesce(tnr, '') AS tnr, trim(coalesce({guard('plats')}, '')) AS plats, trim(coalesce({guard('sagesman')}, '')) AS sagesman, coalesce(typ, '') AS typ FROM reports""",
        "q_recurring_vehicles": sql("SELECT canonical AS ref, count AS n, last_seen AS tidpunkt FROM ents WHERE count >= 3", "ents"),
        "q_timeline_larm": sql("SELECT file AS ref, CAST(score AS BIGINT) AS n FROM elevated JOIN hours USING (file) WHERE h >= 22 OR h < 5 OR (h = 5 AND contains(tidpunkt, 'T05:00'))", "elevated", "hours"),
        "q_place_question": "SELECT file AS ref FROM reports WHERE contains(upper(sagesman), 'AQ') AND contains(lower(plats), 'berga')",
        "haversine": f"SELECT seq, CAST(floor({checking.distance('o', 'p')} + 0.5) AS BIGINT) AS metres FROM (SELECT CAST({V.OBJECT_LAT} AS DOUBLE) AS lat, CAST({V.OBJECT_LON} AS DOUBLE) AS lon) o, (SELECT * FROM predefined_places WHERE {checking.VALID}) p",
        "eval_pairs": """WITH c AS (SELECT sagesman AS g, batch_no AS h FROM reports WHERE sagesman IS NOT NULL),
f AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT count(*) AS n FROM c GROUP BY g)), t AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT count(*) AS n FROM c GROUP BY h)),
b AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT count(*) AS n FROM c GROUP BY g, h))
SELECT CAST(f.v AS DOUBLE) AS pairs_found, CAST(t.v AS DOUBLE) AS pairs_true, CAST(b.v AS DOUBLE) AS pairs_both, round(CAST(b.v AS DOUBLE) / CAST(f.v AS DOUBLE), 6) AS precision, round(CAST(b.v AS DOUBLE) / CAST(t.v AS DOUBLE), 6) AS recall FROM f, t, b""",
        "plate_corroboration": sql("""SELECT l.file, l.value AS plate, CASE WHEN EXISTS (SELECT 1 FROM found p WHERE p.file = l.file AND p.type = 'plate' AND p.turn <= 3 AND p.value = l.value) THEN 'confirmed'
 WHEN EXISTS (SELECT 1 FROM found p WHERE p.file = l.file AND p.type = 'plate' AND p.turn <= 3) THEN 'conflict' ELSE 'none' END AS state
FROM shown l""", "found", extra=r"""shown AS (SELECT DISTINCT file, CASE WHEN length(b) = 7 AND regexp_full_match(b, 'S%s') THEN substr(b, 2) ELSE b END AS value FROM
  (SELECT file, upper(regexp_replace(p, '[\s-]+', '', 'g')) AS b FROM (SELECT file, unnest(photo_plates) AS p FROM reports)) WHERE b <> '')""" % V.PLATE),
        "demo_schedule": r"""WITH t AS (SELECT file, tnr, CAST(substr(tnr, 1, 2) AS INT) * 1440 + CAST(substr(tnr, 3, 2) AS INT) * 60 + CAST(substr(tnr, 5, 2) AS INT) AS m FROM reports
  WHERE regexp_full_match(tnr, '\d{6}')),
o AS (SELECT *, row_number() OVER (ORDER BY m, file) - 1 AS i, (m - min(m) OVER ()) * 60 / 60.0 AS ideal FROM t)
SELECT file, round(i * 2.0 + max(ideal - i * 2.0) OVER (ORDER BY i), 6) AS at_s FROM o""",
    } | {name: text.replace('__ALERTS__', _ALERTS) for name, text in derived.SQL.items()}


#: Letters as the wrong encoding shows them, for the checking SQL.
_MISREAD = [("Ã¥", "å"), ("Ã¤", "ä"), ("Ã¶", "ö"), ("Ã…", "Å"), ("Ã„", "Ä"), ("Ã–", "Ö"), ("Ã©", "é"), ("Ã¼", "ü"), ("Ã¸", "ø"), ("Ã¦", "æ"), ("ÃŸ", "ß"), ("Â ", " "), ("Â", "")]
