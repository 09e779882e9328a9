"""Named queries over what the pipeline derives: actors, places, watches, orders, notes, questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, text
from ..functions import vocabulary as V
from ..functions.instants import SQL_EPOCH, epoch_seconds
from ..operators import actors, decisions, evaluation, feeds, identifiers, marks, merges, places, suspects, vehicles
from ..operators.orders import in_order
from ..session import stored
from ..sources import models, notes, reports_md
from . import questions
from .checking import VALID, actors as over_actors, distance, short_hash, sql
from .pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def named(name: str, checked: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL that checks it."""

    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if checked is not None:
            SQL[name] = checked
        return query

    return keep


def blank(column: str) -> Column:
    return F.coalesce(column, F.lit(""))


# --- actors -------------------------------------------------------------------


@named("actors_all", over_actors("SELECT id, root, facets, vehicles, marks, types FROM allacts"))
def actors_all(spark: SparkSession, d: str) -> DataFrame:
    """Actors and the suspects that none of them has among its facets."""
    return Pipeline(spark, d).actors.withColumn("types", F.array_join("types", ","))


@named("actor_facets", over_actors("SELECT actor, facet, type FROM held"))
def actor_facets(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).actor_facets.select("actor", "facet", "type")


_CHAIN = "coalesce(tidpunkt, ''), coalesce(tnr, ''), file"


@named("actor_chain_order", over_actors(f"SELECT actor, file, row_number() OVER (ORDER BY actor, {_CHAIN}) AS nth FROM allsteps"))
def actor_chain_order(spark: SparkSession, d: str) -> DataFrame:
    """Every message of every actor's chain, actor by actor and in order of time."""
    rows = Pipeline(spark, d).chains.select("actor", "file", blank("tidpunkt").alias("t"), blank("tnr").alias("u"))
    return in_order(rows, F.col("actor"), F.col("t"), F.col("u"), F.col("file")).select("actor", "file", "nth")


def _actor_merges(lone: DataFrame) -> DataFrame:
    """Suspects last seen on one day said to be one actor: each is merged into the smallest id of that day."""
    day = lone.select("id", F.substring("last_seen", 1, 10).alias("day"))
    first = day.groupBy("day").agg(F.min("id").alias("survivor"))
    return day.join(first, "day").filter("id <> survivor").select(F.col("id").alias("absorbed"), "survivor")


_MERGED = """merged AS (SELECT id AS absorbed, min(id) OVER (PARTITION BY substr(last_seen, 1, 10)) AS survivor FROM lone),
mheld AS (SELECT DISTINCT coalesce(m.survivor, h.actor) AS actor, facet, type FROM held h LEFT JOIN merged m ON m.absorbed = h.actor),
msteps AS (SELECT coalesce(m.survivor, s.actor) AS actor, file, min(tidpunkt) AS tidpunkt FROM allsteps s LEFT JOIN merged m ON m.absorbed = s.actor GROUP BY 1, 2)"""


@named("actors_folded", over_actors("""SELECT h.actor, h.facets, h.vehicles, h.marks, coalesce(s.n, 0) AS messages, coalesce(s.f, '') AS first_seen, coalesce(s.l, '') AS last_seen
FROM (SELECT actor, count(*) AS facets, count(*) FILTER (WHERE type = 'fordon') AS vehicles, count(*) FILTER (WHERE type <> 'fordon') AS marks FROM mheld GROUP BY actor) h
LEFT JOIN (SELECT actor, count(*) AS n, min(nullif(tidpunkt, '')) AS f, max(nullif(tidpunkt, '')) AS l FROM msteps GROUP BY actor) s ON s.actor = h.actor""", extra=_MERGED))
def actors_folded(spark: SparkSession, d: str) -> DataFrame:
    """Actors after merges: facets and messages that several of a group have count once."""
    whole = Pipeline(spark, d)
    return actors.folded(whole.actor_facets, whole.chains, merges.survivors(_actor_merges(whole.lone_actors)))


# --- places -------------------------------------------------------------------


def _place_merges(spark: SparkSession, located: DataFrame) -> DataFrame:
    """Derived places merged into their first word, and that into an area of its first letter: chains of two."""
    word = located.filter("not predefined").select("place", F.substring_index("place", " ", 1).alias("word"))
    one = word.filter("place <> word").select(F.col("place").alias("absorbed"), F.col("word").alias("survivor"))
    two = word.select(F.col("word").alias("absorbed"), F.concat(F.lit("Område-"), F.substring("word", 1, 1)).alias("survivor")).distinct()
    return one.unionByName(two)


_PLACES = r"""keys AS (SELECT coalesce(c.place, p.name) AS place, coalesce(c.n, 0) AS reports, coalesce(c.e, 0) AS elevated, p.name IS NOT NULL AS predefined, p.lat AS plat, p.lon AS plon, c.spot
  FROM (SELECT place, count(*) AS n, count(*) FILTER (WHERE elevated) AS e, arg_min({'lat': lat, 'lon': lon}, file) FILTER (WHERE lat IS NOT NULL) AS spot FROM claims GROUP BY place) c FULL JOIN predefined_places p ON p.name = c.place)"""
_PLACE_MERGES = _PLACES + r""",
finals AS (SELECT DISTINCT a AS absorbed, 'Område-' || substr(w, 1, 1) AS survivor FROM (SELECT unnest([place, split_part(place, ' ', 1)]) AS a, split_part(place, ' ', 1) AS w FROM keys WHERE NOT predefined)),
mclaims AS (SELECT coalesce(f.survivor, c.place) AS place, c.file, any_value(c.elevated) AS elevated, any_value(c.plates) AS plates FROM claims c LEFT JOIN finals f ON f.absorbed = c.place GROUP BY 1, 2)"""


@named("merge_survivors", sql("SELECT absorbed, survivor FROM finals", "claims", extra=_PLACE_MERGES))
def merge_survivors(spark: SparkSession, d: str) -> DataFrame:
    return merges.survivors(_place_merges(spark, Pipeline(spark, d).locations))


@named("locations_merged", sql("SELECT place, count(*) AS reports, count(*) FILTER (WHERE elevated) AS elevated, len(list_distinct(flatten(list(plates)))) AS plates FROM mclaims GROUP BY place", "claims", extra=_PLACE_MERGES))
def locations_merged(spark: SparkSession, d: str) -> DataFrame:
    """Places after merges: a report that several of a group claim counts once."""
    whole = Pipeline(spark, d)
    moved = places.moved(whole.claims, merges.survivors(_place_merges(spark, whole.locations)))
    return places.locations(moved, whole.predefined).filter("reports > 0").select("place", "reports", "elevated", "plates")


@named("location_positions", sql("SELECT place, coalesce(plat, spot.lat) AS lat, CASE WHEN plat IS NOT NULL OR predefined THEN plon ELSE spot.lon END AS lon FROM keys", "claims", extra=_PLACES))
def location_positions(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).locations.select("place", "lat", "lon")


@named("nearest_nameless", sql(f"""SELECT seq, arg_min(place, (m, place)) AS place, CAST(floor(min(m) + 0.5) AS BIGINT) AS metres FROM (SELECT p.seq, k.place, {distance("k", "p")} AS m
FROM (SELECT place, spot.lat AS lat, spot.lon AS lon FROM keys WHERE NOT predefined AND regexp_full_match(regexp_replace(place, '\\s+', '', 'g'), '\\d{{1,2}}[C-X][A-Z][A-Z]\\d+') AND place NOT LIKE '%1') k,
 (SELECT * FROM predefined_places WHERE {VALID}) p WHERE k.lat BETWEEN -90 AND 90 AND k.lon BETWEEN -180 AND 180) WHERE m <= 500 GROUP BY seq""", "claims", extra=_PLACES))
def nearest_nameless(spark: SparkSession, d: str) -> DataFrame:
    """The nearest grid place without a name within reach of each predefined place; those ending in 1 have names."""
    whole = Pipeline(spark, d)
    nicknames = whole.locations.filter(F.col("place").endswith("1")).select("place")
    found = places.nearest_nameless(whole.locations, nicknames, whole.predefined.select("seq", "lat", "lon"))
    return found.select("seq", "place", text.half_up(F.col("distance_m")).cast("long").alias("metres"))


@named("vicinity_links", sql("SELECT b.file, c.name AS near FROM based b JOIN covering c USING (file) WHERE c.name <> b.place", "based", "covering"))
def vicinity_links(spark: SparkSession, d: str) -> DataFrame:
    """The predefined place in whose reach a report lies that names another one."""
    return places.near_of(Pipeline(spark, d).claims)


def _agent_sql(shown: str, key: str) -> str:
    clean = rf"""trim(regexp_replace(regexp_replace({shown}, '[\\/:*?"<>|#^\[\]]+', ' ', 'g'), '\s+', ' ', 'g'))"""
    return f"CASE WHEN length({clean}) > 72 THEN trim(substr({clean}, 1, 72)) || '… (' || right(lpad({short_hash(key)}, CAST(greatest(4, length({short_hash(key)})) AS INT), '0'), 4) || ')' ELSE {clean} END"


_SAFE = r"""regexp_replace({c}, '[\\/:*?"<>|.\s#]', '_', 'g')"""


def _place_stem(place: str) -> str:
    return _agent_sql(f"('📍 ' || {place})", f"('plats:' || {place})")




@named("place_stems", sql(f"SELECT DISTINCT b.file, {_place_stem('k.place')} AS stem FROM based b JOIN keys k ON k.place = b.place", "based", "claims", extra=_PLACES))
def place_stems(spark: SparkSession, d: str) -> DataFrame:
    """The note of the place that each report names, if the place has one."""
    whole = Pipeline(spark, d)
    named_ = whole.reports.select("file", text.trimmed(blank("plats")).alias("place"))
    return named_.join(whole.locations.select("place"), "place").select("file", notes.place_stem(F.col("place")).alias("stem"))


_RECURS = "again AS (SELECT place, plate, count(*) AS n FROM (SELECT place, unnest(plates) AS plate FROM claims) GROUP BY place, plate HAVING count(*) >= 2)"
_RECUR_STEM = _agent_sql("('🔁 ' || a.plate || ' ×' || a.n || ' · ' || a.place)", f"({_SAFE.format(c='a.plate')} || '@@' || {_place_stem('a.place')})")


@named("recurrence_routes", sql(f"SELECT c.place, c.file, c.plate, CASE WHEN a.n IS NULL THEN {_SAFE.format(c='c.plate')} ELSE {_RECUR_STEM} END AS stem FROM (SELECT place, file, unnest(plates) AS plate FROM claims) c LEFT JOIN again a ON a.place = c.place AND a.plate = c.plate", "claims", extra=_RECURS))
def recurrence_routes(spark: SparkSession, d: str) -> DataFrame:
    """What each plate of a place's report links: the note of its recurrence there, else the vehicle's."""
    claimed = Pipeline(spark, d).claims
    return notes.routes(claimed, places.vehicle_recurrence(claimed))


@named("recurrence_actor", over_actors("SELECT trim(s.plats, E' \\t\\n\\r ') AS place, s.actor, count(*) AS n FROM allsteps s JOIN keys k ON k.place = trim(s.plats, E' \\t\\n\\r ') GROUP BY 1, 2 HAVING count(*) >= 2", "claims", extra=_PLACES))
def recurrence_actor(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    return places.actor_recurrence(whole.chains, whole.locations)


# --- joins --------------------------------------------------------------------


_PLATED = "plated AS (SELECT w.p AS canonical, string_agg(DISTINCT c.type, '/' ORDER BY c.type) AS kinds FROM crafts c JOIN (SELECT file, min(plate) AS p FROM plates WHERE NOT partial GROUP BY file HAVING count(DISTINCT plate) = 1) w USING (file) WHERE c.plated GROUP BY 1)"


@named("vehicles_typed", sql("SELECT e.canonical, e.kind, p.kinds FROM ents e LEFT JOIN plated p USING (canonical)", "ents", "crafts", "plates", extra=_PLATED))
def vehicles_typed(spark: SparkSession, d: str) -> DataFrame:
    """Vehicles with the kinds of craft their plate was seen as."""
    return questions.typed_vehicles(Pipeline(spark, d).views).select("canonical", "kind", "kinds")


@named("craft_flagged", sql("SELECT file, type, flag, row_number() OVER (ORDER BY type, t, u, file) AS nth FROM (SELECT c.file, c.type, e.file IS NOT NULL AS flag, coalesce(r.tidpunkt, '') AS t, coalesce(r.tnr, '') AS u FROM crafts c JOIN reports r USING (file) LEFT JOIN elevated e ON e.file = c.file)", "crafts", "elevated"))
def craft_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of craft in their order, with whether the report is elevated."""
    whole = Pipeline(spark, d)
    rows = whole.craft.select("file", "type", blank("tidpunkt").alias("t"), blank("tnr").alias("u")).join(whole.elevated.select("file", F.lit(True).alias("hot")), "file", "left")
    placed = in_order(rows, F.col("type"), F.col("t"), F.col("u"), F.col("file"))
    return placed.select("file", "type", F.coalesce("hot", F.lit(False)).alias("flag"), "nth")


@named("reports_with_mark", sql("SELECT r.file, r.plats FROM reports r WHERE r.file IN (SELECT file FROM members)", "members"))
def reports_with_mark(spark: SparkSession, d: str) -> DataFrame:
    """Reports that show a recurring mark."""
    whole = Pipeline(spark, d)
    return whole.reports.select("file", "plats").join(whole.members.select("file").distinct(), "file", "left_semi")


@named("reports_with_plate", "SELECT file FROM reports WHERE len(list_filter(links, lambda x: x.kind IN ('plate-full', 'plate-partial'))) > 0")
def reports_with_plate(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).reports.filter(questions.with_plate()).select("file")


@named("plate_candidates", sql("SELECT f.partial, p.plate FROM fits f JOIN (SELECT DISTINCT plate FROM plates WHERE NOT partial) p ON f.n > 1 AND regexp_full_match(p.plate, f.partial)", "fits", "plates"))
def plate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The whole plates of each partial one that fits several."""
    return vehicles.candidates(Pipeline(spark, d).plates)


# --- watches, feed, waiting -----------------------------------------------------


_CLUSTERS = r"""w AS (SELECT file, mark_id, label, array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(label), '[.,;:!?()"'']', ' ', 'g'), '\s+'),
  lambda x: x <> '' AND x NOT IN ('en', 'ett', 'den', 'det', 'med', 'och', 'i', 'på', 'av'))), ' ') AS key FROM text_marks WHERE label IS NOT NULL),
f AS (SELECT key, file, arg_min(label, mark_id) AS label, min(mark_id) AS mark_id FROM w WHERE key <> '' GROUP BY key, file),
clusters AS (SELECT key, count(*) AS count, arg_max(label, (length(label), -mark_id)) AS label FROM f GROUP BY key HAVING count(*) >= 2)"""


def text_mark_members(marks_: DataFrame) -> DataFrame:
    """(key, file, label, mark_id): marks of free text, one per key and report."""
    rows = marks_.filter(F.col("label").isNotNull()).select("file", "mark_id", "label", text.mark_key(F.col("label")).alias("key")).filter(F.col("key") != "")
    return rows.groupBy("key", "file").agg(F.min_by("label", "mark_id").alias("label"), F.min("mark_id").alias("mark_id"))


def text_mark_clusters(members: DataFrame) -> DataFrame:
    """(key, count, label): keys in two reports or more; the longest wording names them."""
    grouped = members.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.max_by("label", F.struct(F.length("label"), -F.col("mark_id"))).alias("label"))
    return grouped.filter("count >= 2")


def watch_states(whole: Pipeline) -> DataFrame:
    """(kind, ref, label, count, last_seen) of everything that can be watched, six kinds."""
    own = lambda df, kind, ref, label, count, seen: df.select(F.lit(kind).alias("kind"), F.col(ref).alias("ref"), label.alias("label"), count.cast("long").alias("count"), blank(seen).alias("last_seen"))
    members = text_mark_members(whole.table("text_marks"))
    seen = members.join(whole.reports.select("file", "tidpunkt"), "file").groupBy("key").agg(F.max(F.nullif(F.col("tidpunkt"), F.lit(""))).alias("last"))
    parts = [
        own(whole.vehicles, "fordon", "canonical", F.col("canonical"), F.col("count"), "last_seen"),
        own(actors.spans(whole.chains), "aktör", "actor", F.col("actor"), F.col("messages"), "last_seen"),
        own(whole.suspects, "person", "agent", F.col("label"), F.col("n"), "last_seen"),
        own(whole.nominations, "märke", "signature", F.col("label"), F.col("count"), "last_seen"),
        own(text_mark_clusters(members).join(seen, "key", "left"), "textmärke", "key", F.col("label"), F.col("count"), "last"),
        own(whole.reports, "händelse", "file", F.col("file"), F.lit(1), "tidpunkt"),
    ]
    return reduce(DataFrame.unionByName, parts)


def watched(whole: Pipeline) -> DataFrame:
    """A watch list over all six kinds: what was seen three times or more since its second sighting, elevated reports, and things never seen."""
    states = stored(watch_states(whole))
    often = states.filter("count >= 3").select("kind", "ref", F.when(F.length("ref") % 5 == 0, -1).otherwise(2).alias("baseline"))
    events = whole.elevated.select(F.lit("händelse").alias("kind"), F.col("file").alias("ref"), F.lit(0).alias("baseline"))
    kinds = F.array(*map(F.lit, ("fordon", "aktör", "person", "märke", "textmärke")))
    never = whole.spark.range(1).select(F.explode(kinds).alias("kind"), F.lit("ZZZ00Z").alias("ref"), F.lit(1).alias("baseline"))
    entries = often.unionByName(events).unionByName(never)
    return feeds.watch(entries, states).join(states.select("kind", "ref", "label"), ["kind", "ref"], "left").withColumn("label", F.coalesce("label", "ref"))


_STATES = _CLUSTERS + """,
states AS (SELECT 'fordon' AS kind, canonical AS ref, canonical AS label, count, last_seen FROM ents
UNION ALL SELECT 'aktör', actor, actor, count(*), coalesce(max(nullif(tidpunkt, '')), '') FROM allsteps GROUP BY actor
UNION ALL SELECT 'person', s.agent, l.label, s.n, coalesce(s.last_seen, '') FROM suspects s JOIN agent_labels l USING (agent)
UNION ALL SELECT 'märke', signature, label, count, last_seen FROM noms
UNION ALL SELECT 'textmärke', key, label, count, coalesce((SELECT max(nullif(tidpunkt, '')) FROM f JOIN reports USING (file) WHERE f.key = clusters.key), '') FROM clusters
UNION ALL SELECT 'händelse', file, file, 1, coalesce(tidpunkt, '') FROM reports),
entries AS (SELECT kind, ref, CASE WHEN length(ref) % 5 = 0 THEN -1 ELSE 2 END AS baseline FROM states WHERE count >= 3
UNION ALL SELECT 'händelse', file, 0 FROM elevated UNION ALL SELECT unnest(['fordon', 'aktör', 'person', 'märke', 'textmärke']), 'ZZZ00Z', 1),
watched AS (SELECT e.kind, e.ref, coalesce(s.label, e.ref) AS label, coalesce(s.count, 0) AS count, coalesce(s.last_seen, '') AS last_seen,
  CASE WHEN e.kind = 'händelse' OR e.baseline < 0 THEN 0 ELSE greatest(0, coalesce(s.count, 0) - e.baseline) END AS fresh FROM entries e LEFT JOIN states s ON s.kind = e.kind AND s.ref = e.ref)"""
_AGENT_LABELS = r"""agent_labels AS (SELECT g.agent, arg_min(coalesce(p.plate, nullif(trim(e2.symbol, E' \t\n\r '), ''), 'okänd (TNR' || coalesce(e.tnr, '') || ')'), (e.tidpunkt, e.tnr, e.file)) AS label FROM elevated e JOIN agents g USING (file)
  JOIN reports e2 USING (file) LEFT JOIN (SELECT file, arg_min(plate, (partial, plate)) AS plate FROM plates GROUP BY file) p ON p.file = e.file GROUP BY g.agent),
"""


@named("watch_all", over_actors("SELECT kind, ref, label, count, last_seen, fresh, row_number() OVER (ORDER BY fresh DESC, label COLLATE sv, kind, ref) AS nth FROM watched", "ents", "suspects", "noms", "plates", extra=_AGENT_LABELS + _STATES))
def watch_all(spark: SparkSession, d: str) -> DataFrame:
    """The watch list of six kinds, what gained most first, then by label as Swedish sorts it."""
    rows = watched(Pipeline(spark, d))
    return in_order(rows, F.col("fresh").desc(), F.collate("label", "sv"), F.col("kind"), F.col("ref")).select("kind", "ref", "label", "count", "last_seen", "fresh", "nth")


def mark_log(whole: Pipeline) -> DataFrame:
    """Decisions about marks, by a rule: most are confirmed, some rejected later, some of those taken back."""
    found = whole.nominations.select(F.lit("mark").alias("map"), F.col("signature").alias("key"), F.length("signature").alias("l"))
    row = lambda rows, value, at, seq: rows.select("map", "key", F.lit(value).cast("string").alias("value"), F.lit(at).alias("at"), F.lit(seq).cast("long").alias("seq"))
    return row(found, "confirmed", "1", 1).unionByName(row(found.filter("l % 2 = 0"), "rejected", "2", 2)).unionByName(row(found.filter("l % 4 = 0"), None, "2", 3))


def actor_log(whole: Pipeline) -> DataFrame:
    """Decisions about actors, by the length of the id: confirmed, rejected, undecided."""
    n = F.length("id") % 3
    return whole.actors.select(F.lit("actor").alias("map"), F.col("id").alias("key"), F.when(n == 0, "confirmed").when(n == 1, "rejected").alias("value"), F.lit("1").alias("at"), F.lit(1).cast("long").alias("seq"))


_DECIDED = """mdec AS (SELECT signature, CASE WHEN length(signature) % 4 = 0 THEN NULL WHEN length(signature) % 2 = 0 THEN 'rejected' ELSE 'confirmed' END AS decision FROM noms),
adec AS (SELECT id, CASE length(id) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' END AS decision FROM allacts)"""


@named("decided_marks", over_actors("SELECT n.signature, m.decision FROM noms n JOIN mdec m USING (signature)", "noms", extra=_DECIDED))
def decided_marks(spark: SparkSession, d: str) -> DataFrame:
    """Every nominated mark with the decision that stands."""
    whole = Pipeline(spark, d)
    return decisions.decided(whole.nominations.select("signature"), decisions.state(mark_log(whole)), "mark", "signature")


@named("decided_actors", over_actors("SELECT id, decision FROM adec", "noms", extra=_DECIDED))
def decided_actors(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    return decisions.decided(whole.actors.select("id"), decisions.state(actor_log(whole)), "actor", "id")


@named("decisions_wiped", over_actors("SELECT 'actor' AS map, id AS key, decision AS value FROM adec WHERE decision IS NOT NULL", "noms", extra=_DECIDED))
def decisions_wiped(spark: SparkSession, d: str) -> DataFrame:
    """What stands after an area was set between the decisions on marks and those on actors, and only renamed later."""
    whole = Pipeline(spark, d)
    areas = whole.spark.createDataFrame([("area", "59.26,17.71", "Norr", "5", 1), ("area", "59.26,17.71", "Nord", "9", 1)], decisions.LOG)
    log = mark_log(whole).unionByName(actor_log(whole).withColumn("at", F.lit("7"))).unionByName(areas)
    return decisions.state(decisions.area_changes(log)).filter("map <> 'area'")


@named("pending_counts", over_actors("""SELECT 'aktör' AS kind, count(*) AS n FROM adec WHERE decision IS NULL UNION ALL SELECT 'märke', count(*) FROM mdec WHERE decision IS NULL
UNION ALL SELECT 'bild', (SELECT count(*) FROM (SELECT DISTINCT file, upper(p) AS p FROM (SELECT file, unnest(photo_plates) AS p FROM reports) WHERE p <> '')) UNION ALL SELECT 'text', (SELECT count(*) FROM clusters)""", "noms", extra=_DECIDED + ",\n" + _CLUSTERS))
def pending_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many suggestions of each kind wait for a decision."""
    whole = Pipeline(spark, d)
    standing = decisions.state(mark_log(whole).unionByName(actor_log(whole)))
    none = lambda df, *keys: df.select(*keys).limit(0)
    photos = whole.reports.select("file", F.explode("photo_plates").alias("plate")).withColumn("plate", F.upper("plate")).filter("plate <> ''").distinct()
    texts = text_mark_clusters(text_mark_members(whole.table("text_marks"))).select("key")
    waiting = {
        "aktör": decisions.decided(whole.actors.select("id"), standing, "actor", "id").filter("decision is null"),
        "märke": decisions.decided(whole.nominations.select("signature"), standing, "mark", "signature").filter("decision is null"),
        "bild": models.pending(photos, none(photos, "file", "plate"), none(photos, "file", "plate"), "file", "plate"),
        "text": models.pending(texts, none(texts, "key"), none(texts, "key"), "key"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in waiting.items()])


_SEPARATE = r"""regexp_replace({c}, '[\\/:*?"<>|.\s]', '_', 'g') || '.md'"""


def _epoch(column: str) -> str:
    return f"coalesce({SQL_EPOCH.format(c=column)}, 0)"


_FEED = f"""items AS (SELECT {_SEPARATE.format(c='canonical')} AS path, 'fordon' AS kind, {_epoch('last_seen')} AS time FROM ents
UNION ALL SELECT {_SEPARATE.format(c='signature')}, 'kännetecken', {_epoch('last_seen')} FROM noms JOIN mdec USING (signature) WHERE decision = 'confirmed'
UNION ALL SELECT {_SEPARATE.format(c='actor')}, 'aktör', {_epoch('last_seen')} FROM (SELECT actor, coalesce(max(nullif(tidpunkt, '')), '') AS last_seen FROM allsteps JOIN adec ON id = actor WHERE decision = 'confirmed' GROUP BY actor)
UNION ALL SELECT r.file, CASE WHEN e.file IS NULL THEN 'mottaget' ELSE 'larm' END, {_epoch('r.tidpunkt')} FROM reports r LEFT JOIN elevated e USING (file)
UNION ALL SELECT 'bevakad:' || kind || ':' || ref, 'bevakad', {_epoch('last_seen')} FROM watched WHERE fresh > 0
UNION ALL SELECT 'review:actors', 'förslag-aktör', 9007199254740991 WHERE (SELECT count(*) FROM adec WHERE decision IS NULL) > 0
UNION ALL SELECT 'review:marks', 'förslag-märke', 9007199254740990 WHERE (SELECT count(*) FROM mdec WHERE decision IS NULL) > 0
UNION ALL SELECT 'review:photos', 'förslag-bild', 9007199254740989 WHERE (SELECT count(*) FROM reports WHERE len(photo_plates) > 0) > 0
UNION ALL SELECT 'review:texts', 'förslag-text', 9007199254740988 WHERE (SELECT count(*) FROM clusters) > 0
UNION ALL SELECT 'bildanalys:' || file, 'bildanalys', 9007199254740988 - row_number() OVER (ORDER BY file) FROM (SELECT max(file) AS file FROM reports)
UNION ALL SELECT 'textanalys:' || file, 'textanalys', 9007199254740987 - row_number() OVER (ORDER BY file) FROM (SELECT min(file) AS file FROM reports)
UNION ALL SELECT 'review:place:' || key, 'namnge-plats', 9007199254740986 - row_number() OVER (ORDER BY turn, key) FROM (
  SELECT b.place AS key, min((coalesce(b.tidpunkt, ''), coalesce(b.tnr, ''), b.file)) AS turn FROM based b WHERE (b.elevated OR len(b.plates) > 0) AND regexp_full_match(regexp_replace(b.place, '\\s+', '', 'g'), '\\d{{1,2}}[C-X][A-Z][A-Z]\\d+') GROUP BY b.place)),
newest AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY path ORDER BY time DESC, kind) = 1)"""


def feed_of(whole: Pipeline) -> DataFrame:
    """The feed with decisions, watches, findings and one running analysis of each kind."""
    standing = decisions.state(mark_log(whole).unionByName(actor_log(whole)))
    hot = whole.elevated.select("file")
    last = whole.chains.groupBy(F.col("actor").alias("ref")).agg(F.coalesce(F.max(F.nullif(F.col("tidpunkt"), F.lit(""))), F.lit("")).alias("last_seen"))
    found = whole.nominations.select(F.col("signature").alias("ref"), "last_seen")
    told = lambda name: decisions.of(standing, name).select(F.col("key").alias("ref"), F.col("value").alias("decision"))
    photos = whole.reports.filter(F.size("photo_plates") > 0).select(F.col("file").alias("ref"))
    texts = text_mark_clusters(text_mark_members(whole.table("text_marks"))).select(F.col("key").alias("ref"))
    items = [
        feeds.vehicle_items(whole.vehicles),
        feeds.confirmed_items(found, told("mark"), "kännetecken"),
        feeds.confirmed_items(last, told("actor"), "aktör"),
        feeds.report_items(whole.reports, hot),
        feeds.watch_items(watched(whole)),
        feeds.pending_items(whole.actors.select(F.col("id").alias("ref")), "förslag-aktör", 0, told("actor")),
        feeds.pending_items(found.select("ref"), "förslag-märke", 1, told("mark")),
        feeds.pending_items(photos, "förslag-bild", 2),
        feeds.pending_items(texts, "förslag-text", 3),
        feeds.running_items(whole.reports.agg(F.max("file").alias("file")), "bildanalys", feeds.PINNED_KINDS),
        feeds.running_items(whole.reports.agg(F.min("file").alias("file")), "textanalys", feeds.PINNED_KINDS + 1),
        feeds.place_items(whole.reports, hot, whole.plates, running=2),
    ]
    return reduce(DataFrame.unionByName, items)


@named("feed_top60", over_actors("SELECT path, kind, time FROM newest ORDER BY time DESC, path LIMIT 60", "ents", "suspects", "noms", "plates", "based", extra=_AGENT_LABELS + _STATES + ",\n" + _DECIDED + ",\n" + _FEED))
def feed_top60(spark: SparkSession, d: str) -> DataFrame:
    """The newest sixty items of thirteen kinds, what waits for review on top."""
    return feeds.feed(feed_of(Pipeline(spark, d))).select("path", "kind", "time")


@named("feed_newest", over_actors("SELECT path, kind, time FROM newest", "ents", "suspects", "noms", "plates", "based", extra=_AGENT_LABELS + _STATES + ",\n" + _DECIDED + ",\n" + _FEED))
def feed_newest(spark: SparkSession, d: str) -> DataFrame:
    """Every item that the feed chooses from, the newest of each path; places to be named are as many as there are."""
    whole = Pipeline(spark, d)
    items = feed_of(whole).filter("kind <> 'namnge-plats'")
    place = feeds.place_items(whole.reports, whole.elevated.select("file"), whole.plates, running=2, most=2**31 - 1)
    every = items.unionByName(place)
    return every.groupBy("path").agg(F.min_by(F.struct("kind", "time"), F.struct(-F.col("time"), "kind")).alias("x")).select("path", "x.kind", "x.time")


# --- orders ---------------------------------------------------------------------


def _by(told: str) -> Column:
    """A column to order by: ``-name`` downwards, ``name~sv`` as Swedish sorts it."""
    name, _, collation = told.lstrip("-").partition("~")
    column = F.collate(name, collation) if collation else F.col(name)
    return column.desc() if told.startswith("-") else column


def order(name: str, rows: Callable[[Pipeline], DataFrame], by: str, columns: list[str], checked: str) -> None:
    """Registers a query that numbers ``rows`` in their order."""
    named(name, checked)(lambda spark, d: in_order(rows(Pipeline(spark, d)), *map(_by, by.split())).select(*columns, "nth"))


order("order_observations", lambda w: w.observations.select("canonical", "file", blank("tidpunkt").alias("t"), blank("tnr").alias("u"), blank("as_read").alias("r")), "t u file canonical r", ["canonical", "file"],
      sql("SELECT canonical, file, row_number() OVER (ORDER BY coalesce(tidpunkt, ''), coalesce(tnr, ''), file, canonical, coalesce(as_read, '')) AS nth FROM obs", "obs"))
order("order_vehicles", lambda w: w.vehicles, "kind canonical", ["kind", "canonical"], sql("SELECT kind, canonical, row_number() OVER (ORDER BY kind, canonical) AS nth FROM ents", "ents"))
order("order_marks", lambda w: w.marks.select("object", "signature", "file", "turn", blank("tidpunkt").alias("t"), blank("tnr").alias("u")), "object signature t u file turn", ["signature", "file"],
      sql("SELECT signature, file, row_number() OVER (ORDER BY object, signature, coalesce(tidpunkt, ''), coalesce(tnr, ''), file, island) AS nth FROM marks", "marks"))
order("order_suspects", lambda w: w.suspects, "-n agent", ["agent", "n"], sql("SELECT agent, n, row_number() OVER (ORDER BY n DESC, agent) AS nth FROM suspects", "suspects"))
order("order_actors", lambda w: w.actors, "-facets id", ["id", "facets"], over_actors("SELECT id, facets, row_number() OVER (ORDER BY facets DESC, id) AS nth FROM allacts"))
order("order_edges", lambda w: w.edges, "-weight a b", ["a", "b"], sql("SELECT a, b, row_number() OVER (ORDER BY weight DESC, a, b) AS nth FROM tied", "tied"))
order("order_locations", lambda w: w.locations, "-elevated -reports place", ["place"], sql("SELECT place, row_number() OVER (ORDER BY elevated DESC, reports DESC, place) AS nth FROM keys", "claims", extra=_PLACES))
order("order_identifiers", lambda w: identifiers.identifiers(w.reports), "file type value partial", ["file", "type", "value"], sql("SELECT file, type, value, row_number() OVER (ORDER BY file, type, value, partial) AS nth FROM ids", "ids"))
order("order_text_marks", lambda w: text_mark_clusters(text_mark_members(w.table("text_marks"))), "-count key", ["key"], f"WITH {_CLUSTERS} SELECT key, row_number() OVER (ORDER BY count DESC, key) AS nth FROM clusters")
order("order_named_places", lambda w: w.predefined.select("name"), "name~sv name", ["name"], "SELECT name, row_number() OVER (ORDER BY name COLLATE sv, name) AS nth FROM predefined_places")
order("order_elevated", lambda w: w.elevated.select("file", "score", blank("tidpunkt").alias("t"), blank("tnr").alias("u")), "-score t u file", ["file"],
      sql("SELECT file, row_number() OVER (ORDER BY score DESC, coalesce(tidpunkt, ''), coalesce(tnr, ''), file) AS nth FROM elevated", "elevated"))


@named("order_review", over_actors("SELECT id, row_number() OVER (ORDER BY decision IS NOT NULL, CASE WHEN decision IS NULL THEN facets END DESC, CASE WHEN decision IS NULL THEN id END, id DESC) AS nth FROM adec JOIN allacts USING (id)", "noms", extra=_DECIDED))
def order_review(spark: SparkSession, d: str) -> DataFrame:
    """Actors to review: undecided ones in their order, then decided ones, the last first."""
    whole = Pipeline(spark, d)
    told = decisions.decided(whole.actors.select("id", "facets"), decisions.state(actor_log(whole)), "actor", "id")
    open_ = F.col("decision").isNull()
    by = [(~open_).alias("done"), F.when(open_, F.col("facets")).alias("f"), F.when(open_, F.col("id")).alias("o"), "id"]
    return in_order(told.select(*by), F.col("done"), F.col("f").desc_nulls_last(), F.col("o").asc_nulls_last(), F.col("id").desc()).select("id", "nth")


# --- notes ----------------------------------------------------------------------


_ESC = r"""regexp_replace(regexp_replace(coalesce({c}, ''), '[\x00-\x1F\x7F]', ' ', 'g'), '([\\`*_\[\]<>|#~])', '\\\1', 'g')"""
_STEM = r"regexp_replace(regexp_replace({c}, '^.*/', ''), '\.md$', '')"


def _esc(column: str) -> str:
    return _ESC.format(c=column)


def _cite(file: str, number: str) -> str:
    return f"('[[' || {_STEM.format(c=file)} || '|TNR' || {_esc(number)} || ']]')"


def _seen(alias: str, extra: str = "''") -> str:
    return f"('- ' || {_cite(alias + '.file', alias + '.tnr')} || ' — ' || {_esc(alias + '.tidpunkt')} || ' — ' || {_esc(alias + '.plats')} || {extra})"


def _lines(alias: str, line: str) -> str:
    return f"string_agg({line}, chr(10) ORDER BY coalesce({alias}.tidpunkt, ''), coalesce({alias}.tnr, ''), {alias}.file, {line})"


def _span(alias: str) -> str:
    return f"coalesce(min(nullif({alias}.tidpunkt, '')), '') || ' → ' || coalesce(max(nullif({alias}.tidpunkt, '')), '')"


def _fact(name: str, value: str) -> str:
    return f"CASE WHEN {value} <> '' THEN '**{name}:** ' || {value} END"


def _note(metod: str, kind: str, tag: str, title: str, head: list[str], lines: str) -> str:
    front = f"'---' || chr(10) || 'typ: {kind}' || chr(10) || 'generator: {V.GENERATOR}' || chr(10) || 'metod: {metod}' || chr(10) || 'tags: [{tag}]' || chr(10) || '---' || chr(10) || chr(10) || '# '"
    return f"{front} || {_esc(title)} || chr(10) || chr(10) || concat_ws(chr(10), {', '.join(head)}) || chr(10) || chr(10) || '## Observationer' || chr(10) || coalesce({lines}, '') || chr(10)"


_AREA = f"'{notes.AREA_LINK}'"
_OWN_VEHICLES = f"""rows_ AS (SELECT o.canonical, o.kind, count(*) AS n, {_span('o')} AS span, {_lines('o', _seen('o', "coalesce(CASE WHEN o.as_read <> o.canonical THEN '  — sedd som `' || o.as_read || '`' END, '')"))} AS lines,
  coalesce((SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT unnest(list(o.sagesman)) AS x) WHERE x <> ''), '') AS observers,
  coalesce((SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT unnest(list(CASE WHEN o.kind = 'fordon-reg-full' THEN o.as_read END)) AS x) WHERE x IS NOT NULL), '') AS resolved FROM obs o GROUP BY o.canonical, o.kind),
maybe AS (SELECT f.partial, string_agg(p.plate, ', ' ORDER BY p.plate) AS may_be FROM fits f JOIN (SELECT DISTINCT plate FROM plates WHERE NOT partial) p ON f.n > 1 AND regexp_full_match(p.plate, f.partial) GROUP BY f.partial)"""


@named("notes_vehicle", sql(f"""SELECT {_SAFE.format(c='canonical')} || '.md' AS path, {_note('jobb-a', 'entitet', 'fordon', 'canonical', [_fact('Slag', 'kind'), "'**Antal observationer:** ' || n", _fact('Tidsspann', 'span'), _fact('Sagesmän', 'observers'), _fact('Partiella observationer', 'resolved'),
 "CASE WHEN kind = 'fordon-reg-partiell' THEN coalesce('**Möjliga registreringsnummer:** ' || may_be, '_Ingen matchande fullständig regplåt observerad._') END"], 'lines')} AS text FROM rows_ LEFT JOIN maybe ON partial = canonical""", "obs", "fits", "plates", extra=_OWN_VEHICLES))
def notes_vehicle(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    return notes.vehicle_notes(whole.observations, whole.vehicles, vehicles.candidates(whole.plates))


@named("notes_mark", sql(f"""SELECT {_SAFE.format(c='n.signature')} || '.md' AS path, {_note('jobb-b', 'entitet', 'kännetecken', 'n.label', [_fact('Kategori', 'n.object'), "'**Antal observationer:** ' || n.count", "'**Tidsspann:** ' || r.span", _fact('Sagesmän', "replace(n.observers, ',', ', ')"), _AREA], 'r.lines')} AS text
FROM noms n JOIN (SELECT m.signature, {_span('m')} AS span, {_lines('m', _seen('m'))} AS lines FROM firsts m GROUP BY m.signature) r USING (signature)""", "noms",
    extra="firsts AS (SELECT m.signature, m.file, m.tnr, m.tidpunkt, r.plats FROM marks m JOIN reports r USING (file) WHERE m.distinctive AND m.signature IN (SELECT signature FROM noms) QUALIFY row_number() OVER (PARTITION BY m.signature, m.file ORDER BY m.island) = 1)"))
def notes_mark(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    return notes.mark_notes(whole.members, whole.nominations)


_SUSPECT_ROWS = _AGENT_LABELS + f"srows AS (SELECT g.agent, count(*) AS n, {_span('e')} AS span, {_lines('e', _seen('e'))} AS lines FROM elevated e JOIN agents g USING (file) GROUP BY g.agent)"
_LEVEL = "CASE WHEN s.top >= 9 THEN 'Hög' WHEN s.top >= 6 THEN 'Förhöjd' ELSE 'Att bevaka' END"


@named("notes_suspect", sql(f"""SELECT {_agent_sql("('⚠️ ' || l.label)", "s.agent")} || '.md' AS path, {_note('larm', 'misstänkt', 'larm', "('⚠️ ' || l.label)", [_fact('Bedömd nivå', _LEVEL), "'**Antal observationer:** ' || r.n", "'**Tidsspann:** ' || r.span",
 f"CASE WHEN s.kind = 'fordon' THEN '**Fordon:** [[' || {_SAFE.format(c='l.label')} || '|' || {_esc('l.label')} || ']]' ELSE {_AREA} END"], 'r.lines')} AS text FROM suspects s JOIN agent_labels l USING (agent) JOIN srows r USING (agent)""", "suspects", "agents", "plates", extra=_SUSPECT_ROWS))
def notes_suspect(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    return notes.suspect_notes(whole.suspect_sightings, whole.suspects)


_ROUTED = _PLACES + ",\n" + _RECURS + f""",
routed AS (SELECT c.place, c.file, string_agg('[[' || CASE WHEN a.n IS NULL THEN {_SAFE.format(c='c.plate')} ELSE {_RECUR_STEM} END || '|' || {_esc('c.plate')} || ']]', ', ') AS linked FROM (SELECT place, file, unnest(plates) AS plate FROM claims) c
  LEFT JOIN again a ON a.place = c.place AND a.plate = c.plate GROUP BY c.place, c.file),
sorted AS (SELECT place, file, array_to_string(list_sort(string_split(linked, ', ')), ', ') AS linked FROM routed),
prows AS (SELECT b.place, string_agg(line, chr(10) ORDER BY coalesce(tidpunkt, ''), coalesce(tnr, ''), file, line) AS lines FROM (SELECT c.place, c.file, r.tnr, c.tidpunkt, '- ' || CASE WHEN c.elevated THEN '⚠ ' ELSE '' END || {_cite('c.file', 'r.tnr')} || ' — ' || {_esc('c.tidpunkt')} || coalesce(' — ' || s.linked, '') AS line
  FROM claims c JOIN reports r USING (file) LEFT JOIN sorted s ON s.place = c.place AND s.file = c.file) b GROUP BY b.place)"""


@named("notes_place", sql(f"""SELECT {_place_stem('k.place')} || '.md' AS path, {_note('plats', 'plats', 'plats', "('📍 ' || k.place)", ["'**Rapporter:** ' || k.reports", "'**Misstänkta observationer:** ' || k.elevated", f"CASE WHEN k.predefined THEN {_AREA} END"], "coalesce(p.lines, '_Inga observationer ännu._')")} AS text
FROM keys k LEFT JOIN prows p ON p.place = k.place""", "claims", extra=_ROUTED))
def notes_place(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    return notes.place_notes(whole.claims, whole.locations, notes.routes(whole.claims, places.vehicle_recurrence(whole.claims)))


@named("notes_recurrence", sql(f"""SELECT {_RECUR_STEM} || '.md' AS path, {_note('aterkomst', 'återkomst', 'återkomst', "('🔁 ' || a.plate || ' ×' || a.n || ' · ' || a.place)", [f"'**Fordon:** [[' || {_SAFE.format(c='a.plate')} || '|' || {_esc('a.plate')} || ']]'",
 f"'**Plats:** [[' || {_place_stem('a.place')} || '|' || {_esc('a.place')} || ']]'", "'**Antal observationer här:** ' || a.n"], "''")} AS text FROM again a""", "claims", extra=_RECURS))
def notes_recurrence(spark: SparkSession, d: str) -> DataFrame:
    pairs = places.vehicle_recurrence(Pipeline(spark, d).claims)
    return notes.recurrence_notes(pairs.select(F.lit("fordon").alias("kind"), F.col("plate").alias("entity"), text.safe_name(F.col("plate")).alias("entity_stem"), "place", "n"))


@named("notes_text_mark", f"""WITH {_CLUSTERS}, m AS (SELECT f.key, f.file, f.label, c.label AS shown, c.count AS n, r.tnr, r.tidpunkt, r.plats FROM f JOIN clusters c USING (key) JOIN reports r USING (file)),
g AS (SELECT m.key, m.shown, m.n, {_lines('m', _seen('m', "coalesce(CASE WHEN m.label <> m.shown THEN ' — ”' || " + _esc('m.label') + " || '”' END, '')"))} AS lines FROM m GROUP BY m.key, m.shown, m.n)
SELECT {_agent_sql("('🎒 ' || shown)", "('textmark:' || key)")} || '.md' AS path, {_note('textmarke', 'entitet', 'kännetecken', "('🎒 ' || shown)", ["'**Antal observationer:** ' || n", _AREA], 'lines')} AS text FROM g""")
def notes_text_mark(spark: SparkSession, d: str) -> DataFrame:
    whole = Pipeline(spark, d)
    members = text_mark_members(whole.table("text_marks"))
    return notes.text_mark_notes(members.join(whole.reports.select("file", "tnr", "tidpunkt", "plats"), "file"), text_mark_clusters(members))


@named("notes_actor", over_actors(f"""SELECT {_agent_sql("('🕸️ ' || h.actor)", "h.actor")} || '.md' AS path, {_note('aktor', 'entitet', 'aktör', "('🕸️ ' || h.actor)", ["h.told", "'**Tidsspann:** ' || s.span", "'## Facetter'", "h.facets"], 's.lines')} AS text
FROM (SELECT actor, count(*) FILTER (WHERE type = 'fordon') || ' fordon, ' || count(*) FILTER (WHERE type <> 'fordon') || ' kännetecken' AS told, string_agg('- ' || {_esc('facet')}, chr(10) ORDER BY '- ' || {_esc('facet')}) AS facets FROM held GROUP BY actor) h
JOIN (SELECT x.actor, {_span('x')} AS span, string_agg(x.line, chr(10) ORDER BY coalesce(x.tidpunkt, ''), coalesce(x.tnr, ''), x.file, x.line) AS lines FROM alines x GROUP BY x.actor) s USING (actor)""", "claims", "based", "covering", extra=_PLACES + f""",
alines AS (SELECT s.actor, s.file, s.tnr, s.tidpunkt, '- ' || {_cite('s.file', 's.tnr')} || ' — ' || {_esc('s.tidpunkt')} || ' — ' || CASE WHEN k.place IS NOT NULL THEN '[[' || {_place_stem('k.place')} || '|' || {_esc('k.place')} || ']]' ELSE {_esc('trim(s.plats)')} END
  || coalesce(' _(nära [[' || {_place_stem('c.name')} || '|' || {_esc('c.name')} || ']])_', '') AS line FROM allsteps s JOIN based b USING (file) LEFT JOIN keys k ON k.place = trim(coalesce(s.plats, '')) LEFT JOIN covering c ON c.file = s.file AND c.name <> b.place)"""))
def notes_actor(spark: SparkSession, d: str) -> DataFrame:
    """Notes of actors, with the place each message names and the predefined one whose reach it lies in."""
    whole = Pipeline(spark, d)
    counted = whole.actors.select(F.col("id").alias("actor"), "vehicles", "marks")
    return notes.actor_notes(whole.actor_facets, whole.chains, counted, places.near_of(whole.claims), whole.locations.select("place"))


@named("alert_list", over_actors(f"SELECT key, rank, '- **' || {_esc('title')} || '**' AS line, row_number() OVER (ORDER BY rank DESC, key) AS nth FROM alerts", "near", "noms", "ents", extra="alerts AS (__ALERTS__)"))
def alert_list(spark: SparkSession, d: str) -> DataFrame:
    """Alerts as lines, the heaviest first."""
    whole = Pipeline(spark, d)
    rows = notes.alert_list(feeds.alerts(whole.elevated, whole.actors, whole.nominations, whole.vehicles))
    return in_order(rows, F.col("rank").desc(), F.col("key")).select("key", "rank", "line", "nth")


# --- forms of text ----------------------------------------------------------------


@named("text_forms", rf"""SELECT file, {_STEM.format(c='file')} AS stem, {_SAFE.format(c="coalesce(plats, '')")} AS safe, {_agent_sql("('📍 ' || coalesce(handelse, ''))", "file")} AS agent,
  {short_hash("file")} AS hash, {_esc("handelse")} AS escaped, coalesce(nullif(trim(CASE WHEN length(plats) % 2 = 0 THEN ' Norra ' ELSE ' ' END), ''), plats) AS label,
  '[[' || {_STEM.format(c='file')} || '|TNR' || {_esc('tnr')} || ']]' AS cited, regexp_replace(regexp_extract(tidpunkt, '^\d{{4}}-\d{{2}}-(\d{{2}}T\d{{2}}:\d{{2}})', 1), '[T:]', '', 'g') AS number,
  regexp_full_match(regexp_replace(coalesce(plats, ''), '\s+', '', 'g'), '\d{{1,2}}[C-X][A-Z][A-Z]\d+') AS grid FROM reports""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms that names, hashes, citations and labels take."""
    nick = F.when(F.length("plats") % 2 == 0, " Norra ").otherwise(" ")
    return Pipeline(spark, d).reports.select(
        "file", text.stem_of(F.col("file")).alias("stem"), text.safe_name(blank("plats")).alias("safe"), text.agent_name(F.concat(F.lit("📍 "), blank("handelse")), F.col("file")).alias("agent"),
        text.short_hash(F.col("file")).alias("hash"), text.escaped(blank("handelse")).alias("escaped"), text.place_label(F.col("plats"), nick).alias("label"),
        notes.citation(F.col("file"), F.col("tnr")).alias("cited"), text.number_from_time(F.col("tidpunkt")).alias("number"), text.bare_grid(F.col("plats")).alias("grid"),
    )


def _read(c: str) -> str:
    return f"(CASE WHEN length({c}) = 7 AND regexp_full_match({c}, 'S{V.PLATE}') THEN substr({c}, 2) ELSE {c} END)"


@named("plate_reads", sql(f"""SELECT plate, {_read("'S' || plate")} AS swedish, {_read("plate")} AS bare, translate({_read("'S' || plate")}, 'ÅÄÖ', 'AAO') = translate({_read("plate")}, 'ÅÄÖ', 'AAO') AS same, regexp_full_match(plate, '{V.PLATE}') AS shaped
FROM (SELECT DISTINCT plate FROM plates)""", "plates"))
def plate_reads(spark: SparkSession, d: str) -> DataFrame:
    """Plates as a picture shows them: after a nation letter and with blanks, against the plate itself."""
    shown, own = F.concat(F.lit("s "), F.lower("plate")), F.col("plate")
    rows = Pipeline(spark, d).plates.select("plate").distinct()
    return rows.select("plate", text.plate_read(shown).alias("swedish"), text.plate_read(own).alias("bare"), text.same_plate(shown, own).alias("same"), own.rlike(f"^{V.PLATE}$").alias("shaped"))


@named("coordinates", f"""SELECT file, CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR) AS typed, lat, lon FROM reports WHERE lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) > 0.001 AND abs(lon) > 0.001""")
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Positions written as a person types or pastes them, and read again."""
    at = F.concat(F.col("lat").cast("string"), F.lit(", "), F.col("lon").cast("string"))
    n = F.length("file") % 3
    typed = F.when(n == 0, at).when(n == 1, F.concat(F.lit("[plats](geo:"), at, F.lit(")"))).otherwise(F.concat(F.lit('location: "'), at, F.lit('"')))
    rows = Pipeline(spark, d).reports.filter("abs(lat) > 0.001 and abs(lon) > 0.001").select("file", at.alias("typed"), grid.coordinate(typed).alias("p"))
    return rows.select("file", "typed", "p.lat", "p.lon")


def _grid_sql(text_: str) -> str:
    """The position of the first grid in a text, from the definition of the grid and the inverse projection."""
    a, e2, k0 = grid.A, grid.E2, grid.K0
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    ep2 = e2 / (1 - e2)
    least = "CASE b " + " ".join(f"WHEN '{c}' THEN {k * 1000}" for c, k in zip(grid.BANDS, grid.BAND_NORTHING_KM)) + " END"
    return rf"""SELECT file, floor(degrees(phi - n * tan(phi) / r * (dd * dd / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {ep2}) * pow(dd, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {ep2} - 3 * c * c) * pow(dd, 6) / 720)) * 1e5 + 0.5) / 1e5 AS lat,
 floor(((zone - 1) * 6 - 177 + degrees((dd - (1 + 2 * t + c) * pow(dd, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {ep2} + 24 * t * t) * pow(dd, 5) / 120) / cos(phi))) * 1e5 + 0.5) / 1e5 AS lon
FROM (SELECT *, (east - 500000.0) / (n * {k0}) AS dd FROM (SELECT *, {a} / sqrt(1 - {e2} * sin(phi) * sin(phi)) AS n, {a} * (1 - {e2}) / pow(1 - {e2} * sin(phi) * sin(phi), 1.5) AS r, tan(phi) * tan(phi) AS t, {ep2} * cos(phi) * cos(phi) AS c
FROM (SELECT *, mu + {3 * e1 / 2 - 27 * e1**3 / 32} * sin(2 * mu) + {21 * e1**2 / 16 - 55 * e1**4 / 32} * sin(4 * mu) + {151 * e1**3 / 96} * sin(6 * mu) AS phi
FROM (SELECT *, (CASE WHEN b >= 'N' THEN north ELSE north - 10000000.0 END) / {k0} / ({a} * (1 - {e2} / 4 - 3 * {e2} * {e2} / 64 - 5 * {e2} * {e2} * {e2} / 256)) AS mu
FROM (SELECT file, zone, b, col * 100000 + CAST(substr(dg, 1, h) AS DOUBLE) * pow(10, 5 - h) AS east, CAST(substr(dg, h + 1, h) AS DOUBLE) * pow(10, 5 - h) + row0 + ceil(greatest(least - row0, 0) / 2000000.0) * 2000000 AS north
FROM (SELECT file, zone, b, dg, CAST(length(dg) // 2 AS INT) AS h, (((strpos('{grid.COLUMNS}', c1) - 1 - 8 * ((zone - 1) % 3)) % 24) + 24) % 24 + 1 AS col,
 ((((strpos('{grid.ROWS}', c2) - 1 - CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20) + 20) % 20) * 100000 AS row0, {least} AS least, strpos('{grid.ROWS}', c2) > 0 AND length(dg) % 2 = 0 AND zone BETWEEN 1 AND 60 AS good
FROM (SELECT file, CAST(regexp_extract(g, '^(\d+)', 1) AS INT) AS zone, regexp_extract(g, '^\d+([A-Z])', 1) AS b, regexp_extract(g, '^\d+[A-Z]([A-Z])', 1) AS c1, regexp_extract(g, '^\d+[A-Z]{{2}}([A-Z])', 1) AS c2, regexp_extract(g, '(\d+)$', 1) AS dg
FROM (SELECT file, regexp_replace(regexp_extract({text_}, '\b{V.GRID}\b'), '\s+', '', 'g') AS g FROM reports) WHERE g <> '') WHERE good AND least IS NOT NULL))))))"""


@named("grid_of_place", _grid_sql("plats"))
def grid_of_place(spark: SparkSession, d: str) -> DataFrame:
    """The position of the first grid in every report's place."""
    rows = Pipeline(spark, d).reports.select("file", grid.first_position(blank("plats")).alias("p"))
    return rows.filter(F.col("p").isNotNull()).select("file", "p.lat", "p.lon")


# --- files and models -------------------------------------------------------------


@named("parse_whole_files", rf"""SELECT file, id, typ, tnr, tidpunkt, plats, sagesman, kalla, bilagor, signal_avsandare_id, signal_tidpunkt, lat, lon, coords_from_mgrs, styrka, slag, sysselsattning, handelse, sedan, stalle, symbol, links, embeds FROM ({{body}})""".format(body=r"""
SELECT 'f' || i || '.md' AS file, '7S-' || i AS id, '7S-rapport' AS typ, lpad(CAST(i AS VARCHAR), 6, '0') AS tnr, '2018-06-04T09:05:00' AS tidpunkt, 'Björkdal' AS plats, 'AQ' AS sagesman, CASE WHEN i % 2 = 0 THEN 'radio' END AS kalla,
 CASE i % 3 WHEN 0 THEN 'bild' || i || '.jpg,b.txt' WHEN 1 THEN '' END AS bilagor, CASE WHEN i % 5 = 0 THEN 's' || i END AS signal_avsandare_id, CASE WHEN i % 5 = 0 THEN '2018-06-04T09:06:00Z' END AS signal_tidpunkt,
 CASE WHEN i % 4 = 0 THEN 59.5 + i / 1000.0 END AS lat, CASE WHEN i % 4 = 0 THEN 17.5 END AS lon, false AS coords_from_mgrs, CASE WHEN i % 2 = 0 THEN i || ' pers.' END AS styrka, NULL AS slag, NULL AS sysselsattning, 'En båt: röd' AS handelse, NULL AS sedan, 'vid bron' AS stalle, 'keps' AS symbol,
 CASE WHEN i % 2 = 0 THEN 'ABC12' || (i % 10) || '|bilen:plate-full,AB.123:plate-partial,märke:mark' ELSE '' END AS links, CASE WHEN i % 2 = 1 THEN 'c' || i || '.png' ELSE '' END AS embeds FROM range(300) t(i)"""))
def parse_whole_files(spark: SparkSession, d: str) -> DataFrame:
    """Report files with every field, damaged letters, comments, repeated keys and lists, read and laid out again."""
    i = F.col("id")
    n = i.cast("string")
    part = lambda test, *bits: F.when(test, F.concat(*[b if isinstance(b, Column) else F.lit(b) for b in bits])).otherwise("")
    always = F.lit(True)
    file_text = F.concat(
        part(always, "---\nid: 7S-", n, "\n# kommentar: nej\ntyp: 7S-rapport\ntnr: \"", F.lpad(n, 6, "0"), "\"\ntidpunkt: 2018-06-04T09:05:00\nplats: fel\nplats: BjÃ¶rkdal\nsagesman: 'AQ'\nokänd: x\n"),
        part(i % 2 == 0, "källa: radio\n"), part(i % 3 == 0, "bilagor: [\"bild", n, ".jpg\", b.txt]\n"), part(i % 3 == 1, "bilagor: []\n"),
        part(i % 5 == 0, "signal_avsandare_id: s", n, "\nsignal_tidpunkt: 2018-06-04T09:06:00Z\n"), part(i % 4 == 0, "lat: ", (59.5 + i / 1000.0).cast("string"), "\nlon: 17.5\n"),
        part(always, "---\n\n"), part(i % 2 == 0, "**Styrka:** ", n, " pers.\n"), part(always, "**Händelse:** förut\n**Händelse:** En bÃ¥t: rÃ¶d\n**Ställe:** vid bron\n**Symbol:** keps\n"),
        part(i % 2 == 0, "[[ABC12", (i % 10).cast("string"), "|bilen]] [[AB.123]] och [[märke]]\n"), part(i % 2 == 1, "![[c", n, ".png]]\n"),
    )
    files = spark.range(300).select(F.concat(F.lit("f"), n, F.lit(".md")).alias("file"), F.when(i % 7 == 0, F.replace(file_text, F.lit("\n"), F.lit("\r\n"))).otherwise(file_text).alias("text"))
    read = reports_md.parse(files)
    joined = lambda c: F.array_join(c, ",")
    links = F.transform("links", lambda x: F.concat(x["raw"], F.lit(":"), x["kind"]))
    return read.withColumns({"links": joined(links), "embeds": joined("embeds"), "bilagor": joined("bilagor")}).select(
        "file", *reports_md.HEADER, "kalla", "bilagor", "signal_avsandare_id", "signal_tidpunkt", "lat", "lon", "coords_from_mgrs", *reports_md.FIELDS.values(), "links", "embeds"
    )


@named("operator_maps", """WITH shot AS (SELECT file, list_sort(list(DISTINCT p)) AS plates FROM (SELECT file, unnest(photo_plates) AS p FROM reports) GROUP BY file),
shown AS (SELECT file, sum(w) AS weight, count(*) AS n FROM (SELECT file, b.weight AS w FROM (SELECT file, unnest(confirmed_behaviours) AS b FROM reports) UNION ALL SELECT file, 9 FROM reports WHERE length(file) % 3 = 0) GROUP BY file)
SELECT r.file, array_to_string(s.plates, ',') AS plates, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight, coalesce(w.n, 0) AS n FROM reports r LEFT JOIN shot s USING (file) LEFT JOIN shown w USING (file) WHERE r.typ = '7S-rapport'""")
def operator_maps(spark: SparkSession, d: str) -> DataFrame:
    """Reports joined with what operators decided about them: plates from pictures, confirmed behaviours, flags."""
    whole = Pipeline(spark, d)
    files = reports_md.rendered(whole.reports)
    plates = whole.reports.select("file", F.explode("photo_plates").alias("plate"))
    confirmed = whole.reports.select("file", F.inline("confirmed_behaviours"))
    flagged = whole.reports.filter(F.length("file") % 3 == 0).select("file")
    joined = reports_md.reports(files, plates, confirmed, flagged)
    weight = F.aggregate(F.coalesce("confirmed_behaviours", F.array().cast("array<struct<key:string,label:string,weight:int>>")), F.lit(0).cast("long"), lambda s, b: s + b["weight"])
    return joined.select("file", F.array_join("photo_plates", ",").alias("plates"), weight.alias("weight"), F.when(F.col("confirmed_behaviours").isNull(), 0).otherwise(F.size("confirmed_behaviours")).cast("long").alias("n"))


@named("photo_nominations", sql(f"""SELECT DISTINCT file, 'plate' AS kind, {_read("'S' || plate")} AS text FROM plates WHERE NOT partial AND regexp_full_match(plate, '{V.PLATE}')
UNION ALL SELECT file, 'vehicle', 'vit skåpbil' FROM plates WHERE NOT partial UNION ALL SELECT DISTINCT file, 'person', 'man, keps, kikare' FROM plates""", "plates"))
def photo_nominations(spark: SparkSession, d: str) -> DataFrame:
    """What a model's answers nominate: chatty JSON with plates, vehicles and a person for every report with a plate."""
    seen = Pipeline(spark, d).plates.groupBy("file").agg(F.collect_list(F.when(~F.col("partial"), F.struct(F.lit("skåpbil").alias("typ"), F.lit("okänd").alias("marke"), F.lit("vit").alias("farg"), F.concat(F.lit("S "), "plate").alias("skylt")))).alias("fordon"))
    person = F.array(F.struct(F.lit("man").alias("kon"), F.lit("-").alias("alder"), F.array(F.lit("keps")).alias("klader"), F.array(F.lit("kikare")).alias("utrustning")))
    answer = F.concat(F.lit("Svar: "), F.to_json(F.struct("fordon", person.alias("personer"))), F.lit(" klart."))
    return models.sighting_nominations(seen.select(F.col("file").alias("hash"), answer.alias("answer"))).select(F.col("hash").alias("file"), "kind", "text")


@named("photo_behaviours", sql("SELECT DISTINCT file, unnest(['beteende:optik', 'beteende:registrering']) AS key, 2 AS weight FROM plates", "plates"))
def photo_behaviours(spark: SparkSession, d: str) -> DataFrame:
    """Behaviours that people's equipment in pictures shows, the strongest of each."""
    person = F.array(F.struct(F.array(F.lit("Kikare"), F.lit("skissblock")).alias("utrustning"), F.array(F.lit("keps med kameralogga")).alias("klader")))
    answer = F.to_json(F.struct(person.alias("personer"), F.array(F.lit("en man")).alias("ovrigt")))
    return models.recon_behaviours(Pipeline(spark, d).plates.select(F.col("file").alias("hash")).distinct().select("hash", answer.alias("answer"))).select(F.col("hash").alias("file"), "key", "weight")


@named("text_findings", r"""SELECT mark_id, kind, key, label FROM (SELECT mark_id, 'behaviour' AS kind, 'optik' AS key, 'kikar' AS label FROM text_marks UNION ALL
SELECT mark_id, 'mark', array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(label), '[.,;:!?()"'']', ' ', 'g'), '\s+'), lambda x: x <> '' AND x NOT IN ('en', 'ett', 'den', 'det', 'med', 'och', 'i', 'på', 'av'))), ' '), label FROM text_marks WHERE label IS NOT NULL) WHERE key <> ''""")
def text_findings(spark: SparkSession, d: str) -> DataFrame:
    """Marks once per key and known behaviours once each, from a model's JSON about every mark."""
    acts = F.array(*[F.struct(F.lit(k).alias("begrepp"), F.lit(v).alias("fras")) for k, v in (("optik", "kikar"), ("nonsens", "x"), ("optik", "åter"))])
    answer = F.to_json(F.struct(F.array("label", "label").alias("kännetecken"), acts.alias("beteenden")))
    found = models.text_findings(Pipeline(spark, d).table("text_marks").select(F.col("mark_id").alias("hash"), answer.alias("answer")))
    return found.select(F.col("hash").alias("mark_id"), "kind", "key", "label")


@named("threat_concepts", " UNION ALL ".join(f"SELECT '{i.key}' AS key, '{i.label}' AS label, {i.weight} AS weight" for i in V.INDICATORS))
def threat_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The behaviours a model may choose from."""
    listed = F.array(*[F.struct(F.lit(i.key).alias("key"), F.lit(i.label).alias("label"), F.lit(i.weight).alias("weight")) for i in V.INDICATORS])
    return spark.range(1).select(F.inline(listed))


@named("eval_detection", sql("""SELECT *, CASE WHEN hits + false_alarms > 0 THEN round(hits / (hits + false_alarms), 6) ELSE 1 END AS precision, CASE WHEN hits + missed > 0 THEN round(hits / (hits + missed), 6) ELSE 1 END AS recall FROM (
SELECT count(*) FILTER (WHERE e.file IS NOT NULL AND p) AS hits, count(*) FILTER (WHERE e.file IS NOT NULL AND NOT p) AS false_alarms, count(*) FILTER (WHERE e.file IS NULL AND p) AS missed
FROM (SELECT file, coalesce(len(confirmed_behaviours), 0) > 0 AS p FROM reports) r LEFT JOIN elevated e USING (file))""", "elevated"))
def eval_detection(spark: SparkSession, d: str) -> DataFrame:
    """How elevated reports agree with those whose behaviour was confirmed."""
    whole = Pipeline(spark, d)
    truth = whole.reports.select(F.col("file").alias("item"), (F.coalesce(F.size("confirmed_behaviours"), F.lit(0)) > 0).alias("positive"))
    got = evaluation.detection(whole.elevated.select(F.col("file").alias("item")), truth)
    return got.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


# --- questions --------------------------------------------------------------------


def ask(name: str, sentence: str, checked: str) -> None:
    """Registers a question asked in words."""
    named(name, checked)(lambda spark, d: questions.answer(questions.parse(sentence), Pipeline(spark, d).views))


_TOP = "(SELECT canonical FROM ents ORDER BY count DESC, canonical LIMIT 1)"
_CRAFTS = "SELECT 'farkost' AS part, c.file AS ref, concat_ws(' ', CASE WHEN e.file IS NOT NULL THEN '⚠' END, c.type, CASE WHEN c.plated AND w.k = 1 THEN w.p END) AS text, 1 AS n, coalesce(r.tidpunkt, '') AS tidpunkt FROM crafts c JOIN reports r USING (file) LEFT JOIN elevated e ON e.file = c.file LEFT JOIN (SELECT file, count(DISTINCT plate) AS k, min(plate) AS p FROM plates WHERE NOT partial GROUP BY file) w ON w.file = c.file"
_REPORTS = "SELECT 'observation' AS part, file AS ref, coalesce(plats, '') AS text, 1 AS n, coalesce(tidpunkt, '') AS tidpunkt FROM reports"
_MINUTE = r"(try_cast(nullif(regexp_extract(tidpunkt, 'T(\d{2}):(\d{2})', 1), '') AS INT) * 60 + try_cast(nullif(regexp_extract(tidpunkt, 'T(\d{2}):(\d{2})', 2), '') AS INT))".replace("\\\\", "\\")

ask("ask_guard", "Är det samma person?", f"SELECT 'spärr' AS part, '' AS ref, '{questions.REFUSAL}' AS text, 0 AS n, '' AS tidpunkt")
ask("ask_mark_dossier", "visa entitet antenn", sql("SELECT 'kännetecken' AS part, m.file AS ref, coalesce(r.plats, '') AS text, 1 AS n, coalesce(r.tidpunkt, '') AS tidpunkt FROM members m JOIN reports r USING (file) WHERE m.signature = (SELECT signature FROM noms WHERE contains(lower(signature), 'antenn') OR contains(lower(label), 'antenn') ORDER BY object, signature LIMIT 1)", "members", "noms"))
ask("ask_marks", "visa kännetecken", sql("SELECT 'kännetecken' AS part, signature AS ref, label AS text, count AS n, last_seen AS tidpunkt FROM noms", "noms"))
ask("ask_vehicles", "lista fordon", sql("SELECT 'fordon' AS part, e.canonical AS ref, coalesce(p.kinds, '') AS text, e.count AS n, e.last_seen AS tidpunkt FROM ents e LEFT JOIN plated p USING (canonical)", "ents", "crafts", "plates", extra=_PLATED))
ask("ask_vehicles_at", "vilka fordon vid Berga", _REPORTS + " WHERE contains(lower(plats), 'berga') AND len(list_filter(links, lambda x: x.kind IN ('plate-full', 'plate-partial'))) > 0")
ask("ask_marks_by", "vilka märken från AQ", sql(_REPORTS + " WHERE contains(upper(sagesman), 'AQ') AND file IN (SELECT file FROM members)", "members"))
ask("ask_craft", "visa alla båtar", sql(f"SELECT * FROM ({_CRAFTS} WHERE c.type = 'båt')", "crafts", "elevated", "plates"))
ask("ask_craft_by_time", "tidslinje båt kl 6-18", sql(f"SELECT * FROM ({_CRAFTS} WHERE c.type = 'båt' AND {_MINUTE.replace('tidpunkt', 'r.tidpunkt')} BETWEEN 360 AND 1080)", "crafts", "elevated", "plates"))
ask("ask_places", "lista platser", sql("SELECT 'plats' AS part, place AS ref, CASE WHEN predefined THEN 'fördefinierad' ELSE '' END AS text, reports AS n, '' AS tidpunkt FROM keys", "claims", extra=_PLACES))
_FOUND = "(SELECT place FROM keys WHERE contains(lower(place), 'udden') ORDER BY elevated DESC, reports DESC, place LIMIT 1)"
ask("ask_place", "visa platsen vid udden", sql(f"SELECT 'observation' AS part, file AS ref, concat_ws(' ', CASE WHEN elevated THEN '⚠' END, array_to_string(list_sort(plates), ', ')) AS text, 1 AS n, coalesce(tidpunkt, '') AS tidpunkt FROM claims WHERE place = {_FOUND}", "claims", extra=_PLACES))
ask("ask_alarms", "lista larm", sql("SELECT 'larm' AS part, e.file AS ref, coalesce(p.phrases, '') AS text, e.score AS n, coalesce(e.tidpunkt, '') AS tidpunkt FROM elevated e LEFT JOIN phrased p USING (file)", "elevated", "phrased"))
ask("ask_recurring", "återkommande minst 3", sql("SELECT 'fordon' AS part, canonical AS ref, '' AS text, count AS n, last_seen AS tidpunkt FROM ents WHERE count >= 3 UNION ALL SELECT 'kännetecken', signature, label, count, last_seen FROM noms WHERE count >= 3", "ents", "noms"))
ask("ask_search", "regnet hade?", _REPORTS.replace("'observation'", "'träff'") + " WHERE coalesce(contains(lower(handelse), 'regnet hade'), false) OR coalesce(contains(lower(symbol), 'regnet hade'), false) OR coalesce(contains(lower(plats), 'regnet hade'), false) OR coalesce(len(list_filter(links, lambda x: contains(lower(x.raw), 'regnet hade'))) > 0, false)")
ask("ask_timeline", "tidslinje vid Berga på kvällen kväll", f"{_REPORTS} WHERE contains(lower(plats), 'berga') AND {_MINUTE} BETWEEN 1080 AND 1320")
ask("ask_actors", "lista aktörer", over_actors("SELECT 'aktör' AS part, id AS ref, types AS text, facets AS n, '' AS tidpunkt FROM allacts"))
ask("ask_overview", "sammanfatta läget", over_actors("""SELECT 'antal' AS part, 'Rapporter' AS ref, '' AS text, count(*) AS n, '' AS tidpunkt FROM reports UNION ALL SELECT 'antal', 'Fordon', '', count(*), '' FROM ents UNION ALL SELECT 'antal', 'Kännetecken', '', count(*), '' FROM noms
UNION ALL SELECT 'antal', 'Aktörer', '', count(*), '' FROM allacts UNION ALL SELECT 'antal', 'Platser', '', count(*), '' FROM keys UNION ALL SELECT 'antal', 'Larm', '', count(*), '' FROM elevated UNION ALL SELECT 'antal', 'Farkoster', '', count(*), '' FROM crafts WHERE threat > 0
UNION ALL (SELECT 'larm', file, '', score, coalesce(tidpunkt, '') FROM elevated ORDER BY score DESC, tidpunkt NULLS FIRST, tnr NULLS FIRST, file LIMIT 5) UNION ALL (SELECT 'plats', place, '', elevated, '' FROM keys WHERE elevated > 0 ORDER BY elevated DESC, reports DESC, place LIMIT 3)
UNION ALL (SELECT 'farkost', c.file, c.type, 1, coalesce(r.tidpunkt, '') FROM crafts c JOIN reports r USING (file) WHERE threat > 0 ORDER BY r.tidpunkt DESC NULLS LAST, c.file, c.type LIMIT 5)""", "ents", "noms", "claims", "crafts", extra=_PLACES))
ask("ask_place_summary", "sammanfatta läget vid udden", over_actors(f"""SELECT 'rapporter' AS part, place AS ref, '' AS text, count(*) AS n, '' AS tidpunkt FROM claims WHERE place = {_FOUND} GROUP BY place
UNION ALL (SELECT 'larm', e.file, coalesce(p.phrases, ''), e.score, coalesce(e.tidpunkt, '') FROM elevated e LEFT JOIN phrased p USING (file) WHERE e.file IN (SELECT file FROM claims WHERE place = {_FOUND}) OR trim(e.plats) = {_FOUND} ORDER BY e.score DESC, e.tidpunkt NULLS FIRST, e.file LIMIT 6)
UNION ALL SELECT 'fordon', canonical, '', count, '' FROM ents WHERE canonical IN (SELECT unnest(plates) FROM claims WHERE place = {_FOUND})
UNION ALL (SELECT 'farkost', c.file, c.type, 1, coalesce(r.tidpunkt, '') FROM crafts c JOIN reports r USING (file) WHERE trim(r.plats) = {_FOUND} ORDER BY r.tidpunkt NULLS FIRST, c.file, c.type LIMIT 10)
UNION ALL SELECT DISTINCT 'aktör', actor, '', 1, '' FROM allsteps WHERE trim(plats) = {_FOUND}""", "ents", "claims", "crafts", "phrased", extra=_PLACES))


@named("ask_vehicle", sql(f"SELECT 'fordon' AS part, file AS ref, canonical AS text, 1 AS n, coalesce(tidpunkt, '') AS tidpunkt FROM obs WHERE canonical = {_TOP}", "ents", "obs"))
def ask_vehicle(spark: SparkSession, d: str) -> DataFrame:
    """The dossier of the vehicle seen most."""
    whole = Pipeline(spark, d)
    top = whole.vehicles.orderBy(F.col("count").desc(), "canonical").first()
    return questions.answer(questions.parse(f"visa entitet {top['canonical'] if top else '-'}"), whole.views)


@named("ask_actor", over_actors("SELECT 'facett' AS part, facet AS ref, type AS text, 1 AS n, '' AS tidpunkt FROM held WHERE actor = (SELECT a.id FROM allacts a WHERE EXISTS (SELECT 1 FROM held h WHERE h.actor = a.id AND contains(lower(h.facet), 'antenn')) ORDER BY facets DESC, id LIMIT 1) UNION ALL SELECT 'kedja', file, coalesce(plats, ''), 1, coalesce(tidpunkt, '') FROM allsteps WHERE actor = (SELECT a.id FROM allacts a WHERE EXISTS (SELECT 1 FROM held h WHERE h.actor = a.id AND contains(lower(h.facet), 'antenn')) ORDER BY facets DESC, id LIMIT 1)"))
def ask_actor(spark: SparkSession, d: str) -> DataFrame:
    """The dossier of the actor that has a mark."""
    return questions.answer(questions.Question("detail", "aktor", term="antenn"), Pipeline(spark, d).views)
