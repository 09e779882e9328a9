"""Named parts of the checking SQL, put together by what a query names.

Each part restates an operator in plain relational SQL over the raw tables, from
the vocabulary and nothing else of the engine.
"""

from __future__ import annotations

import re

from ..functions import vocabulary as V
from ..functions.instants import SQL_EPOCH


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    cell = lambda x: _quote(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quote(w)})" for w in words) + ")"


def distance(a: str, b: str) -> str:
    """Metres between the lat and lon of two aliases."""
    return (
        f"2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + "
        f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


VALID = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
_WORDS = "[^a-zåäö0-9]"


def _named(craft: V.Craft) -> str:
    words = "|".join(craft.words)
    tests = [f"regexp_matches(t, '(^|{_WORDS})({words})({_WORDS}|$)')"] + [f"contains(t, '{s}')" for s in craft.stems]
    return " OR ".join(tests)


PARTS: dict[str, str] = {
    "prose": "SELECT file, 1 AS turn, handelse AS x FROM reports UNION ALL SELECT file, 2, stalle FROM reports UNION ALL SELECT file, 3, symbol FROM reports",
    "found": rf"""SELECT file, 'plate' AS type, upper(regexp_replace(split_part(l.raw, '|', 1), '\s+', '', 'g')) AS value, l.kind = 'plate-partial' AS partial, 0 AS turn
  FROM (SELECT file, unnest(links) AS l FROM reports) WHERE l.kind LIKE 'plate-%'
UNION ALL SELECT file, 'plate', regexp_replace(v, '\s+', '', 'g'), false, turn FROM (SELECT file, turn, unnest(regexp_extract_all(x, '\b({V.PLATE_PROSE})\b', 1)) AS v FROM prose)
UNION ALL SELECT file, 'personnummer', replace(v, '+', '-'), false, turn FROM (SELECT file, turn, unnest(regexp_extract_all(x, '\b({V.PERSON_NUMBER})\b', 1)) AS v FROM prose)
UNION ALL SELECT file, 'mgrs', upper(regexp_replace(v, '\s+', '', 'g')), false, turn FROM (SELECT file, turn, unnest(regexp_extract_all(x, '\b({V.GRID})\b', 1)) AS v FROM prose)
UNION ALL SELECT file, 'plate', upper(regexp_replace(p, '\s+', '', 'g')), false, 4 FROM (SELECT file, unnest(photo_plates) AS p FROM reports) WHERE trim(p) <> ''
UNION ALL SELECT file, 'sender', signal_avsandare_id, false, 5 FROM reports WHERE signal_avsandare_id <> ''""",
    "ids": "SELECT file, type, value, partial, min(turn) AS turn FROM found GROUP BY file, type, value, partial",
    "plates": "SELECT file, value AS plate, partial, turn FROM ids WHERE type = 'plate'",
    "fits": """SELECT p.plate AS partial, count(f.plate) AS n, min(f.plate) AS sole FROM (SELECT DISTINCT plate FROM plates WHERE partial) p
  LEFT JOIN (SELECT DISTINCT plate FROM plates WHERE NOT partial) f ON regexp_full_match(f.plate, p.plate) GROUP BY p.plate""",
    "obs": """SELECT CASE WHEN p.partial AND n = 1 THEN sole ELSE p.plate END AS canonical, CASE WHEN p.partial AND n <> 1 THEN 'fordon-reg-partiell' ELSE 'fordon-reg-full' END AS kind,
  r.file, r.tnr, r.tidpunkt, r.plats, r.sagesman, CASE WHEN p.partial THEN p.plate END AS as_read FROM plates p JOIN reports r USING (file) LEFT JOIN fits ON p.partial AND fits.partial = p.plate""",
    "ents": """SELECT canonical, kind, count(*) AS count, coalesce(min(nullif(tidpunkt, '')), '') AS first_seen, coalesce(max(nullif(tidpunkt, '')), '') AS last_seen,
  coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT unnest(list(o.sagesman)) AS s) WHERE s <> ''), '') AS observers FROM obs o GROUP BY canonical, kind""",
    "things": "SELECT file, lower(concat_ws('. ', nullif(handelse, ''), nullif(symbol, ''))) AS t FROM reports",
    "crafts": " UNION ALL ".join(
        f"SELECT file, {i} AS turn, {_quote(c.key)} AS type, {_quote(c.medium)} AS medium, {str(c.plated).lower()} AS plated, {c.threat} AS threat FROM things WHERE {_named(c)}"
        for i, c in enumerate(V.CRAFTS)
    ),
    "said": "SELECT file, lower(coalesce(handelse, '') || ' ' || coalesce(symbol, '')) AS t FROM reports",
    "stems": "SELECT * FROM " + values([(f"beteende:{x.key}", i, x.weight, j, s) for i, x in enumerate(V.INDICATORS) for j, s in enumerate(x.stems)]) + " v(key, turn, weight, nth, stem)",
    "behaviour": "SELECT file, key, turn, min(weight) AS weight, arg_min(stem, nth) AS stem FROM said JOIN stems ON contains(t, stem) GROUP BY file, key, turn",
    "hours": "SELECT file, try_cast(nullif(regexp_extract(tidpunkt, 'T(\\d{2}):', 1), '') AS INT) AS h FROM reports",
    "anchors": f"""SELECT -1 AS seq, 'objektet' AS name, CAST({V.OBJECT_LAT} AS DOUBLE) AS lat, CAST({V.OBJECT_LON} AS DOUBLE) AS lon, CAST(800 AS DOUBLE) AS b1, CAST(1600 AS DOUBLE) AS b2, CAST(3000 AS DOUBLE) AS b3
  UNION ALL SELECT seq, name, lat, lon, greatest(1, radius_m), 2 * greatest(1, radius_m), 4 * greatest(1, radius_m) FROM predefined_places WHERE sensitive AND radius_m IS NOT NULL""",
    "near": f"""SELECT * FROM (SELECT file, seq, name, d, CASE WHEN d < b1 THEN 3 WHEN d < b2 THEN 2 WHEN d < b3 THEN 1 END AS weight,
   row_number() OVER (PARTITION BY file ORDER BY CASE WHEN d < b1 THEN 3 WHEN d < b2 THEN 2 ELSE 1 END DESC, d, seq) AS nth
  FROM (SELECT r.file, a.seq, a.name, a.b1, a.b2, a.b3, {distance("r", "a")} AS d FROM (SELECT file, lat, lon FROM reports WHERE {VALID}) r, anchors a) WHERE d < b3) WHERE nth = 1""",
    "confirmed": """SELECT file, b.key AS key, b.weight AS weight, i FROM (SELECT file, unnest(confirmed_behaviours) AS b, generate_subscripts(confirmed_behaviours, 1) AS i FROM reports)""",
    "reasons": """SELECT file, CASE WHEN seq = -1 THEN 'proximity' ELSE 'känslig-plats' END AS key, weight, 0 AS turn FROM near
UNION ALL SELECT file, CASE WHEN h >= 22 OR h < 5 THEN 'natt' ELSE 'skymning' END, CASE WHEN h >= 22 OR h < 5 THEN 2 ELSE 1 END, 1 FROM hours WHERE h >= 21 OR h < 7
UNION ALL SELECT file, key, weight, 10 + turn FROM behaviour
UNION ALL SELECT c.file, c.key, arg_min(c.weight, c.i), 100 + min(c.i) FROM confirmed c LEFT JOIN behaviour b ON b.file = c.file AND b.key = c.key WHERE b.key IS NULL GROUP BY c.file, c.key
UNION ALL SELECT file, 'farkost:' || type, threat, 100000 + turn FROM crafts WHERE threat > 0""",
    "scores": """SELECT r.file, r.tnr, r.tidpunkt, r.plats, r.sagesman, r.lat, r.lon, coalesce(s.score, 0) AS score, coalesce(s.keys, '') AS keys FROM reports r
  LEFT JOIN (SELECT file, CAST(sum(weight) AS INT) AS score, string_agg(key, ',' ORDER BY turn) AS keys FROM reasons GROUP BY file) s USING (file)""",
    "elevated": f"SELECT * FROM scores WHERE score >= {V.ELEVATED_FROM}",
    "agents": """SELECT r.file, CASE WHEN p.plate IS NOT NULL THEN 'fordon:' || p.plate ELSE 'person:' || coalesce(lower(nullif(trim(r.symbol, E' \\t\\n\\r '), '')), r.tnr, '') END AS agent,
  CASE WHEN p.plate IS NOT NULL THEN 'fordon' ELSE 'person' END AS kind FROM reports r
  LEFT JOIN (SELECT file, arg_min(plate, (partial, plate)) AS plate FROM plates GROUP BY file) p USING (file)""",
    "suspects": """SELECT agent, min(kind) AS kind, count(*) AS n, max(score) AS top, bool_or(keys LIKE '%beteende:%') AS behaving,
  arg_min(coalesce(tidpunkt, ''), (tidpunkt, tnr, file)) AS first_seen, arg_max(coalesce(tidpunkt, ''), (tidpunkt, tnr, file)) AS last_seen FROM elevated JOIN agents USING (file) GROUP BY agent""",
    "covering": f"""SELECT file, arg_min(seq, (d, seq)) AS seq, arg_min(name, (d, seq)) AS name, min(d) AS d FROM (SELECT r.file, p.seq, p.name, p.radius_m, {distance("r", "p")} AS d
  FROM (SELECT file, lat, lon FROM reports WHERE {VALID}) r, predefined_places p WHERE p.radius_m IS NOT NULL) WHERE d <= radius_m GROUP BY file""",
    "based": r"""SELECT r.file, r.tnr, r.tidpunkt, r.lat, r.lon, trim(coalesce(r.plats, ''), E' \t\n\r ') AS place, e.file IS NOT NULL AS elevated, coalesce(p.plates, []) AS plates FROM reports r
  LEFT JOIN elevated e USING (file) LEFT JOIN (SELECT file, list_sort(list(plate)) AS plates FROM plates WHERE NOT partial GROUP BY file) p USING (file)""",
    "claims": """SELECT b.place, b.file, b.tidpunkt, b.elevated, b.plates, b.lat, b.lon, n.name IS NOT NULL AS predefined FROM based b LEFT JOIN predefined_places n ON n.name = b.place
  WHERE b.place <> '' AND (n.name IS NOT NULL OR b.elevated OR len(b.plates) > 0)
UNION ALL SELECT c.name, b.file, b.tidpunkt, b.elevated, b.plates, b.lat, b.lon, true FROM based b JOIN covering c USING (file) WHERE c.name <> b.place""",
    "clauses": r"""SELECT file, tnr, tidpunkt, sagesman, pos, trim(c) AS clause, lower(trim(c)) AS l FROM (SELECT file, tnr, tidpunkt, sagesman, unnest(parts) AS c, generate_subscripts(parts, 1) AS pos FROM
  (SELECT file, tnr, tidpunkt, sagesman, regexp_split_to_array(regexp_replace(concat_ws('. ', nullif(handelse, ''), nullif(symbol, '')), '!?\[\[[^\]]*\]\]', ' ', 'g'), '(?i)[.,]|\b(?:och|samt)\b') AS parts FROM reports))
  WHERE trim(c) <> ''""",
    "judged": f"""SELECT *, CASE {" ".join(f"WHEN contains(l, {_quote(w)}) THEN {_quote(c)}" for w, c, _ in V.RARE_ITEMS)} END AS rare,
 CASE {" ".join(f"WHEN contains(l, {_quote(w)}) THEN {_quote(i)}" for w, _, i in V.RARE_ITEMS)} END AS item,
 CASE {" ".join(f"WHEN contains(l, {_quote(w)}) THEN {_quote(o)}" for w, o in V.MARK_OBJECTS)} END AS thing,
 {any_of("l", V.MARKINGS)} AS marked, {any_of("l", V.REAR)} AS rear, {any_of("l", V.GENERIC)} AS generic, {any_of("l", V.UNCLEAR)} AS unclear,
 regexp_matches(l, '\\b({"|".join(V.NEGATIONS)})\\b') AS negated,
 regexp_matches(l, '\\b({"|".join(w for w, c in V.MARK_COLOURS if c == "mörk")})\\b') AS dark, regexp_matches(l, '\\b({"|".join(w for w, c in V.MARK_COLOURS if c == "ljus")})\\b') AS light,
 {any_of("l", tuple(w for w, t in V.OPTIC_TYPES if t == "teleobjektiv"))} AS o1, {any_of("l", tuple(w for w, t in V.OPTIC_TYPES if t == "nattkikare"))} AS o2,
 contains(l, 'värmekamera') AS o3, contains(l, 'drönar') AS o4, regexp_matches(l, '\\b-?tac\\b') AS tac, regexp_matches(l, '\\bdge\\b') AS dge FROM clauses""",
    "opened": """SELECT *, coalesce(rare, thing, CASE WHEN marked AND rear THEN 'fordon-dekal' END) AS opens,
  dark OR light OR marked OR o1 OR o2 OR o3 OR o4 OR unclear OR rear OR tac OR dge AS shows FROM judged""",
    "islands": """SELECT *, sum(CASE WHEN opens IS NOT NULL OR generic OR negated OR NOT shows THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS island FROM opened""",
    "attrs": """SELECT DISTINCT file, island, dim, value FROM (SELECT file, island, unnest([CASE WHEN rare IS NOT NULL THEN {'dim': 'item', 'value': item} END,
  CASE WHEN rare IS NULL AND dark THEN {'dim': 'farg', 'value': 'mörk'} END, CASE WHEN rare IS NULL AND light THEN {'dim': 'farg', 'value': 'ljus'} END,
  CASE WHEN rare IS NULL AND marked THEN {'dim': 'marking', 'value': 'ja'} END, CASE WHEN rare IS NULL AND rear THEN {'dim': 'position', 'value': 'bak'} END,
  CASE WHEN rare IS NULL AND o1 THEN {'dim': 'typ', 'value': 'teleobjektiv'} END, CASE WHEN rare IS NULL AND o2 THEN {'dim': 'typ', 'value': 'nattkikare'} END,
  CASE WHEN rare IS NULL AND o3 THEN {'dim': 'typ', 'value': 'värmekamera'} END, CASE WHEN rare IS NULL AND o4 THEN {'dim': 'typ', 'value': 'drönare'} END,
  CASE WHEN rare IS NULL AND unclear THEN {'dim': 'synlighet', 'value': 'otydlig'} END, CASE WHEN rare IS NULL AND tac THEN {'dim': 'text', 'value': 'TAC'} END,
  CASE WHEN rare IS NULL AND dge THEN {'dim': 'text', 'value': 'DGE'} END], recursive := true)
  FROM islands) WHERE dim IS NOT NULL""",
    "led": """SELECT file, island, min(tnr) AS tnr, min(tidpunkt) AS tidpunkt, min(sagesman) AS sagesman, arg_min(opens, pos) AS object, count(*) AS clauses FROM islands GROUP BY file, island
  HAVING arg_min(opens IS NOT NULL, pos) AND NOT arg_min(negated, pos) AND island > 0""",
    "dims": "SELECT * FROM " + values([(o, d, i) for o, ds in V.SIGNATURE_DIMS.items() for i, d in enumerate(ds)]) + " v(object, dim, nth)",
    "parts": "SELECT l.file, l.island, d.dim, d.nth, string_agg(a.value, ',' ORDER BY a.value) AS v FROM led l JOIN dims d USING (object) LEFT JOIN attrs a ON a.file = l.file AND a.island = l.island AND a.dim = d.dim GROUP BY ALL",
    "marks": """SELECT l.*, l.object || '#' || coalesce(g.s, '') AS signature, g.d AS distinctive FROM led l
  JOIN (SELECT file, island, string_agg(dim || ':' || v, '|' ORDER BY nth) FILTER (WHERE v IS NOT NULL) AS s, bool_and(v IS NOT NULL) AS d FROM parts GROUP BY file, island) g USING (file, island)""",
    "members": "SELECT *, count(*) OVER (PARTITION BY signature) AS times FROM (SELECT signature, file, min(object) AS object, min(tidpunkt) AS tidpunkt, min(sagesman) AS sagesman FROM marks WHERE distinctive GROUP BY signature, file) QUALIFY times >= 2",
    "heads": """SELECT m.signature, m.object, m.file, m.island FROM marks m JOIN (SELECT DISTINCT signature FROM members) USING (signature) WHERE m.distinctive
  QUALIFY row_number() OVER (PARTITION BY m.signature ORDER BY m.tidpunkt NULLS FIRST, m.tnr NULLS FIRST, m.file, m.island) = 1""",
    "nouns": "SELECT * FROM " + values(list(V.MARK_NOUNS.items())) + " v(object, noun)",
    "named": """SELECT h.signature, concat_ws(' ', string_agg(a.value, '/' ORDER BY a.value) FILTER (WHERE a.dim = 'farg'), n.noun) AS head,
  concat_ws(', ', CASE WHEN bool_or(a.dim = 'marking') THEN 'märke' END, CASE WHEN bool_or(a.dim = 'synlighet') THEN 'otydligt' END, CASE WHEN bool_or(a.dim = 'position') THEN 'bak' END,
  string_agg(a.value, ', ' ORDER BY a.dim, a.value) FILTER (WHERE a.dim IN ('item', 'typ')), string_agg(a.value, '/' ORDER BY a.value) FILTER (WHERE a.dim = 'text')) AS extras
  FROM heads h JOIN nouns n USING (object) LEFT JOIN attrs a ON a.file = h.file AND a.island = h.island GROUP BY h.signature, n.noun""",
    "noms": """SELECT m.signature, min(m.object) AS object, any_value(head || CASE WHEN extras <> '' THEN ' (' || extras || ')' ELSE '' END) AS label, count(*) AS count,
  coalesce(min(nullif(tidpunkt, '')), '') AS first_seen, coalesce(max(nullif(tidpunkt, '')), '') AS last_seen,
  coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT unnest(list(m.sagesman)) AS s) WHERE s <> ''), '') AS observers FROM members m JOIN named USING (signature) GROUP BY m.signature""",
    "facet": "SELECT DISTINCT 'fordon:' || canonical AS facet, 'fordon' AS type, file FROM obs UNION SELECT 'marke:' || signature, 'marke:' || object, file FROM members",
    "tied": "SELECT x.facet AS a, y.facet AS b, count(*) AS weight FROM facet x JOIN facet y ON x.file = y.file AND x.facet < y.facet GROUP BY 1, 2",
    "hyps": r"""SELECT 'suspect-' || regexp_replace(agent, '[\\/:*?"<>|.\s#]', '_', 'g') AS id, agent AS facet, kind, n, first_seen, last_seen FROM suspects WHERE n > 1 OR behaving""",
    "shown": """SELECT r.file, r.key, r.weight, r.turn, CASE r.key """
    + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in V.REASON_PHRASES.items())
    + """ ELSE CASE WHEN r.key LIKE 'farkost:%' THEN substr(r.key, 9) WHEN r.key = 'känslig-plats' THEN CASE r.weight WHEN 3 THEN 'nära ' WHEN 2 THEN 'i närområdet av ' ELSE 'i vidare område kring ' END || n.name
  ELSE (SELECT any_value(trim(regexp_replace(b.label, '\\s*\\(\\+\\d+\\)', '', 'g'))) FROM (SELECT file AS f, unnest(confirmed_behaviours) AS b FROM reports) WHERE f = r.file AND b.key = r.key) END END AS phrase
  FROM reasons r LEFT JOIN near n ON n.file = r.file""",
    "phrased": """SELECT file, string_agg(phrase, ', ' ORDER BY turn) AS phrases FROM (SELECT file, phrase, min(turn) AS turn FROM shown WHERE phrase <> '' GROUP BY file, phrase) GROUP BY file""",
    "arrivals": f"SELECT file AS path, coalesce({SQL_EPOCH.format(c='tidpunkt')}, 0) AS time FROM reports",
}
NEEDS = {name: [other for other in PARTS if other != name and re.search(rf"\b{other}\b", re.sub(r"'[^']*'", "''", sql))] for name, sql in PARTS.items()}


def short_hash(text: str) -> str:
    """The djb2 hash of a text in base 36."""
    return f"lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296), 36))"


def reach(least: int = 1) -> str:
    """Actors of edges of a weight: reach, comps (facet, root), acts, lone suspects and allacts (id, root, facets, vehicles, marks, types)."""
    return rf"""reach AS (SELECT a AS u, a AS v FROM tied WHERE weight >= {least} UNION SELECT b, b FROM tied WHERE weight >= {least}
  UNION SELECT r.u, e.b FROM reach r JOIN (SELECT a, b FROM tied WHERE weight >= {least} UNION ALL SELECT b, a FROM tied WHERE weight >= {least}) e ON e.a = r.v),
comps AS (SELECT u AS facet, min(v) AS root FROM reach GROUP BY u),
verts AS (SELECT DISTINCT facet, type, root FROM facet JOIN comps USING (facet)),
raw AS (SELECT root, count(*) AS facets, count(*) FILTER (WHERE type = 'fordon') AS vehicles, count(*) FILTER (WHERE type <> 'fordon') AS marks, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
  CAST(sum(CAST(('0x' || substr(md5(facet), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM verts GROUP BY root HAVING count(DISTINCT type) >= 2),
acts AS (SELECT 'aktor-' || regexp_replace(regexp_replace(root, '^(fordon|marke):', ''), '[^\p{{L}}\p{{N}}]+', '_', 'g') || '-' || facets || 'f-' || {short_hash("digest")} AS id, * EXCLUDE (digest) FROM raw),
chain AS (SELECT a.id, f.file FROM facet f JOIN comps USING (facet) JOIN acts a USING (root) GROUP BY a.id, f.file HAVING count(DISTINCT f.facet) > 1),
"""


#: The same with the suspects that no actor has.
ALL_ACTORS = """lone AS (SELECT * FROM hyps WHERE facet NOT IN (SELECT facet FROM verts JOIN acts USING (root))),
allacts AS (SELECT id, root, facets, vehicles, marks, types FROM acts UNION ALL SELECT id, facet, 1, CAST(kind = 'fordon' AS INT), CAST(kind <> 'fordon' AS INT), CASE WHEN kind = 'fordon' THEN 'fordon' ELSE 'person' END FROM lone),
held AS (SELECT a.id AS actor, v.facet, v.type FROM verts v JOIN acts a USING (root) UNION ALL SELECT id, facet, CASE WHEN kind = 'fordon' THEN 'fordon' ELSE 'person' END FROM lone),
steps AS (SELECT id AS actor, file FROM chain UNION ALL SELECT l.id, g.file FROM lone l JOIN agents g ON g.agent = l.facet JOIN elevated USING (file)),
allsteps AS (SELECT s.actor, r.file, r.tnr, r.tidpunkt, r.plats FROM steps s JOIN reports r USING (file))"""


def actors(select: str, *names: str, least: int = 1, extra: str = "") -> str:
    """``select`` over actors and whatever else it names."""
    return sql(select, "facet", "tied", "hyps", "elevated", "agents", *names, recursive=reach(least) + ALL_ACTORS, extra=extra)


def _order(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            earlier = [x for x in NEEDS[name] if list(PARTS).index(x) < list(PARTS).index(name)]
            _order(earlier, done)
            done.append(name)
    return done


def sql(select: str, *names: str, recursive: str = "", extra: str = "") -> str:
    """``select`` after the parts it names and theirs, then parts of its own."""
    parts = [f"{name} AS ({PARTS[name]})" for name in _order(list(names), [])] + [x for x in (recursive, extra) if x]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + select
