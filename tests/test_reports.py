import math

from pyspark.sql import functions as F

from beaconry.functions import grid, text
from beaconry.operators import actors, craft, decisions, feeds, identifiers, marks, merges, orders, places, suspects, suspicion, vehicles
from beaconry.plans import core
from beaconry.sources import notes

SCHEMA = """file string, id string, tnr string, tidpunkt string, plats string, lat double, lon double, sagesman string, signal_avsandare_id string, stalle string, handelse string, symbol string,
links array<struct<raw:string,kind:string>>, photo_plates array<string>, confirmed_behaviours array<struct<key:string,label:string,weight:int>>, batch_no int"""
PLACES = "name string, seq int, lat double, lon double, radius_m double, sensitive boolean"


def reports(spark, *rows):
    names = [x.split()[0] for x in SCHEMA.replace("\n", " ").replace("struct<raw:string,kind:string>", "x").replace("struct<key:string,label:string,weight:int>", "x").split(",")]
    return spark.createDataFrame([tuple({"file": f"r{i}", "tnr": f"0409{i:02}", "tidpunkt": f"2018-06-04T12:{i:02}:00"}.get(n) if n not in r else r[n] for n in names) for i, r in enumerate(rows)], SCHEMA)


def test_linked_plate_wins_over_prose(spark):
    df = reports(spark, {"links": [("RJK 241|bilen", "plate-full"), ("märke", "mark")], "handelse": "RJK241 vid 33VXF6665179308, 850101-1234", "photo_plates": [" "], "signal_avsandare_id": ""})
    got = sorted((r.type, r.value, r.source) for r in identifiers.identifiers(df).collect())
    assert got == [("mgrs", "33VXF6665179308", "prose-handelse"), ("personnummer", "850101-1234", "prose-handelse"), ("plate", "RJK241", "link")]


def test_partial_plates(spark):
    df = reports(spark, {"links": [("ABC123", "plate-full")]}, {"links": [("AB.123", "plate-partial")]}, {"links": [("XYZ999", "plate-full"), ("XYZ998", "plate-full")]},
                 {"links": [("XYZ99.", "plate-partial")]}, {"links": [("WWW...", "plate-partial")]}, {"links": [("......", "plate-partial")]})
    got = {r.partial: r.n for r in vehicles.partial_matches(identifiers.plates(df)).collect()}
    assert got == {"AB.123": 1, "XYZ99.": 2, "WWW...": 0, "......": 3}
    seen = {r.canonical: (r.kind, r["count"], r.resolved) for r in vehicles.entities(vehicles.observations(df)).collect()}
    assert seen["ABC123"] == ("fordon-reg-full", 2, ["AB.123"]) and seen["XYZ99."] == ("fordon-reg-partiell", 1, []) and "AB.123" not in seen


def test_plates_under_every_mask_are_not_broadcast(spark):
    rows = [("ABC123", False), ("ABC124", False), ("XYZ999", False), ("ABC12.", True), ("AB.12.", True), ("......", True), ("XYZ99.", True), ("WWW...", True)]
    mentions = spark.createDataFrame(rows, "plate string, partial boolean").repartition(2)
    several, counted = vehicles.candidates(mentions), vehicles.partial_matches(mentions)
    assert sorted(tuple(r) for r in several.collect()) == [("......", "ABC123"), ("......", "ABC124"), ("......", "XYZ999"), ("AB.12.", "ABC123"), ("AB.12.", "ABC124"), ("ABC12.", "ABC123"), ("ABC12.", "ABC124")]
    assert {r.partial: (r.n, r.only) for r in counted.collect()} == {"ABC12.": (2, None), "AB.12.": (2, None), "......": (3, None), "XYZ99.": (1, "XYZ999"), "WWW...": (0, None)}
    assert not any("BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString() for df in (several, counted))


def test_lists_of_vehicle_notes_are_not_broadcast(spark):
    seen = [("ABC123", "fordon-reg-full", "AQ", None), ("ABC123", "fordon-reg-full", "BQ", "A.C123"), ("XYZ99.", "fordon-reg-partiell", "AQ", "XYZ99."), ("WWW...", "fordon-reg-partiell", "", "WWW...")]
    rows = [(c, kind, f"r{i}", "", "", "", who, read) for i, (c, kind, who, read) in enumerate(seen)]
    observed = spark.createDataFrame(rows, "canonical string, kind string, file string, tnr string, tidpunkt string, plats string, sagesman string, as_read string").repartition(2)
    mentions = spark.createDataFrame([("XYZ998", False), ("XYZ999", False), ("XYZ99.", True), ("WWW...", True)], "plate string, partial boolean").repartition(2)
    made = notes.vehicle_notes(observed, vehicles.entities(observed), vehicles.candidates(mentions))
    told = {r.path: r.text for r in made.collect()}
    assert set(told) == {"ABC123.md", "XYZ99_.md", "WWW___.md"}
    assert "**Sagesmän:** AQ, BQ\n**Partiella observationer:** A.C123\n" in told["ABC123.md"] and "**Möjliga registreringsnummer:** XYZ998, XYZ999\n" in told["XYZ99_.md"]
    assert "_Ingen matchande fullständig regplåt observerad._" in told["WWW___.md"]
    assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_comparing_vehicle_notes_broadcasts_nothing(spark):
    def made(*seen):
        observed = spark.createDataFrame([(c, "fordon-reg-partiell", f"r{i}", "", "", "", "", c) for i, c in enumerate(seen)], "canonical string, kind string, file string, tnr string, tidpunkt string, plats string, sagesman string, as_read string").repartition(2)
        mentions = spark.createDataFrame([("XYZ998", False), ("XYZ999", False), *[(c, True) for c in seen]], "plate string, partial boolean").repartition(2)
        return notes.vehicle_notes(observed, vehicles.entities(observed), vehicles.candidates(mentions))

    done = notes.upsert(made("XYZ99.", "WWW..."), made("XYZ99."), "jobb-a")
    assert sorted((r.path, r.action) for r in done.collect()) == [("WWW___.md", "pruned"), ("XYZ99_.md", "unchanged")]
    assert "BroadcastExchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_both_halves_of_vehicle_notes_read_the_texts_once_and_broadcast_nothing(spark, tmp_path, monkeypatch):
    linked = lambda batch, *plates: {"batch_no": batch, "links": [(p, "plate-partial" if "." in p else "plate-full") for p in plates]}
    rows = reports(spark, linked(1, "ABC123"), linked(1, "XYZ99.", "XYZ999"), linked(2, "KLM555"), linked(3, "XYZ998"), linked(3, "ABC123"), linked(None, "WWW111"), {"batch_no": 4})
    rows.repartition(2).write.parquet(str(tmp_path / "reports.parquet"))
    read, plates = [], identifiers.plates
    monkeypatch.setattr(identifiers, "plates", lambda *given: read.append(given) or plates(*given))
    done = core.queries()["vehicle_notes"](spark, str(tmp_path))
    assert sorted((r.path, r.action) for r in done.collect()) == [
        ("ABC123.md", "written"), ("KLM555.md", "unchanged"), ("WWW111.md", "pruned"), ("XYZ998.md", "pruned"), ("XYZ999.md", "written"), ("XYZ99_.md", "pruned")
    ]
    assert len(read) == 1 and "BroadcastExchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_marks_open_take_details_and_close(spark):
    df = reports(spark, {"symbol": "svart ryggsäck, märke på sidan. jacka"}, {"symbol": "ryggsäck svart och emblem"}, {"symbol": "utan ryggsäck"}, {"symbol": "kikare"}, {"handelse": "Dekal på bakrutan, otydlig"}, {"symbol": None})
    got = [(r.file, r.signature, r.distinctive) for r in marks.marks(df).orderBy("file").collect()]
    assert got == [("r0", "ryggsack#farg:mörk|marking:ja", True), ("r1", "ryggsack#farg:mörk|marking:ja", True), ("r3", "optik#", False), ("r4", "fordon-dekal#position:bak|marking:ja", True)]
    (only,) = marks.nominations(marks.marks(df)).collect()
    assert (only.signature, only["count"], only.label) == ("ryggsack#farg:mörk|marking:ja", 2, "mörk ryggsäck (märke)")


def test_craft_words_and_stems(spark):
    df = reports(spark, {"handelse": "En bild på mobilmasten"}, {"handelse": "Drönarobservation", "symbol": "lastbil RJK241"}, {"handelse": "bil ABC123 och bil DEF456"})
    got = sorted((r.file, r.type, r.plate) for r in craft.craft(df).collect())
    assert got == [("r1", "drönare", None), ("r1", "lastbil", "RJK241"), ("r2", "bil", None)]


def test_scores_add_up_with_reasons(spark):
    df = reports(spark, {"handelse": "en drönare", "tidpunkt": "2018-06-04T12:00:00"}, {"lat": 59.2622, "lon": 17.712, "tidpunkt": "2018-06-04T23:00:00"}, {"tidpunkt": "okänt"},
                 {"confirmed_behaviours": [("beteende:optik", "a", 1), ("beteende:optik", "b", 9)], "tidpunkt": "2018-06-04T06:59:00"})
    places_ = spark.createDataFrame([("Depå", 1, 59.2622, 17.712, 100.0, True)], PLACES)
    got = {r.file: (r.score, [x.key for x in r.reasons]) for r in suspicion.score(df, places_).collect()}
    assert got["r0"] == (5, ["beteende:optik", "farkost:drönare"])
    assert got["r1"][0] == 5 and got["r1"][1][1] == "natt" and len(got["r1"][1]) == 2
    assert got["r2"] == (0, []) and got["r3"] == (2, ["skymning", "beteende:optik"])


def test_suspects_and_places(spark):
    df = reports(spark, {"handelse": "en drönare", "plats": "Berga", "symbol": "Röd keps"}, {"handelse": "en drönare", "plats": " Berga ", "symbol": "röd keps"}, {"plats": "Berga"}, {"plats": "Depå"}, {"lat": 59.0, "lon": 17.0, "plats": "Annan"})
    places_ = spark.createDataFrame([("Depå", 1, 59.0, 17.0, 100.0, None), ("Vid", 2, 59.0, 17.0, 500.0, None), ("Tom", 3, 10.0, 10.0, None, None)], PLACES)
    hot = suspicion.elevated(suspicion.score(df, places_))
    (one,) = suspects.suspects(suspects.sightings(df, hot)).collect()
    assert (one.agent, one.n, one.behaving) == ("person:röd keps", 2, True)
    located = {r.place: (r.reports, r.elevated, r.predefined) for r in places.locations(places.claims(df, hot, places_), places_).collect()}
    assert located == {"Berga": (2, 2, False), "Depå": (2, 0, True), "Vid": (0, 0, True), "Tom": (0, 0, True)}


def test_components_by_threshold(spark):
    sighted = spark.createDataFrame([("f:a", "fordon", "a", "m1"), ("m:b", "marke:x", "b", "m1"), ("m:b", "marke:x", "b", "m2"), ("f:c", "fordon", "c", "m2"), ("f:a", "fordon", "a", "m3"), ("m:b", "marke:x", "b", "m3")], "facet string, type string, label string, file string")
    for threshold, facets in ((1, 3), (2, 2)):
        (found,) = actors.actors(sighted, actors.label_components(actors.edges(sighted, threshold))).collect()
        assert (found.facets, found.root) == (facets, "f:a")
    assert actors.edges(sighted, 3).count() == 0


def test_merge_chains_and_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("p", "x"), (None, "q")], "absorbed string, survivor string")
    got = {r.absorbed: r.survivor for r in merges.survivors(df).collect()}
    assert got == {"a": "c", "b": "c", "x": "x", "y": "y", "p": "y"}


def test_feed_and_watch(spark):
    items = spark.createDataFrame([("p", "a", 1, 0), ("p", "b", 2, 1), ("p", "c", 2, 2), ("q", "d", 3, 3)], "path string, kind string, time long, seq long")
    assert [(r.path, r.kind) for r in feeds.feed(items, 1).collect()] == [("q", "d")]
    assert {(r.path, r.kind) for r in feeds.feed(items).collect()} == {("q", "d"), ("p", "b")}
    entries = spark.createDataFrame([("fordon", "A", 1), ("händelse", "r", 0), ("fordon", "B", -1), ("fordon", "C", 5)], "kind string, ref string, baseline int")
    states = spark.createDataFrame([("fordon", "A", 4, "t"), ("händelse", "r", 1, "t"), ("fordon", "B", 3, "t")], "kind string, ref string, count int, last_seen string")
    assert {r.ref: r.fresh for r in feeds.watch(entries, states).collect()} == {"A": 3, "r": 0, "B": 0, "C": 0}


def test_grids_round_trip(spark):
    """A forward projection of our own, written from the definition, against the grid reader."""

    def forward(lat, lon, zone):
        k0, a, e2 = 0.9996, 6378137.0, 0.00669438
        ep2, phi, lam = e2 / (1 - e2), math.radians(lat), math.radians(lon - (zone * 6 - 183))
        n, t, c, x = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, lam * math.cos(phi)
        m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
                 + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
        east = k0 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * x**5 / 120) + 500000
        north = k0 * (m + n * math.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * x**6 / 720))
        return east, north

    rows = []
    for zone, lat, lon in ((33, 59.33, 17.7), (34, 59.33, 19.5), (33, 55.5, 12.5), (34, 62.1, 21.0), (33, 68.0, 16.2), (32, 57.5, 11.9)):
        east, north = forward(lat, lon, zone)
        band = grid.BANDS[int((lat + 80) // 8)]
        column = grid.COLUMNS[(8 * ((zone - 1) % 3) + int(east // 100000) - 1) % 24]
        row = grid.ROWS[(int(north // 100000) + (5 if zone % 2 == 0 else 0)) % 20]
        rows.append((f"{zone}{band}{column}{row} {int(east % 100000):05} {int(north % 100000):05}", lat, lon))
    got = spark.createDataFrame(rows, "g string, lat double, lon double").select("*", grid.position(F.col("g")).alias("p")).collect()
    for r in got:
        assert abs(r.p.lat - r.lat) < 5e-5 and abs(r.p.lon - r.lon) < 1e-4, r
    odd = spark.createDataFrame([("33VXF123",), ("",), (None,), ("33VXF12345678901",), ("99VXF1234",)], "g string").select(grid.position(F.col("g")).alias("p")).collect()
    assert [r.p is None for r in odd] == [True, True, True, True, True]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.short_hash(F.lit("abc")).alias("hash"), text.plate_read(F.lit("s abc-123")).alias("read"), text.same_plate(F.lit("ÅBC12A"), F.lit("abc12a")).alias("same"),
        text.mark_key(F.lit("En röd, ryggsäck med märke!")).alias("key"), text.level(F.lit(6)).alias("level"), text.number_from_time(F.lit("2018-06-04T09:05:00")).alias("number"),
        text.repaired(F.lit("HÃ¶glandet Â 5")).alias("mended"), text.half_up(F.lit(-2.5)).alias("half"), text.link_kind(F.lit("ABC12.|x")).alias("link"),
    ).first()
    assert (row.hash, row.read, row.same, row.key, row.level, row.number) == ("3772q3", "ABC123", True, "märke ryggsäck röd", "Förhöjd", "040905")
    assert (row.mended, row.half, row.link) == ("Höglandet  5", -2, "plate-partial")


def test_orders_without_one_task(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 503).alias("x"), F.lit(1).alias("n"))
    got = {r.x: r.nth for r in orders.in_order(df.repartition(7), F.col("x").desc()).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got, reverse=True), 1)} and len(got) == 500
    assert orders.in_order(df.limit(0), F.col("x")).count() == 0


def test_decisions_are_a_log(spark):
    log = [("mark", "a", "confirmed", "1", 1), ("mark", "b", "rejected", "1", 2), ("mark", "a", None, "2", 3), ("mark", "c", "confirmed", "1", 4), ("actor", "*", None, "3", 5), ("actor", "x", "confirmed", "2", 6),
           ("actor", "y", "confirmed", "4", 7), (None, "z", "v", "1", 8), ("area", "59.1,17.2", "Norr", "5", 9), ("area", "59.1,17.2", "Nord", "6", 10), ("mark", "d", "confirmed", "7", 11)]
    df = spark.createDataFrame(log, decisions.LOG)
    stands = lambda x: {(r.map, r.key, r.value) for r in decisions.state(x).collect() if r.map != "area"}
    assert stands(df) == {("mark", "b", "rejected"), ("mark", "c", "confirmed"), ("actor", "y", "confirmed"), ("mark", "d", "confirmed")}
    # The first area wipes what came before it, the new name of the same area nothing.
    assert stands(decisions.area_changes(df)) == {("mark", "d", "confirmed")}
    assert decisions.any_judgement(decisions.state(df)).first().any and not decisions.any_judgement(decisions.state(df.limit(0))).first().any
    found = spark.createDataFrame([("b",), ("q",)], "signature string")
    assert {r.signature: r.decision for r in decisions.decided(found, decisions.state(df), "mark", "signature").collect()} == {"b": "rejected", "q": None}


def test_places_as_typed(spark):
    rows = [("Grind", "59.1, 17.2", None), (" ", "59.1,17.2", "20"), ("A", "här", "20"), ("B", "[x](geo:59.5,17.5)", "9"), ("C", 'location: "59.5,17.5"', "10.4"), ("D", "33VXF6665179308", "x"), (None, None, None)]
    got = [(r.lat, r.lon, r.radius_m, r.problem) for r in decisions.placed(spark.createDataFrame(rows, "name string, at string, radius string")).collect()]
    assert got[0] == (59.1, 17.2, 100, None) and [g[3] for g in got] == [None, "name", "position", "radius", None, None, "name"] and got[4][2] == 10 and round(got[5][0], 2) == 59.32


def test_merged_actors_count_once(spark):
    held = spark.createDataFrame([("a", "f1", "fordon"), ("a", "m1", "marke:x"), ("b", "f1", "fordon"), ("b", "f2", "fordon"), ("c", "f3", "fordon")], "actor string, facet string, type string")
    chain = spark.createDataFrame([("a", "r1", "2"), ("b", "r1", "2"), ("b", "r2", "1"), ("c", "r9", "")], "actor string, file string, tidpunkt string")
    closed = spark.createDataFrame([("b", "a")], "absorbed string, survivor string")
    got = {r.actor: tuple(r)[1:] for r in actors.folded(held, chain, closed).collect()}
    assert got == {"a": (3, 2, 1, 2, "1", "2"), "c": (1, 1, 0, 1, "", "")}


def test_long_merge_chains_reach_their_end(spark):
    merged = spark.createDataFrame([(f"i{k:03}", f"i{k + 1:03}") for k in range(70)], "absorbed string, survivor string")
    assert {r.survivor for r in merges.survivors(merged).collect()} == {"i070"}
