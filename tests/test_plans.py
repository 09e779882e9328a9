import datetime as dt
import json
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from beaconry.operators import evaluation, feeds
from beaconry.plans import core, derived, questions
from beaconry.sources import models, notes, reports_md
from beaconry.streaming import pipeline, replay

SMALL = "/root/testdata/sf0.001"
NOTE = """---
id: 7S-1
typ: 7S-rapport
tnr: "040905"
tidpunkt: 2018-06-04T09:05:00
plats: BjÃ¶rkdal
sagesman: AQ
bilagor: ["a.jpg", 'b.txt']
# kommentar: nej
plats: Björkdal
---

**Ställe:** 33VXF6665179308
**Händelse:** En bil [[ABC123|bilen]] och ![[c.png]]
**Händelse:** En båt
"""


def test_parse_a_report_file(spark):
    files = spark.createDataFrame([("a.md", NOTE), ("b.md", "utan huvud"), ("c.md", "---\r\nid: x\r\nlat: 59.1\r\nlon: 17\r\n---\r\nhej"), ("d.md", "")], "file string, text string")
    got = {r.file: r for r in reports_md.parse(files).collect()}
    a = got["a.md"]
    assert (a.id, a.tnr, a.plats, a.sagesman, a.handelse, a.bilagor, a.embeds) == ("7S-1", "040905", "Björkdal", "AQ", "En båt", ["a.jpg", "b.txt"], ["c.png"])
    assert (round(a.lat, 3), round(a.lon, 3), a.coords_from_mgrs) == (59.32, 17.928, True)
    assert [(x.raw, x.kind) for x in a.links] == [("ABC123|bilen", "plate-full")]
    assert (got["c.md"].id, got["c.md"].lat, got["c.md"].coords_from_mgrs, got["b.md"].id) == ("x", 59.1, False, "")
    assert reports_md.issues(reports_md.parse(files)).count() == 5


def test_reports_come_back_from_their_files(spark):
    rows = [("a", "7S-1", "7S-rapport", "040905", "2018-06-04T09:05:00", "Berga", "AQ", 59.25, 17.5, None, None, "4 pers.", None, None, "En bil: röd", None, "Berga", "röd keps")]
    names = ["file", *reports_md.HEADER, "lat", "lon", "signal_avsandare_id", "signal_tidpunkt", *reports_md.FIELDS.values()]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n in ('lat', 'lon') else 'string'}" for n in names))
    back = reports_md.parse(reports_md.rendered(df)).first()
    assert {n: back[n] for n in names} == df.first().asDict()


def test_map_seeds(spark):
    texts = ['---\nlocation: "59.1,17.2"\n---\n', "---\nlocation: [59.1, 17.2]\n---\n", "---\nlocation: 59.1,17.2\ntyp: x\n---\n", "---\nlocation: 99,17\n---\n", "x"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reports_md.map_seed(F.col("t")).alias("s")).collect()]
    assert [s and (s.lat, s.lon) for s in got] == [(59.1, 17.2), (59.1, 17.2), None, None, None]


def test_notes_are_owned_written_kept_and_pruned(spark):
    ours = lambda m, x: f"---\ngenerator: 7s-plugin\nmetod: {m}\n---\n{x}"
    current = spark.createDataFrame([("same", ours("a", 1)), ("old", ours("a", 1)), ("other", ours("b", 1)), ("theirs", "egen"), ("blank", " "), ("gone", ours("a", 9))], "path string, text string")
    desired = spark.createDataFrame([("same", ours("a", 1)), ("old", ours("a", 2)), ("theirs", ours("a", 3)), ("blank", ours("a", 4)), ("new", ours("a", 5))], "path string, text string")
    done = notes.upsert(current, desired, "a")
    assert {r.path: r.action for r in done.collect()} == {"same": "unchanged", "old": "written", "theirs": "skipped", "blank": "written", "new": "written", "gone": "pruned"}
    again = notes.upsert(notes.applied(current, done), desired, "a")
    assert {r.action for r in again.collect()} == {"unchanged", "skipped"}


def test_questions(spark):
    ask = questions.parse
    assert ask("Är ABC123 samma fordon?").guard
    assert (ask("visa ABC123").target, ask("visa ABC123").term) == ("fordon", "ABC123")
    assert ask("återkommande fordon minst 3").least == 3 and ask("fordon sedda mer än en gång").least == 2
    assert (ask("visa drönarobservationer").target, ask("visa drönarobservationer").term) == ("farkost", "drönare")
    assert ask("larm mellan 22 och 5 vid Berga").window == (1320, 300) and ask("larm mellan 22 och 5 vid Berga").place == "berga"
    assert ask("larm kl. 21:30–23").window == (1290, 1380) and ask("larm mellan husen").window is None
    assert ask("vad har CQ sett").observer == "CQ" and ask("tidslinje larm på natten").shape == "timeline" and ask("sammanfatta läget").shape == "summary"
    assert ask("rapporter från en granne").observer is None and ask("misstänkt person").target == "larm" and ask("röd keps").target == "kannetecken"
    assert questions.echo(ask("larm mellan 22 och 5 vid Berga")) == 'mål=larm, form=list, tid=22:00–05:00, plats~"berga"'
    assert questions.echo(ask("")) == "mål=alla, form=list" and ask("???").term == ""
    rows = [("a", "2018-06-04T23:00:00", "Berga", "AQ", "en bil", None, []), ("b", "2018-06-04T12:00:00", "Berga", "BQ", None, "en bil", None), ("c", "okänt", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "file string, tidpunkt string, plats string, sagesman string, handelse string, symbol string, links array<struct<raw:string,kind:string>>")
    views = {"reports": lambda: df}
    assert [r.ref for r in questions.answer(questions.Question("list", "alla", window=(1320, 300), place="berga", observer="AQ"), views).collect()] == ["a"]
    assert sorted(r.ref for r in questions.answer(questions.Question("list", "alla", term="en bil"), views).collect()) == ["a", "b"]
    assert questions.answer(questions.Question("list", "alla", term="e"), views).count() == 0
    (refused,) = questions.answer(ask("Är det samma person?"), views).collect()
    assert refused.text == questions.REFUSAL and refused.n == 0
    assert questions.cited("<think>nej</think> kort", "se [[a]] och [[b]] och [[a]]") == "kort [[a]] [[b]]"


def test_answers_of_models_are_nominations(spark):
    good = {"fordon": [{"typ": "skåpbil", "farg": "vit", "skylt": "S ABC123"}, {"skylt": "DEF456", "farg": "okänd"}], "personer": [{"kon": "man", "klader": ["keps"]}]}
    answers = spark.createDataFrame([("h1", "Här: " + json.dumps(good) + " klart"), ("h2", "inget"), ("h3", None)], "hash string, answer string")
    got = {(r.kind, r.text, r.conflict) for r in models.sighting_nominations(answers).collect()}
    assert got == {("plate", "ABC123", True), ("plate", "DEF456", True), ("vehicle", "vit skåpbil", False), ("person", "man, keps", False)}
    texts = spark.createDataFrame([("t", json.dumps({"kännetecken": ["röd keps", "keps, röd"], "beteenden": [{"begrepp": "optik", "fras": "a"}, {"begrepp": "nonsens", "fras": "b"}]}))], "hash string, answer string")
    assert {(r.kind, r.key, r.label) for r in models.text_findings(texts).collect()} == {("mark", "keps röd", "röd keps"), ("behaviour", "optik", "a")}
    contents = spark.createDataFrame([("h1", "x"), ("h1", "x"), ("h2", "y"), ("h3", "z")], "hash string, text string")
    cache = spark.createDataFrame([("h1", "m", "1", "{}"), ("h2", "m", "0", "{}")], "hash string, model string, prompt string, answer string")
    asked = models.asked_once(contents, cache, "m", "1", lambda xs: [None if x == "z" else x.upper() for x in xs], "text").collect()
    assert [(r.hash, r.answer) for r in asked] == [("h2", "Y")]
    segment = lambda kind, data: b"\xff" + bytes([kind]) + (len(data) + 2).to_bytes(2, "big") + data
    picture = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xFE, b"PLATE:abc 123") + segment(0xDA, b"") + segment(0xFE, b"PLATE:no")
    assert [models.comments(x) for x in (picture, b"", None, b"\xff\xd8\xff")] == [["PLATE:abc 123"], [], [], []]


def test_evaluation(spark):
    p = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "item string, group int")
    t = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "item string, group int")
    r = evaluation.pair_agreement(p, t).first()
    assert (r.pairs_found, r.pairs_true, r.pairs_both, r.recall) == (3, 2, 1, 0.5)
    d = evaluation.detection(spark.createDataFrame([("a",), ("d",)], "item string"), spark.createDataFrame([("a", True), ("b", True), ("d", False)], "item string, positive boolean")).first()
    assert (d.hits, d.false_alarms, d.missed) == (1, 1, 1)


def test_stream_alerts_once(spark, tmp_path):
    schema = "file string, id string, signal_avsandare_id string, signal_tidpunkt string, received_at timestamp"
    row = lambda f, i: (f, i, "s", None, dt.datetime(2018, 6, 4))
    alerts = lambda df: df.select(F.concat(F.lit("k:"), "id").alias("key"), F.lit("x").alias("kind"), F.col("file").alias("title"), F.lit(1).alias("rank"))
    state = str(tmp_path / "state")
    go = lambda n, *rows: sorted(r.key for r in pipeline.take_batch(spark.createDataFrame(list(rows), schema), n, state, alerts).collect())
    assert go(0, row("a", "7S-00001")) == []
    assert go(1, row("b", "7S-00002"), row("c", "00001")) == ["k:7S-00002"]
    assert go(1, row("b", "7S-00002"), row("c", "00001")) == ["k:7S-00002"]
    assert go(2, row("d", "7s-00002"), row("b", "7S-00002"), row("e", "7S-00003")) == ["k:7S-00003"]


def test_stream_tells_lost_ids_apart_over_batches(spark, tmp_path):
    schema = "file string, id string, signal_avsandare_id string, signal_tidpunkt string, received_at timestamp"
    row = lambda f, i, second: (f, i, "s", f"2018-06-04T09:00:0{second}Z", dt.datetime(2018, 6, 4))
    alerts = lambda df: df.select(F.col("file").alias("key"), F.lit("x").alias("kind"), F.lit("t").alias("title"), F.lit(1).alias("rank"))
    go = lambda n, *rows: sorted(r.key for r in pipeline.take_batch(spark.createDataFrame(list(rows), schema), n, str(tmp_path / "state"), alerts).collect())
    go(0, row("a", "7S-00001", 1))
    assert go(1, row("b", None, 1), row("c", None, 2)) == ["c"]
    assert go(2, row("d", "7S-00002", 2)) == []
    assert go(2, row("d", "7S-00002", 2)) == []
    # 7S-00002 was left out as a copy of c, and answers for it: 7S-00003 of the same second is a message of its own.
    assert go(3, row("e", "7S-00003", 2), row("f", "00002", 3)) == ["e"]


def test_stream_end_to_end(spark, tmp_path):
    schema = "file string, id string, signal_avsandare_id string, signal_tidpunkt string, received_at timestamp"
    inbox, seen = tmp_path / "in", []
    alerts = lambda df: df.select(F.col("id").alias("key"), F.lit("x").alias("kind"), F.lit("t").alias("title"), F.lit(1).alias("rank"))
    put = lambda n, i: spark.createDataFrame([(f"f{n}", i, "s", None, dt.datetime(2018, 6, 4))], schema).coalesce(1).write.mode("append").parquet(str(inbox))
    put(0, "7S-00001")
    query = pipeline.run(spark.readStream.schema(schema).parquet(str(inbox)), str(tmp_path / "s"), str(tmp_path / "c"), alerts, lambda df, n: seen.append(sorted(r.key for r in df.collect())), "0 seconds")
    query.processAllAvailable()
    put(1, "7S-00002")
    query.processAllAvailable()
    query.stop()
    assert [x for x in seen if x] == [["7S-00002"]]


def test_replay_keeps_order_and_gap(spark):
    df = spark.createDataFrame([("a", "040900"), ("b", "040901"), ("c", "040901"), ("d", "041000"), ("x", "fel"), ("y", None)], "file string, tnr string")
    assert [(r.file, r.at_s) for r in replay.schedule(df, 60.0, 2.0).orderBy("at_s").collect()] == [("a", 0.0), ("b", 2.0), ("c", 4.0), ("d", 60.0)]


def test_demo_schedule_replays_every_day(spark, tmp_path):
    pick = random.Random(5)
    rows = [(f"f{i:03}", f"{pick.choice([4, 6, 7, 30]):02}{pick.randint(0, 2):02}{pick.randint(0, 9):02}") for i in range(300)] + [("x", "fel"), ("y", None)]
    spark.createDataFrame(rows, "file string, tnr string").repartition(3).write.parquet(str(tmp_path / "reports.parquet"))
    minute = lambda t: int(t[:2]) * 1440 + int(t[2:4]) * 60 + int(t[4:])
    queue = sorted((minute(t), f) for f, t in rows[:300])
    expected, at = {}, None
    for m, file in queue:
        ideal = (m - queue[0][0]) * 60 / 60.0
        at = ideal if at is None else max(ideal, at + 2.0)
        expected[file] = at
    assert {r.file: r.at_s for r in core.q_demo_schedule(spark, str(tmp_path)).collect()} == expected


def test_new_alerts_of_all_kinds(spark, tmp_path):
    every, before = str(tmp_path / "all"), str(tmp_path / "before")
    reports = core.reports_of(spark, SMALL).withColumn("batch_no", (F.crc32("file") % 10).cast("int"))
    for folder, rows in ((every, reports), (before, reports.filter("batch_no <= 4"))):
        rows.write.parquet(f"{folder}/reports.parquet")
        core.places_of(spark, SMALL).write.parquet(f"{folder}/predefined_places.parquet")
    seen = {r.key for r in core.alerts_of(spark, before).collect()}
    expected = sorted((r.key, r.rank) for r in core.alerts_of(spark, every).collect() if r.key not in seen)
    assert {k.split(":")[0] for k, _ in expected} == {"förhöjd", "aktör", "märke", "fordon"}
    assert sorted((r.key, r.rank) for r in core.q_alerts_new(spark, every).collect()) == expected


def test_feed_has_what_waits_and_what_was_found(spark):
    rows = [(f"r{i}", f"0409{i:02}", f"2018-06-04T09:{i:02}:00", p) for i, p in enumerate(["33VXF 66651 79308", "Berga", "33VXF11112222", "33VXF33334444", None])]
    reports = spark.createDataFrame(rows, "file string, tnr string, tidpunkt string, plats string")
    hot = spark.createDataFrame([("r2",), ("r1",)], "file string")
    plates = spark.createDataFrame([("r0", "ABC123", False), ("r3", "A.C123", True)], "file string, plate string, partial boolean")
    named = spark.createDataFrame([("33VXF11112222",)], "place string")
    places = lambda **more: [(r.path, r.kind, feeds.PINNED - r.time) for r in feeds.place_items(reports, hot, plates, **more).orderBy(F.desc("time")).collect()]
    assert places() == [("review:place:33VXF 66651 79308", "namnge-plats", 4), ("review:place:33VXF11112222", "namnge-plats", 5)]
    assert places(named=named, running=1) == [("review:place:33VXF 66651 79308", "namnge-plats", 5)]
    told = spark.createDataFrame([("a", "2018-06-04T09:00:00"), ("b:c", "")], "ref string, last_seen string")
    decided = spark.createDataFrame([("b:c", "confirmed")], "ref string, decision string")
    assert [(r.path, r.time) for r in feeds.confirmed_items(told, decided, "aktör").collect()] == [("b_c.md", 0)]
    pending = lambda *x: [(r.path, r.kind, feeds.PINNED - r.time) for r in feeds.pending_items(told, "förslag-märke", 1, *x).collect()]
    assert pending() == pending(decided) == [("review:marks", "förslag-märke", 1)]
    assert pending(told.select("ref", F.lit("rejected").alias("decision"))) == []
    top = derived.feed_top60(spark, SMALL).collect()
    assert len(top) == 60 and [r.time for r in top] == sorted((r.time for r in top), reverse=True)
    assert {"förslag-aktör", "förslag-bild", "bildanalys", "textanalys", "namnge-plats"} <= {r.kind for r in top} and top[0].path == "review:actors"
    running = spark.createDataFrame([("r2",), ("r1",), ("r2",)], "file string")
    assert [(r.path, feeds.PINNED - r.time) for r in feeds.running_items(running, "bildanalys", 4).orderBy("path").collect()] == [("bildanalys:r1", 4), ("bildanalys:r2", 5)]
    row = lambda kind, **x: (kind, x.get("tnr"), x.get("plats"), x.get("label"), x.get("count"), x.get("phrases", ""))
    shown = spark.createDataFrame([row("larm", plats="Berga", phrases="natt"), row("förslag-märke", count=3), row("mottaget", tnr="040905"), row("bevakad", label="A", count=2)], "kind string, tnr string, plats string, label string, count int, phrases string")
    assert [(r.text, r.severity) for r in feeds.labelled(shown).collect()] == [("⚠ Misstänkt aktivitet — Berga (natt)", "larm"), ("🎒 3 kopplingsförslag att granska →", "review"), ("Meddelande TNR040905 mottaget", "info"), ("🔭 Bevakad: A — +2 nya observationer", "bevakad")]
    seen = spark.createDataFrame([("A.C 1", "1970-01-01T00:01:00")], "canonical string, last_seen string")
    assert [(r.path, r.kind, r.time) for r in feeds.vehicle_items(seen).collect()] == [("A_C_1.md", "fordon", 60)]
    watched = spark.createDataFrame([("fordon", "A", "1970-01-01T00:01:00", 2), ("fordon", "B", "", 0)], "kind string, ref string, last_seen string, fresh int")
    assert [(r.path, r.kind, r.time) for r in feeds.watch_items(watched).collect()] == [("bevakad:fordon:A", "bevakad", 60)]


def test_core_runs_without_the_training_data_part():
    code = "import sys; sys.modules['beaconry.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and not any(k.startswith('p2') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_every_checking_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", k) for k in __spark_entry__.queries())
    assert pytest
