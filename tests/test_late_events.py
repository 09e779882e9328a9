import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconry.functions.instants import epoch_seconds, hour_label
from beaconry.operators import late_events

SCHEMA = "file string, tidpunkt string, signal_tidpunkt string, cell int, period string"


def test_spellings_of_one_instant(spark):
    same = ["2018-06-04T08:58:00", " 2018-06-04t08:58:00 ", "2018-06-04 08:58:00", "20180604T085800", "2018-06-04T08:58", "2018-06-04T08:58:00.999", "2018-06-04T08:58:00Z",
            "2018-06-04T10:58:00+02:00", "2018-06-04T05:28:00-03:30", "2018-06-04T10:58:00+0200"]
    bad = [None, "", "-", "okänt", "2018-13-04T09:06:11", "2018-06-xxT00:27:00", "2018-06-04", "2018-06-04T25:00:00", "2018-02-30T10:00:00", "T10:00"]
    rows = spark.createDataFrame([(x,) for x in same + bad], "t string").select(epoch_seconds(F.col("t")).alias("e")).collect()
    assert {r.e for r in rows[: len(same)]} == {1528102680}
    assert {r.e for r in rows[len(same) :]} == {None}


def test_corrections_at_the_edges(spark):
    # the hour 08 ends at 09:00, is published at 09:15 and closes 48 hours after 09:00
    sent = {"before": "2018-06-04T09:14:59", "first": "2018-06-04T09:15:00", "last": "2018-06-06T08:59:59", "closed": "2018-06-06T09:00:00", "early": "2018-06-01T00:00:00", "none": None}
    rows = [(k, "2018-06-04T08:58:00", v, 7, "x") for k, v in sent.items()] + [("first", "2018-06-04T08:58:00", sent["first"], 7, "x"), ("no", "okänt", sent["first"], 7, "x")]
    got = late_events.corrections(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.period, r.file) for r in got) == [("2018-06-04T08", "first"), ("2018-06-04T08", "first"), ("2018-06-04T08", "last")]


def test_triangle_totals(spark):
    rows = [("a", "2018-06-04T08:00:00", "2018-06-04T08:10:00", 0, ""), ("b", "2018-06-04T08:30:00", "2018-06-04T09:15:00", 0, ""), ("c", "2018-06-04T08:30:00", "2018-06-04T09:40:00", 0, "")]
    got = late_events.triangle(spark.createDataFrame(rows, SCHEMA)).orderBy("cell").collect()
    assert [(r.cell, r.arrived, r.total) for r in got] == [(0, 1, 1), (1, 1, 2), (2, 1, 3)]


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert late_events.corrections(empty).count() == 0 and late_events.triangle(empty).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(-10**6, 10**6)), min_size=1, max_size=40))
def test_same_as_brute_force(spark, pairs):
    base = dt.datetime(1970, 1, 1)
    text = lambda s: (base + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S")
    rows = [(str(i), text(e), text(max(0, e + lag)), 0, "") for i, (e, lag) in enumerate(pairs)]
    want = set()
    for i, (e, lag) in enumerate(pairs):
        end = e // 3600 * 3600 + 3600
        if end + 900 <= max(0, e + lag) < end + 48 * 3600:
            want.add((text(e)[:13], str(i)))
    got = late_events.corrections(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.period, r.file) for r in got} == want


def test_hour_label_before_1970(spark):
    assert spark.range(1).select(hour_label(F.lit(-1)).alias("h")).first().h == "1969-12-31T23"


def test_rows_come_through_the_revisions(spark, monkeypatch):
    rows = [(f"f{i}", "2018-06-04T08:00:00", f"2018-06-04T09:{10 + i:02}:00", 0, "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = late_events.revisions(late_events.triangle(df)).orderBy("cell").collect()
    assert [(r.cell, r.was, r.total) for r in made] == [(1, 5, 20), (2, 20, 35), (3, 35, 40)]
    want = {f"f{i}" for i in range(5, 40)}
    assert {r.file for r in late_events.corrections(df).collect()} == want
    monkeypatch.setattr(late_events, "BROADCAST_REVISIONS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = late_events.corrections(df)
        assert {r.file for r in found.collect()} == want and "SortMergeJoin" in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
