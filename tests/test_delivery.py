import datetime as dt
import random

from pyspark.sql import functions as F

from beaconry.operators import delivery
from beaconry.plans import core

SCHEMA = "file string, id string, signal_avsandare_id string, signal_tidpunkt string, received_at timestamp, message string, copy boolean"
LONG = "4c5ab2ff-19a8-4460-94a3-ff89d97fbc78"
T = [dt.datetime(2018, 6, 4, 9, m) for m in range(60)]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA)


def surplus(spark, rows):
    return sorted(r.file for r in delivery.surplus(rows_of(spark, rows)).collect())


def test_spellings_of_a_long_id(spark):
    rows = [("a", f"7S-{LONG}", "s1", None, T[0]), ("b", f"urn:uuid:{LONG}", "s2", None, T[1]), ("c", "{7S-" + LONG.upper() + "}", None, None, T[2]),
            ("d", " 7S_" + LONG.replace("-", "_"), "s1", None, T[3]), ("e", LONG.replace("-", ""), "s1", None, T[4])]
    assert surplus(spark, rows) == ["b", "c", "d", "e"]


def test_running_numbers_need_their_sender(spark):
    rows = [("a", "7S-00001", "s1", None, T[0]), ("b", "00001", "s1", None, T[1]), ("c", "7S-00001", "s2", None, T[2]), ("d", "7S-00001", None, None, T[3]), ("e", "7S-00001", None, None, T[4])]
    assert surplus(spark, rows) == ["b"]


def test_lost_ids_go_by_sender_and_instant(spark):
    at = "2018-06-04T09:00:01"
    rows = [("a", f"7S-{LONG}", "s1", at + "Z", T[5]), ("b", None, "s1", "2018-06-04T11:00:01.7+02:00", T[1]), ("c", "-", "s2", at, T[2]), ("d", "", None, at, T[3]), ("e", None, None, None, T[0]), ("f", None, "s3", "okänt", T[0]), ("g", None, "s3", "okänt", T[1])]
    assert surplus(spark, rows) == ["a"]


def test_ties_and_missing_times(spark):
    rows = [("b", LONG, "s", None, T[0]), ("a", LONG, "s", None, T[0]), ("c", LONG, "s", None, None)]
    assert surplus(spark, rows) == ["b", "c"]


def test_hot_identifier_keeps_one(spark):
    pick = random.Random(1)
    rows = [(f"f{i:04}", LONG, "s", None, T[pick.randint(1, 59)]) for i in range(500)] + [("first", LONG, "s", None, T[0])]
    assert surplus(spark, rows) == [f"f{i:04}" for i in range(500)]
    kept = delivery.deduplicated(rows_of(spark, rows)).collect()
    assert [r.file for r in kept] == ["first"]


def test_new_messages_against_stored(spark):
    rows = [("a", LONG, "s", None, T[0]), ("b", "7S-00002", "s", None, T[1]), ("c", "7S-00002", "s", None, T[2]), ("d", None, None, None, T[3])]
    batch = rows_of(spark, rows)
    stored = delivery.deduplicated(rows_of(spark, [("x", LONG, None, None, T[0])]))
    assert sorted(r.file for r in delivery.new_messages(batch, stored).collect()) == ["b", "d"]  # d cannot be told from anything, so it is kept


def test_lost_ids_are_told_apart_by_stored_messages(spark):
    at = "2018-06-04T09:00:01Z"
    new = lambda batch, *earlier: sorted(r.file for r in delivery.new_messages(rows_of(spark, batch), delivery.identities(rows_of(spark, earlier))).collect())
    assert new([("b", None, "s", at, T[1]), ("c", None, "s", "2018-06-04T09:00:02Z", T[1])], ("a", LONG, "s", at, T[0])) == ["c"]
    # A stored copy that was left out told sender and instant.
    assert new([("c", None, "s", at, T[2])], ("a", LONG, None, None, T[0]), ("b", LONG, "s", at, T[1])) == []


def test_identified_rows_are_copies_of_a_stored_lost_one(spark):
    other, at = "5" * 32, "2018-06-04T09:00:01Z"
    new = lambda batch, *earlier: sorted(r.file for r in delivery.new_messages(rows_of(spark, batch), delivery.identities(rows_of(spark, earlier))).collect())
    # One message answers for the lost row; another of that instant is new, and a copy that lost its instant is known by its id.
    assert new([("b", LONG, "s", at, T[1]), ("c", other, "s", at, T[2]), ("d", LONG, None, None, T[3])], ("a", None, "s", at, T[0])) == ["c"]
    assert new([("d", LONG, None, None, T[3]), ("e", other, "s", at, T[4])], ("a", None, "s", at, T[0]), ("b", LONG, "s", at, T[1])) == ["e"]


def test_every_batch_is_tested_as_new(spark, tmp_path):
    pick = random.Random(3)
    ids = [None, None, "7S-00001", "00002", LONG, "5" * 32]
    rows = [(f"f{i:02}", pick.choice(ids), pick.choice(["s", "s", "t", None]), pick.choice([None, "2018-06-04T09:00:01Z", "2018-06-04T09:00:02Z"]), pick.choice([None, *T]), pick.choice([3, 5, 9])) for i in range(60)]
    schema = "file string, id string, signal_avsandare_id string, signal_tidpunkt string, received_at timestamp, batch_no int"
    df = spark.createDataFrame(rows, schema)
    one_by_one = []
    for n in (3, 5, 9):
        before = delivery.identities(df.filter(F.col("batch_no") < n), F.col("batch_no"))
        one_by_one += [(r.file, n) for r in delivery.new_messages(df.filter(F.col("batch_no") == n), before).collect()]
    assert {n for _, n in one_by_one} == {3, 5, 9}
    df.write.parquet(str(tmp_path / "reports.parquet"))
    assert sorted((r.file, r.batch_no) for r in core.p4_new_messages(spark, str(tmp_path)).collect()) == sorted(one_by_one)


def test_empty(spark):
    assert surplus(spark, []) == []
