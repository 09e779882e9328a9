import math
import random

from beaconry.operators import cells


def far(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * cells.EARTH_M * math.asin(min(1, math.sqrt(x)))


def check(spark, points, places):
    p = spark.createDataFrame([(f"p{i}", *x, "clash") for i, x in enumerate(points)], "file string, lat double, lon double, level string")
    q = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(places)], "seq int, lat double, lon double, radius_m double, code int")
    got = sorted((r.file, r.seq) for r in cells.within(p, q).collect())
    ok = lambda lat, lon: lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180
    want = sorted((f"p{i}", j) for i, a in enumerate(points) if ok(*a) for j, b in enumerate(places) if ok(*b[:2]) and b[2] is not None and b[2] >= 0 and far(*a, *b[:2]) <= b[2])
    assert got == want
    return got


def test_against_all_pairs(spark):
    pick = random.Random(5)
    points = [(pick.uniform(58.9, 59.5), pick.uniform(16.3, 18)) for _ in range(300)] + [(pick.uniform(-90, 90), pick.uniform(-180, 180)) for _ in range(200)]
    places = [(pick.uniform(58.9, 59.5), pick.uniform(16.3, 18), pick.choice([25.0, 800.0, 3200.0, 40_000.0])) for _ in range(30)]
    places += [(pick.uniform(-89, 89), pick.uniform(-180, 180), pick.choice([1e5, 1e6, 9e6, 2.1e7])) for _ in range(12)]
    assert check(spark, points, places)


def test_poles_and_date_line(spark):
    points = [(89.9, 10.0), (89.9, -170.0), (-89.99, 0.0), (10.0, 179.99), (10.0, -179.99), (10.0, 180.0), (10.0, -180.0), (90.0, 0.0)]
    check(spark, points, [(89.95, 0.0, 30_000.0), (-90.0, 0.0, 5_000.0), (10.0, 179.999, 3_000.0), (10.0, -180.0, 10.0), (90.0, 5.0, 1.0)])


def test_missing_and_wrong_positions(spark):
    points = [(None, 17.0), (59.0, None), (95.0, 17.0), (17.0, 259.0), (59.0, 17.0), (59.0, 17.0)]
    got = check(spark, points, [(59.0, 17.0, 10.0), (59.0, 17.0, None), (59.0, 17.0, 0.0), (59.0, 17.0, -1.0), (None, 17.0, 5.0)])
    assert got == [("p4", 0), ("p4", 2), ("p5", 0), ("p5", 2)]


def test_empty_sides(spark):
    assert check(spark, [], [(59.0, 17.0, 10.0)]) == [] and check(spark, [(59.0, 17.0)], []) == []


def test_salted_join_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(cells, "BROADCAST_RANGES", 0)
    assert check(spark, [(59.0, 17.0), (59.001, 17.0), (60.0, 17.0)], [(59.0, 17.0, 200.0)]) == [("p0", 0), ("p1", 0)]
