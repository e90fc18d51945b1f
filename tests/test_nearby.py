import math
import random

from geoloom.operators.nearby import within_distance, within_regions

P = "tid bigint, lat double, lng double, id string, place_id string"
L = "place_id string, lat double, lng double, id bigint"


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_373_000 * math.asin(min(1, math.sqrt(h)))


def test_distance_agrees_with_brute_force_everywhere(spark):
    rng = random.Random(1)
    for at, radius in (((41.0, -8.0), 100), ((-17.2, 180.0), 100), ((89.999, 10.0), 300), ((0.0, 0.0), 100), ((60.0, 179.9999), 50_000)):
        w = radius / 40_000
        pts = [(i, max(-90.0, min(90.0, at[0] + rng.uniform(-w, w))), at[1] + rng.uniform(-w, w) / max(0.02, math.cos(math.radians(at[0]))) + rng.choice([0, 360, -360]), "x", "y") for i in range(150)]
        places = [(str(i), max(-90.0, min(90.0, at[0] + rng.uniform(-w, w))), at[1] + rng.uniform(-w, w), i) for i in range(40)]
        for small in (200_000, 0):  # broadcast and salted
            found = {(r.id, r.place_id) for r in within_distance(spark.createDataFrame(pts, P), spark.createDataFrame(places, L), radius, id_col="tid", broadcast_rows=small, salts=3).collect()}
            assert found == {(p[0], q[0]) for p in pts for q in places if metres(p[1:3], q[1:3]) <= radius}


def test_distance_nulls_repeats_and_empty(spark, got):
    nan = float("nan")
    pts = [(1, 10.0, 20.0, "a", "b"), (1, 10.0, 20.0, "a", None), (2, None, 20.0, "", ""), (3, nan, 1.0, "", ""), (4, 0.0, 0.0, "", ""), (5, 91.0, 20.0, "", ""), (None, 10.0, 20.0, "", ""), (6, 10.0, float("inf"), "", ""), (7, 10.0, 380.0, "", "")]
    places = [("p", 10.0, 20.0, 1), ("p", 10.0, 20.0, 2), ("q", 10.0, 20.0, 3), (None, 10.0, 20.0, 4), ("r", None, 20.0, 5)]
    a, b = spark.createDataFrame(pts, P), spark.createDataFrame(places, L)
    assert got(within_distance(a, b, 100, id_col="tid").select("id", "place_id")) == [(1, "p"), (1, "q"), (7, "p"), (7, "q")]
    assert within_distance(a.limit(0), b, 100, id_col="tid").isEmpty() and within_distance(a, b.limit(0), 100, id_col="tid").isEmpty()


R = "region_id string, rings array<array<struct<lat:double,lng:double>>>, lat double"


def test_regions(spark, got):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    hole = [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5), (0.5, 0.5)]
    line = [(10.0, 179.0), (10.0, -179.0), (12.0, -179.0), (12.0, 179.0)]
    cap = [(80.0, -180.0), (80.0, -60.0), (80.0, 60.0)]
    regions = spark.createDataFrame([("square", [square], 1.0), ("ring", [square, hole], 1.0), ("line", [line], 1.0), ("cap", [cap], None), (None, [square], 0.0), ("none", None, 0.0), ("two", [square[:2]], 0.0), ("empty", [], 0.0)], R)
    pts = [(1, 1.0, 1.0), (2, 0.2, 1.0), (3, 0.0, 1.0), (4, 2.0, 2.0), (5, 11.0, 180.0), (6, 11.0, -180.5), (7, 11.0, 178.0), (8, 85.0, 33.0), (9, 79.0, 0.0), (10, 0.2, 361.0), (11, None, 1.0), (12, 1.0, 0.0), (2, 0.2, 1.0)]
    want = [(1, "square"), (2, "ring"), (2, "square"), (3, "ring"), (3, "square"), (4, "ring"), (4, "square"), (5, "line"), (6, "line"), (8, "cap"), (10, "ring"), (10, "square"), (12, "ring"), (12, "square")]
    for small in (200_000, 0):
        assert got(within_regions(spark.createDataFrame(pts, "tid bigint, lat double, lng double"), regions, id_col="tid", broadcast_rows=small, salts=3)) == want
    assert within_regions(spark.createDataFrame(pts, "tid bigint, lat double, lng double"), regions.limit(0), id_col="tid").isEmpty()


def test_ray_through_vertices_counts_once(spark, got):
    diamond = [(0.0, 1.0), (1.0, 2.0), (2.0, 1.0), (1.0, 0.0)]
    regions = spark.createDataFrame([("d", [diamond], 1.0)], R)
    pts = [(1, 1.0, 0.5), (2, 1.0, -0.5), (3, 0.0, 0.0), (4, 2.0, 0.0), (5, 1.0, 2.5)]
    assert got(within_regions(spark.createDataFrame(pts, "tid bigint, lat double, lng double"), regions, id_col="tid")) == [(1, "d")]
