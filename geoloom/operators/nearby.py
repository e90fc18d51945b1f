"""Points near other points, and points inside regions.

``within_distance``: an equal-distance grid.  The sphere is cut into latitude bands as high as the radius, each band into
longitude cells at least as wide as the radius; a place is copied into the few cells its circle touches, a point stays
in its own cell, and one equi-join finds every pair, over the date line and at the poles too.

``within_regions``: crossing parity in SQL.  Ring edges are cut into latitude strips and filed under the longitude cells that
their region reaches, points join the edges of their strip and cell, and the crossings of the eastward ray are grouped by
point and region.

Both take any number of extra columns (ignored) and drop points and places without a usable position.  Empty inputs give
empty results.  The join is broadcast only while the place side is at most ``broadcast_rows`` rows (counted first);
beyond that it is a shuffled join in which the point side is salted, so a cell or strip with a large share of all points
is spread over ``salts`` tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.tables import has_place, wrap_lng
from geoloom.storage import at_most

EARTH_M = 6_373_000.0


def great_circle_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance in metres on a sphere of radius 6,373 km."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distinct_points(points: DataFrame, id_col: str, lat: str, lng: str) -> DataFrame:
    """(id, lat, lng): one row for each located id and position; repeated rows collapse, null ids take no part."""
    return (
        points.where(F.col(id_col).isNotNull() & has_place(lat, lng))
        .select(F.col(id_col).alias("id"), F.col(lat).alias("lat"), wrap_lng(F.col(lng)).alias("lng"))
        .distinct()
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str], small: bool, salts: int) -> DataFrame:
    if small:
        return left.join(F.broadcast(right), keys)
    left = left.withColumn("_salt", F.pmod(F.xxhash64("id", "lat", "lng"), F.lit(salts)))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def within_distance(
    points: DataFrame, places: DataFrame, radius_m: float, *, id_col: str = "id", lat: str = "lat", lng: str = "lng",
    place_id: str = "place_id", place_lat: str = "lat", place_lng: str = "lng", broadcast_rows: int = 200_000, salts: int = 32,
) -> DataFrame:
    """(id, place_id, distance_m): every point and place at most ``radius_m`` apart, each pair once.

    Nulls: a point or place without id, latitude or longitude, or with one that is not a number, is left out.  A place
    stored twice counts once; two places at one spot both count.
    """
    r = radius_m / EARTH_M
    high = max(math.degrees(r) * (1 + 1e-9), 1e-6)

    def band(x: Column) -> Column:
        return F.floor((x + 90.0) / high)

    def cells(b: Column) -> Column:  # number of longitude cells in a band, each at least the radius wide
        low, top = b * high - 90.0, (b + 1) * high - 90.0
        return F.greatest(F.floor(360.0 / high * F.cos(F.radians(F.least(F.greatest(F.abs(low), F.abs(top)), F.lit(90.0))))), F.lit(1))

    def cell(x: Column, n: Column) -> Column:
        return F.floor((x + 180.0) / 360.0 * n)

    pt = distinct_points(points, id_col, lat, lng).withColumn("_b", band(F.col("lat")))
    pt = pt.withColumn("_c", F.pmod(cell(F.col("lng"), cells(F.col("_b"))), cells(F.col("_b"))))
    pl = (
        places.where(F.col(place_id).isNotNull() & has_place(place_lat, place_lng))
        .select(F.col(place_id).alias("place_id"), F.col(place_lat).alias("plat"), wrap_lng(F.col(place_lng)).alias("plng"))
        .distinct()
    )
    small = at_most(pl, broadcast_rows // 12)
    reach = F.degrees(F.asin(F.least(F.lit(math.sin(min(r, math.pi / 2))) / F.cos(F.radians("plat")), F.lit(1.0)))) * (1 + 1e-9)
    polar = (F.abs("plat") + high >= 90.0) | F.lit(r >= math.pi / 2)
    pl = pl.withColumn("_b", F.explode(F.sequence(band(F.col("plat") - high), band(F.col("plat") + high)))).withColumn("_n", cells(F.col("_b")))
    first = F.when(polar, F.lit(0).cast("bigint")).otherwise(cell(F.col("plng") - F.when(~polar, reach), F.col("_n")))
    last = F.when(polar, F.col("_n") - 1).otherwise(cell(F.col("plng") + F.when(~polar, reach), F.col("_n")))
    pl = pl.withColumn("_f", first).withColumn("_l", F.least(last, F.col("_f") + F.col("_n") - 1))
    pl = pl.withColumn("_c", F.explode(F.sequence("_f", "_l"))).withColumn("_c", F.pmod("_c", "_n")).drop("_f", "_l", "_n")
    far = great_circle_m(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))
    return _joined(pt, pl, ["_b", "_c"], small, salts).withColumn("distance_m", far).where(F.col("distance_m") <= radius_m).select("id", "place_id", "distance_m")


def ring_edges(regions: DataFrame, region_id: str = "region_id", rings: str = "rings") -> DataFrame:
    """(region_id, lat1, lng1, lat2, lng2, west, east): the edges of all rings, longitudes unrolled along each ring.

    A ring closes itself.  Every edge takes the shorter way in longitude, so unrolled longitudes may leave [-180, 180).
    A ring that winds around a pole is closed over the pole on the side of its first vertex.  Vertices with a null are
    skipped; rings of fewer than three vertices have no inside.
    """
    ring = regions.where(F.col(region_id).isNotNull()).select(F.col(region_id).alias("region_id"), F.posexplode(rings).alias("_ring", "_v"))
    ring = ring.withColumn("_v", F.filter("_v", lambda v: v["lat"].isNotNull() & v["lng"].isNotNull())).where(F.size("_v") >= 3)

    def turn(a: Column, b: Column) -> Column:  # b moved by whole turns to within half a turn of a
        return a + (b - a - F.floor((b - a + 180.0) / 360.0) * 360.0)

    def step(done: Column, v: Column) -> Column:
        prev = F.element_at(done, -1)["lng"]
        lng = F.when(F.abs(v["lng"] - prev) <= 180.0, v["lng"]).otherwise(turn(prev, v["lng"]))
        return F.concat(done, F.array(F.struct(v["lat"].cast("double").alias("lat"), lng.cast("double").alias("lng"))))

    start = F.array(F.struct(F.col("_v")[0]["lat"].cast("double").alias("lat"), F.col("_v")[0]["lng"].cast("double").alias("lng")))
    ring = ring.withColumn("_u", F.aggregate(F.expr("slice(_v, 2, size(_v) - 1)"), start, step))
    last, first = F.element_at("_u", -1), F.col("_u")[0]
    pole = F.when(first["lat"] < 0, F.lit(-90.0)).otherwise(F.lit(90.0))
    winds = F.abs(turn(last["lng"], first["lng"]) - first["lng"]) > 180.0
    over = F.array(
        F.struct(first["lat"].alias("lat"), turn(last["lng"], first["lng"]).alias("lng")),
        F.struct(pole.alias("lat"), turn(last["lng"], first["lng"]).alias("lng")), F.struct(pole.alias("lat"), first["lng"].alias("lng")),
    )
    ring = ring.withColumn("_u", F.when(winds, F.concat("_u", over)).otherwise(F.col("_u")))
    ring = ring.withColumn("west", F.array_min(F.transform("_u", lambda v: v["lng"]))).withColumn("east", F.array_max(F.transform("_u", lambda v: v["lng"])))
    ring = ring.withColumn("_w", F.concat(F.expr("slice(_u, 2, size(_u) - 1)"), F.slice("_u", 1, 1)))
    return ring.select("region_id", "west", "east", F.explode(F.arrays_zip("_u", "_w")).alias("_e")).select(
        "region_id", "west", "east", *(F.col(f"_e.{s}.{c}").alias(f"{c}{k}") for k, s in ((1, "_u"), (2, "_w")) for c in ("lat", "lng"))
    )


_AROUND = (7200, 900, 100, 10, 1)  # longitude cells around the globe, from fine to coarse


def within_regions(
    points: DataFrame, regions: DataFrame, *, id_col: str = "id", lat: str = "lat", lng: str = "lng",
    region_id: str = "region_id", rings: str = "rings", strip: float = 0.005, broadcast_rows: int = 200_000, salts: int = 32,
) -> DataFrame:
    """(id, region_id): every point and region of which the point lies inside an odd number of rings.

    Boundaries: a vertex belongs to the edge above it (half-open latitudes), so a ray through a vertex counts once;
    level edges are never crossed; a point exactly on an edge or vertex is inside, whatever the parity says.
    """
    edge = ring_edges(regions, region_id, rings)
    edge = edge.withColumn("_s", F.explode(F.sequence(F.floor(F.least("lat1", "lat2") / strip), F.floor(F.greatest("lat1", "lat2") / strip))))
    # a region is filed under the longitude cells it reaches, in the finest grid of which it fills no more than five
    fits = [F.when(F.col("east") - F.col("west") <= 4 * 360.0 / n, n) for n in _AROUND[:-1]]
    edge = edge.withColumn("_n", F.coalesce(*fits, F.lit(_AROUND[-1])))
    first, last = (F.floor((F.col(c) + s * 1e-9 + 180.0) / 360.0 * F.col("_n")) for c, s in (("west", -1), ("east", 1)))
    edge = edge.withColumn("_c", F.explode(F.sequence(first, F.least(last, first + F.col("_n") - 1)))).withColumn("_c", F.pmod("_c", "_n"))
    small = at_most(edge, broadcast_rows)
    grids = [r[0] for r in edge.select("_n").distinct().collect()] or [1]  # as many as there are grids, at most
    pt = distinct_points(points, id_col, lat, lng).withColumn("_s", F.floor(F.col("lat") / strip))
    pt = pt.withColumn("_n", F.explode(F.array(*(F.lit(n) for n in grids)))).withColumn("_c", F.pmod(F.floor((F.col("lng") + 180.0) / 360.0 * F.col("_n")), F.col("_n")))
    hit = _joined(pt, edge, ["_s", "_n", "_c"], small, salts)
    x = F.when(F.col("lng").between(F.col("west"), F.col("east")), F.col("lng")).otherwise(F.col("west") + F.pmod(F.col("lng") - F.col("west"), F.lit(360.0)))
    hit = hit.withColumn("_x", x).where(F.col("_x") <= F.col("east"))
    spans = (F.least("lat1", "lat2") <= F.col("lat")) & (F.col("lat") < F.greatest("lat1", "lat2"))
    cross = F.when(F.col("lat1") != F.col("lat2"), F.col("lng1") + (F.col("lat") - F.col("lat1")) / F.when(F.col("lat1") != F.col("lat2"), F.col("lat2") - F.col("lat1")) * (F.col("lng2") - F.col("lng1")))
    level = (F.col("lat1") == F.col("lat2")) & (F.col("lat") == F.col("lat1")) & F.col("_x").between(F.least("lng1", "lng2"), F.greatest("lng1", "lng2"))
    corner = (F.col("lat") == F.col("lat1")) & (F.col("_x") == F.col("lng1"))
    on_edge = F.coalesce(level | corner | (spans & (cross == F.col("_x"))), F.lit(False))
    east = F.coalesce(spans & (cross > F.col("_x")), F.lit(False))
    hit = hit.withColumn("_on", on_edge).withColumn("_east", east).where(F.col("_on") | F.col("_east"))
    per = hit.groupBy("id", "lat", "lng", "region_id").agg(F.max("_on").alias("_on"), F.sum(F.col("_east").cast("int")).alias("_n"))
    return per.where(F.col("_on") | (F.col("_n") % 2 == 1)).select("id", "region_id")
