"""Clusters of records close to each other in place and time.

Candidates.  Banding: every record gets band keys such that two close records share one, and only records of one key are
compared.  With signatures drawn by MinHash from the cells around a record, two records at the very limit share as little
as a fifteenth of their cells, and a lost link splits a chain; so the bands are the cells themselves (the limit of one row
a band), which loses nothing.  Verification is exact.  Connected components are found by alternating neighbourhood steps
over written tables.  ``minhash_groups`` is the method with signatures, for groups that need not keep every chain whole: it
also parts loose components around their best-linked members.

Density.  Nothing is made for all pairs of a cell.  Records first collapse into small boxes in which everything is close
to everything (a diagonal within the radius, a span within the time), so a box is one node however many records it holds.
A box keeps the bounds of at most 64 parts.  Two boxes are linked if two of their parts lie within the limits by their
outer bounds; they are not if no two parts do by their inner bounds; what is left is settled by cutting those parts
again, down to single positions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.nearby import EARTH_M, great_circle_m
from geoloom.sources.tables import has_place, wrap_lng
from geoloom.storage import at_most, cut, release


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that a chain of edges (a, b) leads to; nodes without an edge have no row.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its least neighbour, then
    its smaller ones are.  A node with very many edges is merged by partial minima first.  Each round is a written table.
    """
    spark = edges.sparkSession
    now, path = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(both.where("b > a").join(least, "a").where("m < a").select("a", F.col("m").alias("b"))).distinct()
        stepped, p1 = cut(large.where("a <> b"), name)
        low = stepped.groupBy("a").agg(F.min("b").alias("m"))
        small = stepped.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt, p2 = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        # stars only, and as many edges as nodes below a centre: nothing can change any more
        centre = nxt.groupBy().agg(F.count("*").alias("e"), F.countDistinct("a").alias("n")).first()
        chained = nxt.select(F.col("b").alias("a")).join(nxt.select("a"), "a", "left_semi").isEmpty()
        release(spark, path, p1)
        now, path = nxt, p2
        if centre["e"] == centre["n"] and chained:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _apart(p: Column, q: Column, outer: bool) -> tuple[Column, Column]:
    """Bounds on the distance in metres and seconds of two boxes: the largest possible, or the smallest."""
    ts_far = F.greatest(p["t2"], q["t2"]) - F.least(p["t1"], q["t1"])
    ts_near = F.greatest(p["t1"] - q["t2"], q["t1"] - p["t2"], F.lit(0))
    # differences of longitude by the shorter way; a box is far smaller than half a turn
    mid = (p["x1"] + p["x2"]) / 2
    shift = F.round((mid - (q["x1"] + q["x2"]) / 2) / 360.0) * 360.0
    dx_far = F.greatest(p["x2"], q["x2"] + shift) - F.least(p["x1"], q["x1"] + shift)
    dx_near = F.greatest(p["x1"] - (q["x2"] + shift), (q["x1"] + shift) - p["x2"], F.lit(0.0))
    dy_far = F.greatest(p["y2"], q["y2"]) - F.least(p["y1"], q["y1"])
    dy_near = F.greatest(p["y1"] - q["y2"], q["y1"] - p["y2"], F.lit(0.0))
    low, top = F.least(F.abs(p["y1"]), F.abs(p["y2"]), F.abs(q["y1"]), F.abs(q["y2"])), F.greatest(F.abs(p["y1"]), F.abs(p["y2"]), F.abs(q["y1"]), F.abs(q["y2"]))
    low = F.when(F.least(p["y1"], q["y1"]) * F.greatest(p["y2"], q["y2"]) <= 0, F.lit(0.0)).otherwise(low)

    def metres(dy: Column, dx: Column, cos2: Column) -> Column:
        h = F.pow(F.sin(F.radians(dy) / 2), 2) + cos2 * F.pow(F.sin(F.radians(F.least(dx, F.lit(180.0))) / 2), 2)
        return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    # slack of a micrometre: a bound may not decide what rounding decides
    if outer:
        return metres(dy_far, dx_far, F.pow(F.cos(F.radians(low)), 2)) + 1e-6, ts_far
    return metres(dy_near, dx_near, F.pow(F.cos(F.radians(top)), 2)) - 1e-6, ts_near


def _verdict(p: Column, q: Column, metres: float, seconds: int) -> Column:
    """2 surely close, 0 surely not, 1 unknown; single positions are compared exactly."""
    point = (p["y1"] == p["y2"]) & (p["x1"] == p["x2"]) & (q["y1"] == q["y2"]) & (q["x1"] == q["x2"]) & (p["t1"] == p["t2"]) & (q["t1"] == q["t2"])
    exact = (great_circle_m(p["y1"], p["x1"], q["y1"], q["x1"]) <= metres) & (F.abs(p["t1"] - q["t1"]) <= seconds)
    (far, late), (near, soon) = _apart(p, q, True), _apart(p, q, False)
    return F.when(point, F.when(exact, 2).otherwise(0)).when((far <= metres) & (late <= seconds), 2).when((near > metres) | (soon > seconds), 0).otherwise(1)


def _bounds() -> list[Column]:
    return [f(c).alias(n) for c, a in (("lat", "y"), ("lng", "x"), ("ts", "t")) for f, n in ((F.min, a + "1"), (F.max, a + "2"))]


def close_clusters(records: DataFrame, id_col: str, lat: str, lng: str, ts: str, metres: float, seconds: int, min_size: int = 1) -> DataFrame:
    """(cluster, id): records joined by chains of pairs at most ``metres`` and ``seconds`` apart; cluster is the least id.

    Clusters have at least ``min_size`` different ids.  Records with a null id or time, or without a usable position,
    take no part; a repeated row counts once.  Longitudes a turn apart are one.  An empty table gives no cluster.
    """
    spark = records.sparkSession
    pt = records.where(F.col(id_col).isNotNull() & F.col(ts).isNotNull() & has_place(lat, lng))
    pt = pt.select(F.col(id_col).cast("bigint").alias("id"), F.col(lat).alias("lat"), wrap_lng(F.col(lng)).alias("lng"), F.col(ts).cast("bigint").alias("ts"))
    # boxes: rows of latitude, in each row columns of longitude as wide as its wide end allows
    side = math.degrees(metres / EARTH_M) / math.sqrt(2) * 0.999
    span = seconds + 1
    row = F.floor((F.col("lat") + 90.0) / side)

    def columns(r: Column) -> Column:  # boxes around the globe in a row: the widest circle of latitude decides
        widest = F.when((r * side <= 90.0) & ((r + 1) * side >= 90.0), F.lit(0.0)).otherwise(F.least(F.abs(r * side - 90.0), F.abs((r + 1) * side - 90.0)))
        return F.greatest(F.ceil(F.cos(F.radians(widest)) * (360.0 / side)), F.lit(1))

    pt = pt.withColumn("_r", row).withColumn("_c", F.floor((F.col("lng") + 180.0) / 360.0 * columns(F.col("_r")))).withColumn("_t", F.floor(F.col("ts") / span))
    box = F.concat_ws(",", "_r", "_c", "_t")
    part = F.pmod(F.floor((F.col("lat") + 90.0) / side * 4), F.lit(4)) * 16 + F.pmod(F.floor((F.col("lng") + 180.0) / 360.0 * columns(F.col("_r")) * 4), F.lit(4)) * 4 + F.floor(F.pmod("ts", F.lit(span)) * 4 / span)
    pt = pt.select("id", "lat", "lng", "ts", "_r", "_c", "_t", box.alias("box"), part.cast("int").alias("part"))
    parts = pt.groupBy("box", "_r", "_t", "part").agg(*_bounds(), F.min("id").alias("least"), F.count("*").alias("n"))
    boxes = parts.groupBy("box", "_r", "_t").agg(
        F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("t1").alias("t1"), F.max("t2").alias("t2"),
        F.collect_list(F.struct("y1", "y2", "x1", "x2", "t1", "t2", "part")).alias("parts"),
    )
    # blocks of 8 rows x as many columns x 4 spans; a box is copied into the next block where its records' reach ends there
    reach_y, tall = math.degrees(metres / EARTH_M) * 1.000001, 8 * side

    def blocks(r: Column) -> Column:
        far = F.least(F.greatest(F.abs(r * tall - 90.0), F.abs((r + 1) * tall - 90.0)), F.lit(90.0))
        return F.greatest(F.floor(F.cos(F.radians(far)) * (360.0 / tall)), F.lit(1))

    def steps(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(lo, hi))

    b = boxes.withColumn("_by", steps(F.floor((F.col("y1") + 90.0) / tall), F.floor((F.col("y2") + reach_y + 90.0) / tall)))
    b = b.withColumn("_n", blocks(F.col("_by")))
    cos_far = F.greatest(F.cos(F.radians(F.least(F.abs(F.col("_by") * tall - 90.0) + tall + reach_y, F.lit(90.0)))), F.lit(1e-12))
    reach_x = F.least(F.degrees(F.asin(F.least(F.lit(math.sin(metres / EARTH_M / 2)) / cos_far, F.lit(1.0)))) * 2.000002, F.lit(180.0))
    first = F.floor((F.col("x1") + 180.0) / 360.0 * F.col("_n"))
    last = F.least(F.floor((F.col("x2") + reach_x + 180.0) / 360.0 * F.col("_n")), first + F.col("_n") - 1)
    b = b.withColumn("_bx", steps(first, last)).withColumn("_bx", F.pmod("_bx", "_n"))
    b = b.withColumn("_bt", steps(F.floor(F.col("t1") / (4 * span)), F.floor((F.col("t2") + seconds) / (4 * span))))
    b = b.select("_by", "_bx", "_bt", "_n", "box", "parts", F.struct("y1", "y2", "x1", "x2", "t1", "t2").alias("all"))
    p, q = b.alias("p"), b.alias("q")
    keys = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in ("_by", "_bx", "_bt")]
    near, soon = _apart(F.col("p.all"), F.col("q.all"), False)
    # of the blocks that hold both, the last of the two first ones judges the pair; around the date line and in small rows all do
    both_first = [F.greatest(*(F.floor((F.col(f"{s}.all.y1") + 90.0) / tall) for s in "pq")) == F.col("p._by"), F.greatest(*(F.floor(F.col(f"{s}.all.t1") / (4 * span)) for s in "pq")) == F.col("p._bt")]
    fp, fq = (F.floor((F.col(f"{s}.all.x1") + 180.0) / 360.0 * F.col(f"{s}._n")) for s in "pq")
    both_first.append((F.col("p._n") < 16) | (F.abs(fp - fq) * 2 >= F.col("p._n")) | (F.greatest(fp, fq) == F.col("p._bx")))
    pairs = p.join(q, [*keys, F.col("p.box") < F.col("q.box"), *both_first, near <= metres, soon <= seconds])
    far, late = _apart(F.col("p.all"), F.col("q.all"), True)
    pairs = pairs.select(F.col("p.box").alias("a"), F.col("q.box").alias("b"), F.col("p.parts").alias("pa"), F.col("q.parts").alias("pb"), ((far <= metres) & (late <= seconds)).alias("all"))
    judged = F.flatten(F.transform("pa", lambda x: F.transform("pb", lambda y: F.struct(x["part"].alias("i"), y["part"].alias("j"), _verdict(x, y, metres, seconds).alias("v")))))
    judged = F.when(F.col("all"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("v")))).otherwise(F.filter(judged, lambda z: z["v"] > 0))
    judged, judged_at = cut(pairs.select("a", "b", judged.alias("z")).where(F.size("z") > 0).distinct(), "judged")
    sure = F.exists("z", lambda z: z["v"] == 2)
    edges = judged.where(sure).select("a", "b")
    open_ = judged.where(~sure).select("a", "b", F.explode("z").alias("z")).select("a", "b", F.concat_ws("/", "a", "z.i").alias("i"), F.concat_ws("/", "b", "z.j").alias("j"))
    paths, level, cutting = [judged_at], 0, None
    while not open_.isEmpty():  # dense boxes only: cut the undecided parts into 64 again
        level += 1
        fine = 4 ** (level + 1)
        inside = pt if cutting is None else cutting
        wanted = open_.select(F.col("i").alias("key")).unionByName(open_.select(F.col("j").alias("key"))).distinct()
        inside = inside.withColumn("key", F.concat_ws("/", "box", "part") if cutting is None else F.col("sub")).join(wanted, "key", "left_semi")
        sub = F.concat_ws("/", "key", F.floor((F.col("lat") + 90.0) / side * fine), F.floor((F.col("lng") + 180.0) / side * fine), F.floor(F.col("ts") * fine / span))
        if level > 20:  # finer than the numbers themselves: one part for each position
            sub = F.concat_ws("/", "key", "lat", "lng", "ts")
        cutting, at = cut(inside.withColumn("sub", sub), "cutting")
        paths.append(at)
        child = cutting.groupBy("key", "sub").agg(*_bounds()).select("key", F.struct("sub", "y1", "y2", "x1", "x2", "t1", "t2").alias("s"))
        tested = open_.join(child.select(F.col("key").alias("i"), F.col("s").alias("si")), "i").join(child.select(F.col("key").alias("j"), F.col("s").alias("sj")), "j")
        tested, at = cut(tested.select("a", "b", F.col("si.sub").alias("i"), F.col("sj.sub").alias("j"), _verdict(F.col("si"), F.col("sj"), metres, seconds).alias("v")).where("v > 0"), "tested")
        paths.append(at)
        found = tested.where("v = 2").select("a", "b").distinct()
        edges = edges.unionByName(found)
        open_ = tested.where("v = 1").join(found, ["a", "b"], "left_anti").select("a", "b", "i", "j")
    comp = connected_components(edges, "boxes")
    release(spark, *paths)
    # the size and least id of every component, then of every box that counts; ids are distinct within a box
    ids = pt.select("id", "box").distinct()
    per_box = ids.groupBy("box").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    named = per_box.join(comp, per_box["box"] == comp["node"], "left").select("box", "n", "least", F.coalesce("component", "box").alias("component"))
    whole = named.groupBy("component").agg(F.sum("n").alias("n"), F.min("least").alias("cluster")).where(F.col("n") >= min_size)
    kept = named.select("box", "component").join(whole, "component").select("box", "cluster")
    return ids.join(kept, "box").select("cluster", "id")


def typical_members(clusters: DataFrame, records: DataFrame, id_col: str, lat: str, lng: str, ts: str, metres: float, seconds: int, top: int = 3) -> DataFrame:
    """(cluster, size, rank, id): each cluster's size and its ``top`` most typical members, those nearest to its mean.

    Nearness is the sum of squares of the distance over ``metres`` and the time over ``seconds``; ties by id.
    """
    pt = records.where(F.col(id_col).isNotNull() & F.col(ts).isNotNull() & has_place(lat, lng)).groupBy(F.col(id_col).alias("id")).agg(F.min(lat).alias("lat"), F.min(wrap_lng(F.col(lng))).alias("lng"), F.min(ts).alias("ts"))
    m = clusters.join(pt, "id")
    # longitudes relative to one member, so that a cluster on the date line has a mean
    ref = m.where("id = cluster").select("cluster", F.col("lng").alias("_ref"))
    m = m.join(ref, "cluster").withColumn("lng", F.col("_ref") + wrap_lng(F.col("lng") - F.col("_ref")))
    mean = m.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("lat").alias("_y"), F.avg("lng").alias("_x"), F.avg("ts").alias("_t"))
    off = F.pow(great_circle_m(F.col("lat"), F.col("lng"), F.col("_y"), F.col("_x")) / metres, 2) + F.pow((F.col("ts") - F.col("_t")) / float(seconds), 2)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round(off, 9), "id"))
    return m.join(mean, "cluster").withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("cluster", "size", "rank", "id")


# the method with signatures

_REACH = (4, 4, 3)  # rows, columns and spans around a record's own cell that make its set


def _cell_rows(y: np.ndarray, x: np.ndarray, t: np.ndarray, side: float, span: int):
    """The set of a record as rows of cells: row numbers, first columns, columns in the row, first span; a row's columns are
    those around the record's longitude, so that records of one cell have one set and neighbours' sets overlap."""
    r0 = np.floor((y + 90.0) / side).astype(np.int64)
    rows = r0[:, None] + np.arange(-_REACH[0], _REACH[0] + 1)
    low = np.abs(rows * side - 90.0)
    top = np.abs((rows + 1) * side - 90.0)
    around = np.maximum(np.floor(np.cos(np.radians(np.minimum(np.minimum(low, top), 90.0))) * (360.0 / side)), 1).astype(np.int64)
    first = np.floor((x[:, None] + 180.0) / 360.0 * around).astype(np.int64) - _REACH[1]
    return rows, first, around, np.floor(t / span).astype(np.int64) - _REACH[2]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _signatures(side: float, span: int, bands: int, rows_a_band: int):
    wide, deep = 2 * _REACH[1] + 1, 2 * _REACH[2] + 1
    # elements are mixed already: a product with an odd number is a permutation of them
    seeds = _mix(np.arange(1, bands * rows_a_band + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                y, x, t = (np.asarray(part[c], dtype=float) for c in ("lat", "lng", "ts"))
                rows, first, around, t0 = _cell_rows(y, x, t, side, span)
                with np.errstate(over="ignore"):
                    column = np.mod(first[:, :, None] + np.arange(wide), around[:, :, None])
                    cell = _mix(rows[:, :, None].astype(np.uint64) * np.uint64(0x100000001B3) + column.astype(np.uint64))
                    cell = cell.reshape(len(y), -1)
                    span_hash = _mix((t0[:, None] + np.arange(deep)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    element = _mix(cell[:, :, None] ^ span_hash[:, None, :]).reshape(len(y), -1)
                    low = np.stack([(element * s).min(1) for s in seeds], 1).reshape(len(y), bands, rows_a_band)
                    key = low[:, :, 0].copy()
                    for k in range(1, rows_a_band):
                        key = _mix(key ^ low[:, :, k])
                    key = _mix(key ^ np.arange(bands, dtype=np.uint64))
                node = np.repeat(np.arange(part.num_rows), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), part["node"].take(pa.array(node))], ["key", "node"])

    return run


def _jaccard(side: float, span: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = []
            for s in "pq":
                sets.append(_cell_rows(*(np.asarray(batch[f"{s}_{c}"], dtype=float) for c in ("lat", "lng", "ts")), side, span))
            (r1, f1, n1, t1), (r2, f2, _, t2) = sets
            wide, deep = 2 * _REACH[1] + 1, 2 * _REACH[2] + 1
            shift = r1[:, :1] - r2[:, :1]
            common = np.zeros(len(r1), dtype=np.int64)
            for i in range(r1.shape[1]):
                j = (i + shift[:, 0]).clip(-1, r2.shape[1])
                ok = (j >= 0) & (j < r2.shape[1])
                other = np.take_along_axis(f2, np.where(ok, j, 0)[:, None], 1)[:, 0]
                apart = np.mod(f1[:, i] - other, n1[:, i])
                apart = np.minimum(apart, n1[:, i] - apart)
                common += np.where(ok, np.maximum(wide - apart, 0), 0)
            common = common * np.maximum(deep - np.abs(t1 - t2), 0)
            size = r1.shape[1] * wide * deep
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(common / (2 * size - common))], ["a", "b", "jaccard"])

    return run


def _cells_of(records: DataFrame, id_col: str, lat: str, lng: str, ts: str, metres: float, seconds: int) -> tuple[DataFrame, DataFrame, str]:
    """(records with their cell _r, _c, _t, cells with node, the place and time of that record and n rows, the cells' path)."""
    pt = records.where(F.col(id_col).isNotNull() & F.col(ts).isNotNull() & has_place(lat, lng))
    pt = pt.select(F.col(id_col).cast("bigint").alias("id"), F.col(lat).cast("double").alias("lat"), wrap_lng(F.col(lng).cast("double")).alias("lng"), F.col(ts).cast("bigint").alias("ts"))
    side = math.degrees(metres / EARTH_M)
    row = F.floor((F.col("lat") + 90.0) / side)
    around = F.greatest(F.floor(F.cos(F.radians(F.least(F.abs(row * side - 90.0), F.abs((row + 1) * side - 90.0), F.lit(90.0)))) * (360.0 / side)), F.lit(1))
    pt = pt.select("*", row.alias("_r"), F.floor((F.col("lng") + 180.0) / 360.0 * around).alias("_c"), F.floor(F.col("ts") / seconds).alias("_t"))
    cells = pt.groupBy("_r", "_c", "_t").agg(F.min("id").alias("node"), F.count("*").alias("n"), *(F.min_by(c, "id").alias(c) for c in ("lat", "lng", "ts")))
    return pt, *cut(cells, "cells")


def _links(cells: DataFrame, metres: float, seconds: int, min_jaccard: float, bands: int, rows_a_band: int) -> DataFrame:
    side = math.degrees(metres / EARTH_M)
    keys = cells.select("node", "lat", "lng", "ts").mapInArrow(_signatures(side, seconds, bands, rows_a_band), "key bigint, node bigint")
    p, q = keys.alias("p"), keys.alias("q")  # both sides are one shuffle
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.node") < F.col("q.node"))).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    for s, end in (("p", "a"), ("q", "b")):
        pairs = pairs.join(cells.select(F.col("node").alias(end), *(F.col(c).alias(f"{s}_{c}") for c in ("lat", "lng", "ts"))), end)
    pairs = pairs.select("a", "b", *(f"{s}_{c}" for s in "pq" for c in ("lat", "lng", "ts")))
    return cut(pairs.mapInArrow(_jaccard(side, seconds), "a bigint, b bigint, jaccard double").where(F.col("jaccard") >= min_jaccard), "links")[0]


def minhash_links(records: DataFrame, id_col: str, lat: str, lng: str, ts: str, metres: float, seconds: int, min_jaccard: float = 0.3, bands: int = 12, rows_a_band: int = 1) -> tuple[DataFrame, DataFrame]:
    """((a, b, jaccard), (node, id)): links between nodes whose sets have at least that Jaccard similarity, and the nodes.

    A node is a cell with records in it, named by its least id; all its records have one set, the cells of side ``metres``
    and ``seconds`` within four rows, four columns and three spans.  MinHash over the sets gives ``bands`` keys; nodes with a
    key in common are candidates; the Jaccard similarity of every candidate is computed exactly from both sets.  At the
    default two records at the very limit share 0.4 of their cells or more and are candidates with a probability of 0.998, a
    link at 0.3 with one of 0.986.  A key that very many nodes share can only come from one neighbourhood, which has at most
    as many nodes as cells; pairs are made by an equi-join on the key, never within a list.
    """
    pt, cells, _ = _cells_of(records, id_col, lat, lng, ts, metres, seconds)
    links = _links(cells, metres, seconds, min_jaccard, bands, rows_a_band)
    keys = ["_r", "_c", "_t"]
    return links, pt.select("id", *keys).distinct().join(cells.select("node", *keys), keys).select("node", "id")


def split_around_medoids(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, medoid): loose components parted so that every node is linked to its group's medoid.

    Nodes are taken by number of links falling, ties by the smaller node; one that is not linked to a medoid becomes one, and
    every other node joins the linked medoid with the greatest similarity, ties by the smaller medoid.  A node without a link
    is its own medoid.  A component in which one node is linked to all others stays whole.  Every round decides, all over the
    table at once, the nodes that come before all their undecided neighbours.
    """
    spark = links.sparkSession
    both = links.where("a <> b").select("a", "b", "jaccard").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).distinct()
    degree = nodes.select("node").distinct().join(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d")), "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d"))
    before = F.struct(-F.col("d"), F.col("node"))
    left, left_at = cut(degree.where("d > 0").select("node", "d"), "undecided")
    both, both_at = cut(both, "both")
    out = degree.where("d = 0").select("node", F.col("node").alias("medoid"))
    out, out_at = cut(out, "medoids")
    medoids = [out]
    while not left.isEmpty():
        rank = left.select("node", before.alias("o"))
        live = both.join(rank.withColumnRenamed("node", "a").withColumnRenamed("o", "oa"), "a").join(rank.withColumnRenamed("node", "b").withColumnRenamed("o", "ob"), "b")
        beaten = live.where("ob < oa").select(F.col("a").alias("node")).distinct()
        chosen, at = cut(left.join(beaten, "node", "left_anti").select("node", F.col("node").alias("medoid")), "medoids")
        medoids.append(chosen)
        gone = both.join(chosen.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).unionByName(chosen.select("node")).distinct()
        nxt, nxt_at = cut(left.join(gone, "node", "left_anti"), "undecided")
        release(spark, left_at)
        left, left_at = nxt, nxt_at
    centre = medoids[0]
    for m in medoids[1:]:
        centre = centre.unionByName(m)
    joined = both.join(centre.select(F.col("node").alias("b")), "b", "left_semi").join(centre.select(F.col("node").alias("a")), "a", "left_anti")
    joined = joined.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(-F.col("jaccard"), F.col("b")))["b"].alias("medoid"))
    done, _ = cut(centre.unionByName(joined), "parted")
    release(spark, left_at, both_at)
    return done


def minhash_groups(records: DataFrame, id_col: str, lat: str, lng: str, ts: str, metres: float, seconds: int, min_size: int = 1, min_jaccard: float = 0.3, bands: int = 12) -> DataFrame:
    """(component, medoid, id, size): groups of records whose neighbourhoods overlap, each named by its medoid.

    MinHash banding gives candidate pairs, exact Jaccard verifies them, connected components form groups, and loose ones are
    split around their highest-degree members (a component is loose if none of its nodes is linked to all others).  component
    is the least node of the component before splitting.
    Groups have at least ``min_size`` ids.  Records without an id, a time or a usable position take no part; repeated rows
    count once; an empty table gives none.  A pair at the limit may be missed (see ``minhash_links``): use ``close_clusters``
    where every chain must hold.
    """
    pt, cells, _ = _cells_of(records, id_col, lat, lng, ts, metres, seconds)
    links = _links(cells, metres, seconds, min_jaccard, bands, 1)
    linked = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    parted = split_around_medoids(links, linked)
    whole = connected_components(links.select("a", "b"), "groups")
    # cells without a link are groups of their own; those with too few rows are left out before any record is shuffled
    alone = cells.where(F.col("n") >= min_size).select("node").join(linked, "node", "left_anti").select("node", F.col("node").alias("medoid"), F.col("node").alias("component"))
    named = parted.join(whole, "node").select("node", "medoid", "component").unionByName(alone)
    keys = ["_r", "_c", "_t"]
    named, _ = cut(cells.select("node", *keys).join(named, "node").select(*keys, "component", "medoid"), "named")
    each = pt.select("id", *keys).join(F.broadcast(named) if at_most(named, 100_000) else named, keys).select("component", "medoid", "id").distinct()
    size = each.groupBy("medoid").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return each.join(size, "medoid").select("component", "medoid", "id", "size")
