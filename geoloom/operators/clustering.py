"""Mean shift over places or times of day, nearest centres and spherical k-means."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.ranking import positions, strongest_first
from geoloom.storage import at_most, cut


def nearest_centre(points: DataFrame, centres: DataFrame, value: list[str], limit: int | None = None, broadcast: int = 100_000) -> DataFrame:
    """Points with the id of their nearest centre by planar distance, ties by id; null where there are no centres.

    Centres are laid on grids of five widths, each cell with the centres in and around it; a point looks into its own cell
    of each grid, and a centre found within a cell's width is the nearest one.  Points farther than that from all centres
    are compared with every centre.  Cells go to the tasks while there are at most ``broadcast`` centres (counted); with more
    they are joined by shuffle, one grid after the other, only points that have no centre yet going on to the next.  More
    than ``limit`` centres raise, where that is given.
    """
    if limit is not None and not at_most(centres, limit):
        raise ValueError(f"more than {limit} centres")
    c = centres.select("id", *value).where(" and ".join(f"{v} is not null and not isnan({v})" for v in value)).distinct()
    spread = c.agg(F.count("*").alias("n"), *(F.max(v).alias(f"_h{i}") for i, v in enumerate(value)), *(F.min(v).alias(f"_l{i}") for i, v in enumerate(value))).first()
    kind = dict(centres.dtypes)["id"]
    names = points.columns
    out = points.select(*names)
    if not spread["n"]:
        return out.withColumn("id", F.lit(None).cast(kind))
    wide = max(1e-9, *((spread[f"_h{i}"] - spread[f"_l{i}"]) / spread["n"] ** (1 / len(value)) for i in range(len(value))))
    few, found, done = spread["n"] <= broadcast, [], []
    for level in range(5):
        side = wide * 8.0 ** (level - 3)
        near = c
        for i, v in enumerate(value):
            near = near.withColumn(f"_k{i}", F.explode(F.sequence(F.floor(F.col(v) / side) - 1, F.floor(F.col(v) / side) + 1)))
        keys = [f"_k{i}" for i in range(len(value))]
        cells = near.groupBy(*keys).agg(F.collect_list(F.struct("id", *value)).alias(f"_near{level}"))
        for i, v in enumerate(value):
            out = out.withColumn(f"_k{i}", F.floor(F.col(v) / side))
        out = out.join(F.broadcast(cells) if few else cells, keys, "left").drop(*keys)
        off = F.array_min(F.transform(f"_near{level}", lambda s: F.struct(sum((F.col(v) - s[v]) * (F.col(v) - s[v]) for v in value).alias("d"), s["id"].alias("id"))))
        found.append(F.when(off["d"] <= side * side, off["id"]))
        if not few:
            out, _ = cut(out.select(*names, found[-1].alias("id")), "nearest")
            done.append(out.where("id is not null"))
            out = out.where("id is null").select(*names)
    if few:
        out = out.select(*names, F.coalesce(*found).alias("id"))
    elif out.isEmpty():
        return reduce(DataFrame.unionByName, done)
    else:
        out = reduce(DataFrame.unionByName, done, out.withColumn("id", F.lit(None).cast(kind)))
    rest = c.orderBy("id").toPandas()  # a few numbers a centre
    ids, where = rest["id"].to_numpy(), rest[value].to_numpy(dtype=float)

    def run(batches):
        for pdf in batches:
            x = pdf[value].to_numpy(dtype=float)
            best = np.empty(len(x), dtype=np.int64)
            block = max(1, min(512, 2_000_000 // len(where)))
            for i in range(0, len(x), block):
                d = np.zeros((len(x[i : i + block]), len(where)))
                for j in range(len(value)):
                    d += (x[i : i + block, j, None] - where[None, :, j]) ** 2
                best[i : i + block] = d.argmin(1)
            yield pdf.assign(id=ids[best])

    far = out.where("id is null").select(*names).mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + f", id {kind}")
    return out.where("id is not null").unionByName(far)


TILE, HALO = 32, 4  # bandwidths


def _shifts(value: list[str], bandwidth: float, rounds: int):
    """Moves the seeds of a tile over its grid rows until they settle, or until they come near the edge of the halo."""
    dims = len(value)
    cells = [f"_c{i}" for i in range(dims)]

    def run(key: tuple, seeds: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        low = np.array(key, dtype=np.int64) * TILE - HALO
        wide = TILE + 2 * HALO
        local = grid[cells].to_numpy(dtype=np.int64) - low
        flat = local[:, 0] if dims == 1 else local[:, 0] * wide + local[:, 1]
        order = np.lexsort((*(grid[c].to_numpy() for c in value), flat))
        flat, x, w = flat[order], grid[value].to_numpy(dtype=float)[order], grid["n"].to_numpy(dtype=float)[order]
        at, n, used, settled = seeds[value].to_numpy(dtype=float), seeds["n"].to_numpy(copy=True), seeds["used"].to_numpy(copy=True), np.zeros(len(seeds), bool)
        for i in range(len(at)):
            while not settled[i] and used[i] < rounds:
                c = np.floor(at[i] / bandwidth).astype(np.int64) - low
                if (c < 1).any() or (c > wide - 2).any():
                    break
                starts = [c[0] - 1] if dims == 1 else [(c[0] + o) * wide + c[1] - 1 for o in (-1, 0, 1)]
                near = np.concatenate([np.arange(*np.searchsorted(flat, (k, k + 3))) for k in starts])
                near = near[((x[near] - at[i]) ** 2).sum(1) <= bandwidth**2]
                if not len(near):  # a mean with nothing around it stays
                    settled[i] = True
                    break
                total = w[near].sum()
                new = (x[near] * w[near, None]).sum(0) / total
                settled[i] = np.sqrt(((new - at[i]) ** 2).sum()) < bandwidth / 1000
                at[i], n[i], used[i] = new, total, used[i] + 1
        return seeds.assign(**{c: at[:, j] for j, c in enumerate(value)}, n=n, used=used, settled=settled)[["id", *value, "n", "used", "settled"]]

    return run


def mean_shift(points: DataFrame, value: list[str], bandwidth: float, rounds: int = 10_000) -> DataFrame:
    """(id, value..., n): flat-kernel mean shift with seeds on a grid of the bandwidth, for one or two values.

    Points are first counted on a fine grid, a twentieth of the bandwidth, as sums: the shift of a seed is a weighted mean of
    the grid rows within the bandwidth.  Seeds move inside tiles of 32 bandwidths with a halo of 4, whose grid rows are
    bounded whatever the number of points; those that leave the halo go on in another tile, settled ones are done.
    A seed ends when it moves less than a thousandth of the bandwidth; one that needs more than ``rounds`` shifts raises.
    Seeds within a bandwidth of one with more points fall away, from the strongest down.
    """
    if len(value) > 2:
        raise ValueError("mean_shift takes one or two values")
    fine, dims = bandwidth / 20, range(len(value))
    keys = [F.floor(F.col(c) / fine) for c in value]
    g = points.where(" and ".join(f"{c} is not null" for c in value)).groupBy(*(k.alias(f"_f{i}") for i, k in enumerate(keys)))
    g = g.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in value))
    g, _ = cut(g.select("n", *value, *(F.floor(F.col(c) / bandwidth).alias(f"_c{i}") for i, c in enumerate(value))), "grid")
    seeds = g.groupBy(*(f"_c{i}" for i in dims)).agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in value)).select(*value).withColumn("id", F.xxhash64(*value))
    seeds = seeds.select("id", *value, F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("used"))
    tiles = [f"_t{i}" for i in dims]
    spread = g
    for i in dims:
        spread = spread.withColumn(f"_t{i}", F.explode(F.sequence(F.floor((F.col(f"_c{i}") - HALO) / TILE), F.floor((F.col(f"_c{i}") + HALO) / TILE))))
    schema = "id bigint, " + ", ".join(f"{c} double" for c in value) + ", n bigint, used bigint, settled boolean"
    done = None
    while True:
        for i, c in enumerate(value):
            seeds = seeds.withColumn(f"_t{i}", F.floor(F.col(c) / bandwidth / TILE))
        moved = seeds.groupBy(*tiles).cogroup(spread.join(seeds.select(*tiles).distinct(), tiles, "left_semi").groupBy(*tiles)).applyInPandas(_shifts(value, bandwidth, rounds), schema)
        moved, _ = cut(moved, "shift")
        ended = moved.where("settled").select(*value, "n")
        done = ended if done is None else done.unionByName(ended)
        seeds = moved.where("not settled").drop("settled")
        left = seeds.agg(F.count("*"), F.max("used")).first()
        if not left[0]:
            break
        if left[1] >= rounds:
            raise RuntimeError(f"mean shift: seeds still move after {rounds} shifts")
    # equal ends merge first; then the greedy choice, strongest first, over pairs of ends that cells of the bandwidth bring together
    ends = done.groupBy(*(F.round(F.col(c), 9).alias(c) for c in value)).agg(F.max("n").alias("n"))
    ends, _ = cut(ends.withColumn("node", F.struct(*value)), "ends")
    own, around = ends, ends
    for i, c in enumerate(value):
        own = own.withColumn(f"_k{i}", F.floor(F.col(c) / bandwidth))
        around = around.withColumn(f"_k{i}", F.explode(F.sequence(F.floor(F.col(c) / bandwidth) - 1, F.floor(F.col(c) / bandwidth) + 1)))
    a, b = own.select(F.col("node").alias("a"), *(f"_k{i}" for i in dims)), around.select(F.col("node").alias("b"), *(f"_k{i}" for i in dims))
    apart = sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in value)
    links = a.join(b, [f"_k{i}" for i in dims]).where((apart <= bandwidth * bandwidth) & (F.col("a") < F.col("b"))).select("a", "b")
    kept = strongest_first(ends.select("node", F.struct((-F.col("n")).alias("n"), *value).alias("rank")), links)
    out = ends.join(kept, "node", "left_semi").select(*value, "n")
    return positions(out, [F.desc("n"), *(F.col(c).asc() for c in value)], name="id").select((F.col("id") - 1).alias("id"), *value, "n")


def spherical_kmeans(vectors: DataFrame, vec: str, k: int, seed: int = 0, rounds: int = 10) -> DataFrame:
    """Adds cluster (int): k-means with cosine distance of non-zero vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.where((F.array_max(vec) > 0) | (F.array_min(vec) < 0)).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, featuresCol="_v", predictionCol="cluster", distanceMeasure="cosine", seed=seed, maxIter=rounds).fit(v)
    return model.transform(v).drop("_v")
