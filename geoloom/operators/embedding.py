"""Graph embedding by edge sampling with negative samples, and cross-modal queries over its vectors.

Training is sequential in spirit (every step moves two vectors).  Here each round splits the edges over tasks, every task
runs minibatch steps from the same start on its own edges, and the vectors are averaged by a distributed mean, weighted by
how often a task touched a node.  A task holds the vectors of the nodes on its own edges only, so neither the driver nor a
task needs the whole matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.storage import cut, release

ORDER = ["ww", "ll", "tt", "wl", "lt", "tw", "lw", "tl", "wt", "cl", "ct", "cw", "lc", "tc", "wc"]


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, alias) for constant-time draws; negative weights count 0, all-zero weights are uniform."""
    w = np.maximum(np.asarray(weights, dtype=float), 0)
    w = np.ones_like(w) if not w.sum() else w
    p, alias = w / w.sum() * len(w), np.zeros(len(w), dtype=int)
    small, large = list(np.flatnonzero(p < 1)), list(np.flatnonzero(p >= 1))
    while small and large:
        s, g = small.pop(), large.pop()
        alias[s] = g
        p[g] -= 1 - p[s]
        (small if p[g] < 1 else large).append(g)
    p[small + large] = 1
    return p, alias


def draw(table: tuple[np.ndarray, np.ndarray], n: int, rng: np.random.Generator) -> np.ndarray:
    p, alias = table
    i = rng.integers(0, len(p), n)
    return np.where(rng.random(n) < p[i], i, alias[i])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -6, 6)))


def _train(dim: int, samples: float, negative: int, alpha: float, second_order: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(pdf["part"].iloc[0]))
        edges, start = pdf[pdf["etype"].notna()], pdf[pdf["etype"].isna()].sort_values("u")
        names = start["u"].to_numpy()
        index = {n: i for i, n in enumerate(names)}
        vec = np.array(start["vec"].tolist(), dtype=np.float32).reshape(-1, dim)
        ctx = np.array(start["ctx"].tolist(), dtype=np.float32).reshape(-1, dim)
        out = ctx if second_order else vec
        touched = np.zeros(len(names))
        groups = []
        for kind in ORDER:
            e = edges[edges["etype"] == kind].sort_values(["u", "v"])
            if len(e):
                u = np.array([index[kind[0] + ":" + x] for x in e["u"]])
                v = np.array([index[kind[1] + ":" + x] for x in e["v"]])
                target, inv = np.unique(v, return_inverse=True)
                noise = np.bincount(inv, weights=e["weight"].to_numpy(dtype=float)) ** 0.75
                groups.append((u, v, alias_table(e["weight"].to_numpy(dtype=float)), target, alias_table(noise)))
        batch = 64
        steps = max(1, int(samples * len(edges) / max(1, len(groups)) / batch))
        for step in range(steps):
            rate = alpha * max(1e-4, 1 - step / steps)
            for u, v, pick, target, noise in groups:
                i = draw(pick, batch, rng)
                a = u[i]
                err = np.zeros((batch, dim), dtype=np.float32)
                for k in range(negative + 1):
                    b = v[i] if k == 0 else target[draw(noise, batch, rng)]
                    g = ((k == 0) - sigmoid(np.einsum("ij,ij->i", vec[a], out[b]))) * rate
                    if k:
                        g = np.where(b == v[i], 0, g)
                    err += g[:, None] * out[b]
                    np.add.at(out, b, (g[:, None] * vec[a]).astype(np.float32))
                    np.add.at(touched, b, 1)
                np.add.at(vec, a, err)
                np.add.at(touched, a, 1)
        return pd.DataFrame({"node": names, "vec": list(vec), "ctx": list(ctx), "touched": touched + 1e-9})

    return run


def fit(edges: DataFrame, dim: int = 20, rounds: int = 2, samples: float = 1.0, negative: int = 1, alpha: float = 0.05, second_order: bool = True, part_edges: int = 100_000, seed: int = 0) -> DataFrame:
    """(node, vec, ctx) of every node of the edges (etype, u, v, weight); nodes are named 'w:...', 'l:...', 't:...', 'c:...'.

    Edges go to tasks by a hash, about ``part_edges`` each.  Start vectors come from a hash of the name and the seed.
    """
    e = edges.where(F.col("etype").isin(ORDER) & F.col("u").isNotNull() & F.col("v").isNotNull())
    parts = max(1, -(-e.count() // part_edges))
    e, _ = cut(e.select("etype", "u", "v", "weight", F.pmod(F.xxhash64("etype", "u", "v", F.lit(seed)), F.lit(parts)).alias("part")), "edges")
    ends = e.select("part", F.concat(F.substring("etype", 1, 1), F.lit(":"), "u").alias("node")).unionByName(e.select("part", F.concat(F.substring("etype", 2, 1), F.lit(":"), "v").alias("node"))).distinct()
    ends, _ = cut(ends, "ends")
    first = F.array(*((F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5) / dim for i in range(dim)))
    vecs = ends.select("node").distinct().select("node", first.cast("array<float>").alias("vec"), F.array_repeat(F.lit(0.0), dim).cast("array<float>").alias("ctx"))
    last = None
    for r in range(rounds):
        own = ends.join(vecs, "node").select("part", F.lit(None).cast("string").alias("etype"), F.col("node").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(0).cast("bigint").alias("weight"), "vec", "ctx")
        empty = F.lit(None).cast("array<float>")
        rows = own.unionByName(e.select("part", "etype", "u", "v", F.col("weight").cast("bigint").alias("weight"), empty.alias("vec"), empty.alias("ctx")))
        out = rows.groupBy("part").applyInPandas(_train(dim, samples, negative, alpha * (1 - r / rounds), second_order, seed + 1000 * r), "node string, vec array<float>, ctx array<float>, touched double")
        mean = [F.sum(F.col("touched") * F.col(c)[i]) / F.sum("touched") for c in ("vec", "ctx") for i in range(dim)]
        vecs = out.groupBy("node").agg(F.array(*mean[:dim]).cast("array<float>").alias("vec"), F.array(*mean[dim:]).cast("array<float>").alias("ctx"))
        vecs, at = cut(vecs, "vectors")
        if last:
            release(e.sparkSession, last)
        last = at
    return vecs


def kernel_smoothed(near: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, vec): the plain mean of weight * vec over a row's centres (key, rank, weight, vec); the nearest centre's own
    vector if its weight is 0."""
    first = F.max_by("weight", -F.col("rank"))
    mean = F.array(*(F.avg(F.col("weight") * F.col("vec")[i]) for i in range(dim)))
    return near.groupBy(key).agg(F.when(first == 0, F.max_by("vec", -F.col("rank")).cast("array<double>")).otherwise(mean).alias("vec"))
