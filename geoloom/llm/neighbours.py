"""Most similar vectors for every vector: each shard searched by scan or small-world graph, shard results merged.

Routing.  Pivots are fitted by spherical k-means on a bounded sample (``sample_rows`` different vectors, a documented
parameter; everything else covers all rows).  A vector is indexed in the shard of its nearest pivot and searched for in
the shards of its ``probes`` nearest ones and of all others at most ``margin`` radians farther than the nearest: where
several pivots share a topic they lie about as far, so the shards searched grow with the pivots of a topic.  There is a
pivot for every ``shard_rows`` vectors, at most ``max_pivots``; a pivot that attracts more than ``4 * shard_rows`` vectors
is split by hash into several shards, all of which are searched.  A shard that more than ``visit_rows`` vectors would visit
is copied for so many parts of its visitors that none gets more.  Each shard (part) is one task.  With ``scan`` it compares a
searched vector with all its vectors, which is exact; without, it builds a graph (``hnsw.Graph``), which finds close pairs
but loses many of the farther neighbours of vectors that come from another shard.  Vectors whose lists are not wanted are
indexed but not searched for.

Exact copies.  Vectors equal number for number (compared by two 64-bit hashes) collapse before anything is routed, so a
vector that a third of all rows share is indexed once.  Copies come back at the end: a group's neighbour list of k + 1 ids
serves all its members, and each takes the first k that aren't itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.hnsw import Graph


def usable(v: str, dim: int) -> Column:
    """``dim`` finite numbers, not all zero."""
    full = F.col(v).isNotNull() & (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim)
    inf = float("inf")
    return F.coalesce(full & (F.array_max(v) < inf) & (F.array_min(v) > -inf) & ((F.array_max(v) > 0) | (F.array_min(v) < 0)), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows, so the same sample gives the same pivots."""
    c = sample[np.linspace(0, len(sample) - 1, pivots).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        total = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[found] = np.where(norm > 0, total / np.maximum(norm, 1e-30), c[found])
    return c


def _reach(unit: np.ndarray, pivots: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(pivots from near to far, how many of them are searched) for every vector."""
    s = unit @ pivots.T
    near = np.argsort(-s, axis=1, kind="stable")
    far = np.arccos(np.clip(np.take_along_axis(s, near, 1), -1.0, 1.0))
    return near, np.minimum(np.maximum(probes, (far <= far[:, :1] + margin).sum(1)), len(pivots))


def _route(pivots: np.ndarray, splits: np.ndarray, parts: np.ndarray, probes: int, margin: float, dim: int):
    base = np.r_[0, np.cumsum(splits * parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, reach = _reach(_unit(_matrix(batch["v"], dim)), pivots, probes, margin)
            asked = np.asarray(batch["asked"].to_numpy(zero_copy_only=False), dtype=bool)
            reach = np.where(asked, reach, 1)
            h = np.asarray(batch["h"]).astype(np.uint64)
            for j in range(int(reach.max())):
                pivot = near[:, j]
                wide, many = np.where(reach > j, splits[pivot], 0), parts[pivot]
                mine = ((h >> np.uint64(20)) % many.astype(np.uint64)).astype(np.int64)  # the part that searches for a vector
                for k in range(int(wide.max())):
                    home = (j == 0) & (wide > k) & ((h % np.maximum(wide, 1).astype(np.uint64)).astype(np.int64) == k)
                    for p in range(int(many[wide > k].max(initial=0))):
                        here = asked & (wide > k) & (mine == p)
                        take = np.flatnonzero(here | (home & (many > p)))
                        if len(take):
                            shard, at = base[pivot[take]] + k * many[take] + p, pa.array(take)
                            cols = [pa.array(shard), batch["rep"].take(at), pa.array(home[take]), pa.array(here[take]), batch["v"].take(at)]
                            yield pa.RecordBatch.from_arrays(cols, ["shard", "rep", "indexed", "asked", "v"])

    return run


def _scan(x: np.ndarray, k: int, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of exactly the k most similar rows of x for each query but its own row; -1 where there are fewer."""
    k, nodes, sims = min(k, len(x)), [], []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        mine = np.flatnonzero(own[i : i + 256] >= 0)
        s[mine, own[i : i + 256][mine]] = -2.0
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sims.append(np.take_along_axis(s, best, 1))
        nodes.append(np.where(sims[-1] > -1.5, best, -1))
    return np.concatenate(nodes), np.concatenate(sims)


def _search(k: int, links: int, beam: int, dim: int, least: float, scan: bool):
    def run(group: pa.Table) -> pa.Table:
        raw, rep, indexed, asked = _matrix(group["v"], dim), *(np.asarray(group[n]) for n in ("rep", "indexed", "asked"))
        order = np.argsort(rep, kind="stable")  # the same graph however the rows arrive
        raw, rep, indexed, asked = raw[order], rep[order], indexed[order], np.flatnonzero(asked[order])
        x = _unit(raw)
        at = np.flatnonzero(indexed)
        at = at[np.random.default_rng(7).permutation(len(at))]
        empty = pa.table({"rep": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        if not len(at) or not len(asked):
            return empty
        graph = None if scan else Graph(x[at], links, beam)
        own = np.full(len(x), -1)
        own[at] = np.arange(len(at))
        out = []
        for i in range(0, len(asked), 8192):
            some = asked[i : i + 8192]
            node, rough = _scan(x[at], k + 1, x[some], own[some]) if scan else graph.search(x[some], k + 1, own=own[some])
            q, c = np.nonzero((node >= 0) & (rough >= least - 1e-4))
            a, b = some[q], at[node[q, c]]
            a, b = a[rep[a] != rep[b]], b[rep[a] != rep[b]]
            y, z = raw[a].astype(np.float64), raw[b].astype(np.float64)
            y /= np.maximum(np.abs(y).max(1, keepdims=True), 1e-300) if len(y) else 1
            z /= np.maximum(np.abs(z).max(1, keepdims=True), 1e-300) if len(z) else 1
            sim = np.einsum("ij,ij->i", y, z) / (np.linalg.norm(y, axis=1) * np.linalg.norm(z, axis=1))
            keep = sim >= least
            out.append((rep[a][keep], rep[b][keep], sim[keep]))
        return pa.table({n: pa.array(np.concatenate([o[j] for o in out])) for j, n in enumerate(("rep", "near", "sim"))})

    return run


def nearest(
    df: DataFrame, id_col: str, vec: str, k: int, *, dim: int, min_similarity: float = -2.0, queries: Column | None = None,
    shard_rows: int = 6000, probes: int = 3, margin: float = 0.3, max_pivots: int = 128, scan: bool = True, links: int = 10, beam: int = 20, sample_rows: int = 50_000, visit_rows: int = 200_000,
) -> DataFrame:
    """(id, near, sim, rank): for every id the k ids with the most similar vector by cosine, ties by the smaller id.

    Null ids and vectors that are null, of another length than ``dim``, all zero, or with a null or a value that is not a
    finite number take no part.  Repeated rows of an id count once; an id with several different vectors takes part with
    each of them.  ``min_similarity`` leaves out less similar pairs; ``queries``, a condition on column ``id``, says whose
    lists are wanted: the index holds every row in any case.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    v = F.col(vec).cast("array<float>")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(usable("v", dim))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    total = rows.count()
    members = rows.select("h", "h2", "id").distinct()
    wanted = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    groups = rows.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.max(wanted).alias("asked"))
    step = max(1, total // sample_rows)
    sample = rows.where(F.pmod("h", F.lit(step)) == 0).groupBy("h", "h2").agg(F.first("v").alias("v")).orderBy("h", "h2").limit(2 * sample_rows)
    fitted = sample.select("v").toArrow()["v"]
    if not len(fitted):
        return spark.createDataFrame([], "id bigint, near bigint, sim double, rank bigint")
    unit = _unit(_matrix(fitted, dim))
    n = max(1, min(total // shard_rows, len(unit) // 20, max_pivots))
    pivots = fit_pivots(unit, n)
    share = np.bincount((unit @ pivots.T).argmax(1), minlength=n) / len(unit) * total
    splits = np.maximum(1, np.ceil(share / (4 * shard_rows))).astype(np.int64)
    near, reach = _reach(unit, pivots, probes, margin)
    visits = np.bincount(near[np.arange(n) < reach[:, None]], minlength=n) / len(unit) * total
    parts = np.maximum(1, np.ceil(visits / visit_rows)).astype(np.int64)
    list_type = rows.schema["v"].dataType.simpleString()
    routed = groups.select("h", "rep", "asked", "v").mapInArrow(_route(pivots, splits, parts, probes, margin, dim), f"shard bigint, rep bigint, indexed boolean, asked boolean, v {list_type}")
    found = routed.groupBy("shard").applyInArrow(_search(k, links, beam, dim, min_similarity, scan), "rep bigint, near bigint, sim double")

    # copies: the k + 1 smallest ids of each group stand for it in other lists
    size = members.groupBy("h", "h2").agg(F.count("*").alias("c"), F.min("id").alias("rep"))
    more = size.where("c > 1").select("h", "h2", "rep")
    copies = members.join(more, ["h", "h2"]).select("rep", "id")
    order = Window.partitionBy("rep").orderBy("id")
    stand = copies.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select(F.col("rep").alias("near"), F.col("id").alias("cand"))
    alike = more.select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("sim")).where(F.lit(1.0) >= min_similarity)
    lists = found.unionByName(alike).join(stand, "near", "left").select("rep", F.coalesce("cand", "near").alias("near"), "sim")
    best = Window.partitionBy("rep").orderBy(F.desc("sim"), "near")
    lists = lists.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    out = lists.join(copies, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "near", "sim").where("id <> near")
    if queries is not None:
        out = out.where(queries)
    mine = Window.partitionBy("id").orderBy(F.desc("sim"), "near")
    return out.withColumn("rank", F.row_number().over(mine).cast("bigint")).where(F.col("rank") <= k)
