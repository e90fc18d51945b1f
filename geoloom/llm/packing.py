"""Filling fixed-capacity containers: best-fit decreasing with certified bounds and repacking.

Items go to partitions by a hash of their id, some ``partition_items`` each, and every partition packs its own by
best-fit decreasing.  Dual-feasible functions of the sizes give a lower bound for any packing of these items: a partition
that uses no more containers than its bound is certified.  Then the partitions exchange what is left over: each gives up
its emptiest containers, their items meet those of other partitions, and best-fit decreasing runs again on them.  A round
brings ``FAN_IN`` partitions' remainders together, so the number of rounds grows with the logarithm of the table and no
task holds more than some FAN_IN * RELEASE containers.

Only ids and sizes travel.  Every round is written to the shared folder; a lost executor costs a task, not the packing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.storage import cut

FAN_IN, RELEASE = 32, 48
_OUT = "doc_id bigint, piece int, size int, container string, fill int, open boolean"


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing of these sizes (1 to capacity) needs, by two families of dual-feasible functions.

    ``counts``: how often each size occurs; the sizes must then be different.
    """
    s, n = (np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)) if counts is not None else np.unique(np.asarray(sizes, dtype=np.int64), return_counts=True)
    if not len(s):
        return 0
    best = -(-int((s * n).sum()) // capacity)
    for k in range(1, 33):  # (k + 1) x / C rounded down to kths; kept where it is whole
        up = (k + 1) * s
        value = np.where(up % capacity == 0, s * k, up // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    for a in np.unique(np.minimum(s, capacity - s)):  # sizes above C - a fill a container, sizes below a vanish
        if 0 < a <= capacity // 2:
            value = np.where(s > capacity - a, capacity, np.where(s < a, 0, s))
            best = max(best, -(-int((value * n).sum()) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (given in falling order): the fullest container that still has room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0  # bit r of mask: some container has room r
    out = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            c = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, c, count = capacity, count, count + 1
        left = room - s
        out[i] = c
        if left:
            rooms[left].append(c)
            mask |= 1 << left
    return out


def _pack(capacity: int, turn: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        c = best_fit_decreasing(pdf["size"].to_numpy(), capacity)
        fill = np.bincount(c, weights=pdf["size"]).astype(np.int64)
        give = np.zeros(len(fill), bool)
        if not last:
            # a certified partition gives only its emptiest container, one with a gap its RELEASE emptiest
            gap = len(fill) - lower_bound(pdf["size"].to_numpy(), capacity)
            loose = np.argsort(fill, kind="stable")[: RELEASE if gap else 1]
            give[loose[fill[loose] < capacity]] = True
        part = int(pdf["part"].iloc[0])
        return pd.DataFrame(
            {"doc_id": pdf["doc_id"], "piece": pdf["piece"], "size": pdf["size"], "container": [f"r{turn}-{part}-{x}" for x in c], "fill": fill[c].astype("int32"), "open": give[c]}
        )

    return run


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, partition_items: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, size, container, fill): every piece of every item in a container of at most ``capacity``.

    An item larger than the capacity is cut into full containers and a remainder; no other item is cut (piece 0, start
    0).  Items with a null id, a null size or a size below 1 take no place.  A repeated id counts once, with its largest
    size.  An empty table gives an empty result.
    """
    one = items.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(size_col).cast("int").alias("total"))
    one, _ = cut(one, "sizes")  # the sizes may be dear (a tokenizer's): made once, and no condition on them reaches their maker
    one = one.where("total > 0")
    full = one.where(F.col("total") > capacity).select("doc_id", F.explode(F.expr(f"cast(sequence(0, total div {capacity} - 1) as array<int>)")).alias("piece"))
    done = [full.select("doc_id", "piece", F.lit(capacity).alias("size"), F.concat(F.lit("d"), "doc_id", F.lit("-"), "piece").alias("container"), F.lit(capacity).alias("fill"))]
    rest = one.select("doc_id", F.expr(f"cast(if(total > {capacity}, total div {capacity}, 0) as int)").alias("piece"), F.expr(f"cast(if(total > {capacity}, total % {capacity}, total) as int)").alias("size")).where("size > 0")
    parts, turn = -(-rest.count() // partition_items), 0
    while parts:
        spread = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(parts)))
        packed, _ = cut(spread.groupBy("part").applyInPandas(_pack(capacity, turn, parts == 1), _OUT), f"packed{turn}")
        done.append(packed.where("not open").select("doc_id", "piece", "size", "container", "fill"))
        rest = packed.where("open").select("doc_id", "piece", "size")
        parts, turn = (0 if parts == 1 else -(-parts // FAN_IN)), turn + 1
        if parts and rest.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", (F.col("piece") * capacity).cast("int").alias("start"), F.col("size").cast("int").alias("size"), "container", F.col("fill").cast("int").alias("fill"))


def summary(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, certified lower bound, tokens, share of unused space.  Collects one count per size."""
    # bounded: at most one row for every size up to the capacity
    sizes = packed.groupBy("size").agg(F.count("*").alias("n")).toPandas()
    bound = lower_bound(sizes["size"].to_numpy(), capacity, sizes["n"].to_numpy())
    return packed.agg(
        F.countDistinct("container").alias("containers"), F.lit(int(bound)).cast("bigint").alias("lower_bound"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("tokens"),
    ).withColumn("unused_share", F.try_divide(F.col("containers") * float(capacity) - F.col("tokens"), F.col("containers") * float(capacity)))
