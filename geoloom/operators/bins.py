"""Anchored time bins: a post opens a bin, the first post more than ``limit`` seconds later opens the next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.ranking import positions


def bin_starts(posts: DataFrame, limit: int = 1800) -> DataFrame:
    """(bin_id, start).  The chain of starts is sequential: each depends on the one before.  It is walked by one task over
    the distinct seconds of the data, so that task grows with the time covered (31 million numbers a year), not with posts."""
    secs = posts.where("ts is not null").select(F.col("ts").cast("bigint").alias("ts")).distinct()
    size = limit + 1
    s = secs.withColumn("b", F.floor(F.col("ts") / size))
    blocks = s.groupBy("b").agg(F.array_sort(F.collect_list("ts")).alias("all"))  # at most ``size`` seconds each

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, at = [], None
        for row in pdf.sort_values("b")["all"]:
            for t in row:
                if at is None or t - at > limit:
                    at = t
                    starts.append(t)
        return pd.DataFrame({"bin_id": range(len(starts)), "start": starts})

    return blocks.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(walk, "bin_id bigint, start bigint")


def anchored_bins(posts: DataFrame, limit: int = 1800) -> DataFrame:
    """Every post with its bin_id and bin_start; posts without a time are left out."""
    starts = bin_starts(posts, limit)
    # a start covers limit + 1 seconds: at most two slots of that length
    slots = starts.withColumn("_slot", F.explode(F.array(F.floor(F.col("start") / (limit + 1)), F.floor((F.col("start") + limit) / (limit + 1))))).distinct()
    p = posts.where("ts is not null").withColumn("_slot", F.floor(F.col("ts") / (limit + 1)))
    hit = p.join(slots, "_slot").where((F.col("ts") >= F.col("start")) & (F.col("ts") - F.col("start") <= limit))
    return hit.drop("_slot").withColumnRenamed("start", "bin_start")


def manifest(binned: DataFrame) -> DataFrame:
    """(bin_id, n) of all bins but the last, which may be cut off."""
    counts = binned.groupBy("bin_id").agg(F.count("*").alias("n"))
    last = counts.agg(F.max("bin_id").alias("last"))
    return counts.crossJoin(F.broadcast(last)).where("bin_id < last").select("bin_id", "n")


def query_windows(binned: DataFrame, reference: int, length: int, low: int = 39_600, high: int = 79_200) -> DataFrame:
    """(start_bin, bins): every window of ``length`` bins after ``reference`` bins, inside the manifest, that opens at a
    proper time of day."""
    first = binned.groupBy("bin_id").agg(F.min("ts").alias("ts"))
    last = first.agg(F.max("bin_id").alias("last"))
    ok = first.crossJoin(F.broadcast(last)).where((F.col("bin_id") >= reference) & (F.col("bin_id") <= F.col("last") - length) & F.pmod("ts", F.lit(86_400)).between(low, high))
    return ok.select(F.col("bin_id").alias("start_bin"), F.sequence("bin_id", F.col("bin_id") + length - 1).alias("bins"))


def sample_windows(windows: DataFrame, n: int, seed: int) -> DataFrame:
    """n windows drawn with replacement by a seeded hash, numbered by their first bin."""
    total = windows.count()
    if not total:
        return windows.withColumn("query_id", F.lit(0)).limit(0)
    numbered = positions(windows.select("start_bin", "bins"), [F.col("start_bin").asc()], name="i")
    drawn = windows.sparkSession.range(n).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)) + 1).alias("i"))
    return drawn.join(numbered, "i").select("start_bin", "bins")
