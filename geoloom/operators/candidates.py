"""Candidate events: members with their vectors, features, ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.scalar import cosine, unit


def members(candidates: DataFrame) -> DataFrame:
    """(candidate_id, query_id, tid, uid, lat, lng, ts, message), one row for each member; repeated rows collapse."""
    m = candidates.select("candidate_id", "query_id", F.explode("members").alias("m"))
    return m.select("candidate_id", "query_id", F.col("m.tweet_id").alias("tid"), F.col("m.user_id").alias("uid"), "m.lat", "m.lng", F.col("m.timestamp").alias("ts"), "m.message").distinct()


def vectors(embeddings: DataFrame, dim: int, *names: str) -> DataFrame:
    """(tid, names...): one row a tid, only complete vectors of ``dim`` finite numbers."""
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & (F.size(n) == dim) & (F.size(F.array_compact(n)) == dim) & (F.array_max(n) < float("inf")) & (F.array_min(n) > -float("inf"))
    return embeddings.select("tid", *names).where(F.coalesce(ok, F.lit(False))).distinct()


def keep_by_users(m: DataFrame, low: int = 5, high: int = 50) -> DataFrame:
    """Members of candidates with at least ``low`` and fewer than ``high`` different users."""
    users = m.groupBy("candidate_id").agg(F.countDistinct("uid").alias("users")).where((F.col("users") >= low) & (F.col("users") < high))
    return m.join(users.select("candidate_id"), "candidate_id", "left_semi")


def keep_nonzero(m: DataFrame, vec: str = "textual_embedding", least: int = 5) -> DataFrame:
    """Members with a non-zero vector, of candidates that keep at least ``least`` of them."""
    ok = m.where((F.array_max(vec) > 0) | (F.array_min(vec) < 0))
    # a candidate's members were one row's array, so a window over a candidate is small; it saves reading everything twice
    n = F.count("*").over(Window.partitionBy("candidate_id"))
    return ok.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def with_cosines(m: DataFrame, dim: int) -> DataFrame:
    """Adds cos_s, cos_t, cos_st (null for a zero vector) and the unit vector u of the text (null if zero); drops the vectors.

    The vectors must be complete (``vectors``): whole Arrow batches become matrices without a copy.
    """
    names = ["spatial_embedding", "temporal_embedding", "textual_embedding"]
    rest = [c for c in m.columns if c not in names]

    def cos(a: np.ndarray, b: np.ndarray) -> pa.Array:
        n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return pa.array(np.einsum("ij,ij->i", a, b) / np.where(n > 0, n, 1), mask=n == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t, x = (np.asarray(batch[n].flatten(), dtype=np.float64).reshape(-1, dim) for n in names)
            n = np.linalg.norm(x, axis=1)
            u = pa.FixedSizeListArray.from_arrays((x / np.where(n > 0, n, 1)[:, None]).ravel(), dim).cast(pa.list_(pa.float64()))
            u = pa.compute.if_else(pa.array(n > 0), u, pa.scalar(None, u.type))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), cos(s, x), cos(t, x), cos((s + t) / 2, x), u], [*rest, "cos_s", "cos_t", "cos_st", "u"])

    kinds = dict(m.dtypes)
    return m.select(*rest, *names).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", cos_s double, cos_t double, cos_st double, u array<double>")


def _mean_columns(dim: int) -> list[Column]:
    return [F.avg(F.get("u", F.lit(i))).alias(f"_{i}") for i in range(dim)]


def mean_direction(m: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(key, mean): the average of the unit vectors of a group; zero vectors are skipped; one aggregation, no list of members."""
    u = m.where((F.array_max(vec) > 0) | (F.array_min(vec) < 0)).select(key, unit(vec).alias("u"))
    return u.groupBy(key).agg(*_mean_columns(dim)).select(key, F.array(*(F.col(f"_{i}") for i in range(dim))).alias("mean"))


def mean_of_units(w: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, mean) from unit vectors u, as ``with_cosines`` gives them."""
    return w.where("u is not null").groupBy(key).agg(*_mean_columns(dim)).select(key, F.array(*(F.col(f"_{i}") for i in range(dim))).alias("mean"))


def features(m: DataFrame, dim: int) -> DataFrame:
    """The eight features of every candidate from members with complete spatial, temporal and textual vectors.

    The mean cosine of the members to their mean direction is the length of that mean, (1/n) sum u_i . mean / |mean|, so one
    aggregation gives it together with the rest.
    """
    per = with_cosines(m, dim).groupBy("candidate_id").agg(
        F.avg("cos_s").alias("spatial_unusualness"), F.avg("cos_t").alias("temporal_unusualness"), F.avg("cos_st").alias("st_unusualness"),
        F.stddev_pop("lat").alias("lat_std"), F.stddev_pop("lng").alias("lng_std"), F.stddev_pop("ts").alias("time_std"),
        F.count("*").cast("double").alias("spatial_burstiness"), *_mean_columns(dim),
    )
    length = F.sqrt(F.aggregate(F.array(*(F.col(f"_{i}") for i in range(dim))), F.lit(0.0), lambda s, x: s + x * x))
    return per.select(
        "candidate_id", "spatial_unusualness", "temporal_unusualness", "st_unusualness", "lat_std", "lng_std", "time_std", F.when(length > 0, length).alias("semantic_std"), "spatial_burstiness"
    )


def rank_within_query(cands: DataFrame, feats: DataFrame, limit: int = 10, spread: float = 0.02) -> DataFrame:
    """(query_id, candidate_id, rank): compact candidates by st_unusualness rising, nulls and NaN left out, ties by id."""
    f = feats.where((F.col("lat_std") < spread) & (F.col("lng_std") < spread) & F.col("st_unusualness").isNotNull() & ~F.isnan("st_unusualness"))
    c = cands.select("candidate_id", "query_id").where("query_id is not null").distinct()
    j = c.join(f.select("candidate_id", (F.col("st_unusualness") + 0.0).alias("st_unusualness")).distinct(), "candidate_id")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("st_unusualness", "candidate_id"))
    return j.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= limit).select("query_id", "candidate_id", "rank")


def uniqueness(directions: DataFrame, dim: int) -> DataFrame:
    """(candidate_id, uniqueness): the mean cosine to the other candidates of the query, from (candidate_id, query_id, mean).

    The sum of a query's unit vectors gives every mean at once: u . (S - u) / (n - 1); no pairs.  A query of one gives null.
    """
    u = directions.select("candidate_id", "query_id", unit("mean").alias("u"))
    s = u.groupBy("query_id").agg(F.count("*").alias("n"), *(F.sum(F.col("u")[i]).alias(f"_{i}") for i in range(dim)))
    s = s.select("query_id", "n", F.array(*(F.col(f"_{i}") for i in range(dim))).alias("s"))
    dot = F.aggregate(F.zip_with("u", "s", lambda x, y: x * (y - x)), F.lit(0.0), lambda t, x: t + x)
    return u.join(s, "query_id").select("candidate_id", F.when(F.col("n") > 1, dot / (F.col("n") - 1)).alias("uniqueness"))


def top_members(m: DataFrame, dim: int, n: int = 10) -> DataFrame:
    """(candidate_id, tid, rank): members by cosine to the candidate's mean direction falling, ties by tid."""
    mean = mean_direction(m, "candidate_id", "textual_embedding", dim)
    j = m.where((F.array_max("textual_embedding") > 0) | (F.array_min("textual_embedding") < 0)).join(mean, "candidate_id").withColumn("_c", F.round(cosine("textual_embedding", "mean"), 9))
    r = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("_c"), "tid"))
    return j.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= n).select("candidate_id", "tid", "rank")


def rank_all(cands: DataFrame, feats: DataFrame, limit: int = 10, spread: float = 0.02) -> DataFrame:
    """(query_id, candidate_id, pos): the ranked candidates of all queries in one list by st_unusualness rising, ties by id."""
    from geoloom.operators.ranking import positions

    best = rank_within_query(cands, feats, limit, spread)
    score = feats.where(F.col("st_unusualness").isNotNull() & ~F.isnan("st_unusualness")).groupBy("candidate_id").agg(F.min(F.col("st_unusualness") + 0.0).alias("_s"))
    return positions(best.join(score, "candidate_id").select("query_id", "candidate_id", "_s"), [F.col("_s").asc(), F.col("candidate_id").asc(), F.col("query_id").asc()]).drop("_s")


def place_statistics(m: DataFrame, key: str, lambda0: float = 0.5, delta0: float = 0.01) -> DataFrame:
    """(key, n, mean_y, mean_x, yy, yx, xx): what a Gaussian cluster with a prior at the origin keeps of its points (lat, lng),
    from plain sums: the same numbers that adding the points one by one gives."""
    y, x = F.col("lat"), F.col("lng")
    s = m.groupBy(key).agg(F.count("*").alias("n"), F.sum(y).alias("_y"), F.sum(x).alias("_x"), F.sum(y * y).alias("_yy"), F.sum(y * x).alias("_yx"), F.sum(x * x).alias("_xx"))
    held = F.col("n") + lambda0
    s = s.withColumn("mean_y", F.col("_y") / held).withColumn("mean_x", F.col("_x") / held)
    return s.select(
        key, "n", "mean_y", "mean_x", (F.col("_yy") + delta0 - held * F.col("mean_y") * F.col("mean_y")).alias("yy"),
        (F.col("_yx") - held * F.col("mean_y") * F.col("mean_x")).alias("yx"), (F.col("_xx") + delta0 - held * F.col("mean_x") * F.col("mean_x")).alias("xx"),
    )
