"""Scalar expressions over posts: time, grid, distance and vectors.  All stay in the JVM.

Vectors of unequal length, or with a null, give null; a zero vector gives a null cosine unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6373.0
EPOCH = 946_857_600  # 2000-01-03 00:00:00 UTC, a Monday
DAY, WEEK = 86_400, 604_800


def seconds_of_day(ts: Column) -> Column:
    return F.pmod(ts, F.lit(DAY))


def seconds_of_week(ts: Column) -> Column:
    return F.pmod(ts, F.lit(WEEK))


def weekday(ts: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return (F.floor(F.pmod(ts, F.lit(WEEK)) / DAY) + 1).cast("bigint")


def hour(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(DAY)) / 3600).cast("bigint")


def clock(ts: Column) -> Column:
    """HH:MM:SS of the second of the day."""
    s = F.pmod(ts, F.lit(DAY))
    return F.concat_ws(":", *(F.lpad(F.floor(x).cast("string"), 2, "0") for x in (s / 3600, (s % 3600) / 60, s % 60)))


def seconds_since_epoch(at: Column) -> Column:
    """Whole seconds since 2000-01-03 of a timestamp, in the session's time zone."""
    return F.unix_timestamp(at) - F.lit(EPOCH)


def is_proper_time(ts: Column) -> Column:
    """11:00 to 22:00, both included."""
    return seconds_of_day(ts).between(39_600, 79_200)


def euclidean(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Planar distance in degrees."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def grid_index(value: Column, low: float | Column, high: float | Column, bins: int) -> Column:
    """Bin of a value in [low, high]; the top edge belongs to the last bin.  Null outside numbers."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.least(F.floor(bins * (value - lo) / (hi - lo)), F.lit(bins - 1)).cast("bigint")


def raw_cell(indexes: list[Column], bins: list[int]) -> Column:
    """One id for a grid cell; the first axis runs fastest."""
    out, stride = F.lit(0).cast("bigint"), 1
    for i, n in zip(indexes, bins):
        out, stride = out + i * stride, stride * n
    return out


def cell_centre(cell: Column, axis: int, bins: list[int], low: float | Column, high: float | Column) -> Column:
    stride = 1
    for n in bins[:axis]:
        stride *= n
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return lo + (hi - lo) / bins[axis] * (F.floor(cell / stride) % bins[axis] + 0.5)


def kernel(u: Column, h: float) -> Column:
    """exp(-(u/h)^2 / 2) within the bandwidth, 0 beyond."""
    return F.when(u > h, F.lit(0.0)).otherwise(F.exp(-(u / h) * (u / h) / 2))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def norm1(a: str | Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column, zero: float | None = None) -> Column:
    """Cosine; a zero vector gives ``zero``."""
    n = norm2(a) * norm2(b)
    return F.when(n == 0, F.lit(zero).cast("double")).otherwise(dot(a, b) / F.when(n != 0, n))


def unit(a: str | Column) -> Column:
    """L2-normalised; a zero vector stays."""
    v = F.col(a) if isinstance(a, str) else a
    n = norm2(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / F.when(n != 0, n)))


def sign(x: Column, eps: float = 1e-8) -> Column:
    """-1, 0 or 1; 0 within eps of 0."""
    return F.when(F.abs(x) <= eps, 0).otherwise(F.signum(x)).cast("int")


def to_dense(sparse: Column, dim: int) -> Column:
    """array<double> of a map from place (from 0) to value; places without one are 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(sparse, i), F.lit(0.0)).cast("double"))


def to_distribution(a: str | Column) -> Column:
    """Scaled to sum 1; null for a zero sum."""
    v = F.col(a) if isinstance(a, str) else a
    s = F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double"))
    return F.when(s != 0, F.transform(v, lambda x: x.cast("double") / s))


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether the items of ``part`` occur in ``whole`` in this order."""
    done = F.aggregate(whole, F.lit(0), lambda i, x: F.when(F.get(part, i).eqNullSafe(x) & (i < F.size(part)), i + 1).otherwise(i))
    return done == F.size(part)
