"""Readers of the parquet tables and the post predicates that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrap_lng(lng: Column) -> Column:
    """The same longitude in [-180, 180); values already there stay bit for bit."""
    return lng - F.floor((lng + 180.0) / 360.0).cast("double") * 360.0


def has_place(lat: str | Column = "lat", lng: str | Column = "lng") -> Column:
    """lat and lng are finite numbers, lat in [-90, 90], not both 0 (longitudes a turn apart are one)."""
    a, o = (F.col(x) if isinstance(x, str) else x for x in (lat, lng))
    ok = a.isNotNull() & o.isNotNull() & ~F.isnan(a) & ~F.isnan(o) & a.between(-90.0, 90.0) & (F.abs(o) < 1e15)
    return F.coalesce(ok & ~((a == 0.0) & (F.pmod(F.when(ok, o), F.lit(360.0)) == 0.0)), F.lit(False))


def tokens(words: str | Column) -> Column:
    """Non-empty pieces of a text after cutting at U+0020 only; null text gives null."""
    return F.filter(F.split(words, " ", -1), lambda w: w != "")
