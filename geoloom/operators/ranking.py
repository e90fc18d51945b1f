"""Positions in a total order without a window that one task must sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.storage import cut, release


def positions(df: DataFrame, order: list[Column], by: str | None = None, name: str = "pos") -> DataFrame:
    """Adds ``name`` (bigint): the row's position from 1 in ``order``, within each value of ``by`` if given.

    ``order`` must be total.  Rows are range-partitioned and sorted in their partitions; the partition and the place in it are
    written with them, one count for each partition (and value of ``by`` in it) gives the offsets, and these few rows are
    broadcast: at most as many as partitions and values together.  Null in ``by`` is a value like others.
    """
    keys = [*([F.col(by)] if by else []), *order]
    at = F.monotonically_increasing_id()  # partition number in the upper bits, place in the partition below
    rows, _ = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at), "ranked")
    part = F.shiftright("_at", 33)
    held = rows.groupBy(part.alias("_part"), *([F.col(by).alias("_by")] if by else [])).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(["_by"] if by else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
    same = [rows["_at"].bitwiseAND(~((1 << 33) - 1)) == F.shiftleft(held["_part"], 33), *([F.col(by).eqNullSafe(held["_by"])] if by else [])]
    joined = rows.join(F.broadcast(held), same[0] & same[1] if by else same[0])
    return joined.select(*(rows[c] for c in df.columns), (F.col("_at") + F.col("_before")).alias(name))


def first_rows(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """The first floor(n * share) rows in a total order; the sort is spread by range, no task takes the whole share."""
    ranked = positions(df, order, name="_pos")
    whole = ranked.agg(F.floor(F.count("*") * F.lit(share)).alias("_most"))
    return ranked.crossJoin(F.broadcast(whole)).where("_pos <= _most").select(*df.columns)  # one row


def top_lines(df: DataFrame, key: str, value: str, k: int, falling: bool = True) -> DataFrame:
    """(pos, line): the first ``k`` rows by value, ties by key, as 'key value' in text; a take-ordered, no full sort."""
    top = df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc() if falling else F.col(value).asc(), F.col(key).asc()).limit(k)
    at = F.row_number().over(Window.orderBy(F.col(value).desc() if falling else F.col(value).asc(), F.col(key).asc()))  # at most k rows
    return top.select(at.cast("bigint").alias("pos"), F.concat_ws(" ", key, F.col(value).cast("string")).alias("line"))


def strongest_first(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node): the nodes that a greedy choice keeps: taken by ``rank`` rising, a node is kept if no kept one is linked to it.

    ``nodes`` (node, rank): rank is of any sortable type and must be unique; ``links`` (a, b) hold in both directions.  Every
    round decides, all over the table at once, the nodes that come before all their undecided neighbours, which gives the
    same choice as taking them one by one.
    """
    spark = nodes.sparkSession
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rank = nodes.select("node", "rank")
    both = both.join(rank.select(F.col("node").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("node").alias("b"), F.col("rank").alias("rb")), "b")
    both, both_at = cut(both.select("a", "b", (F.col("rb") < F.col("ra")).alias("beaten")), "links")
    linked = both.select(F.col("a").alias("node")).distinct()
    kept, _ = cut(nodes.select("node").join(linked, "node", "left_anti"), "kept")
    left, left_at = cut(linked, "undecided")
    while not left.isEmpty():
        live = both.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi")
        chosen, _ = cut(left.join(live.where("beaten").select(F.col("a").alias("node")), "node", "left_anti"), "kept")
        kept = kept.unionByName(chosen)
        gone = both.join(chosen.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).unionByName(chosen).distinct()
        nxt, nxt_at = cut(left.join(gone, "node", "left_anti"), "undecided")
        release(spark, left_at)
        left, left_at = nxt, nxt_at
    release(spark, left_at, both_at)
    return kept
