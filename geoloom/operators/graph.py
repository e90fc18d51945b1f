"""Heterogeneous co-occurrence graph of words (w), cells (l), time slots (t) and categories (c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.scalar import kernel


def cooccurrence_edges(nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(etype, u, v, weight) from one row per post (tid, l, t, c, words).

    Both directions of every pair of l, t and c (+1 a post), of each of them with every word occurrence, and of every two
    positions with different words.  Null l, t or c have no edges.  Pairs are made inside a post, one at a time from counts of
    its different words, so no list of a post's pairs is held; counts merge before the shuffle.  ``kinds``: only these edge
    types, two letters each, are made.
    """
    all_kinds = [a + b for a in "ltcw" for b in "ltcw" if a != b or a == "w"]
    kinds = all_kinds if kinds is None else [k for k in all_kinds if k in kinds]
    sides = [F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("x"), F.lit(1).cast("bigint").alias("n")) for k in "ltc"]
    sides = F.filter(F.array(*sides), lambda s: s["x"].isNotNull())
    words = F.coalesce("words", F.array().cast("array<string>"))
    sorted_words = F.array_sort(words)
    # a word's number of positions: the array is short, and a post's rows stay where they are
    held = F.transform(F.array_distinct(sorted_words), lambda w: F.struct(F.lit("w").alias("k"), w.alias("x"), F.size(F.filter(sorted_words, lambda v: v == w)).cast("bigint").alias("n")))
    ends = nodes.select(F.concat(sides, held).alias("ends")).where(F.size("ends") > 1)
    # the ends of a post always stand in one order, so a pair is counted once and turned round after the counting
    pairs = ends.select("ends", F.posexplode("ends").alias("_i", "p")).select("p", F.explode(F.slice("ends", F.col("_i") + 2, F.size("ends"))).alias("q"))
    wanted = F.concat("p.k", "q.k").isin(kinds) | F.concat("q.k", "p.k").isin(kinds)
    once = pairs.where(wanted).groupBy(F.col("p.k").alias("j"), F.col("q.k").alias("k"), F.col("p.x").alias("x"), F.col("q.x").alias("y")).agg(F.sum(F.col("p.n") * F.col("q.n")).alias("weight"))
    there, back = F.struct(F.concat("j", "k").alias("etype"), F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.concat("k", "j").alias("etype"), F.col("y").alias("u"), F.col("x").alias("v"))
    both = F.filter(F.array(there, back), lambda e: e["etype"].isin(kinds))
    return once.select(F.explode(both).alias("e"), "weight").select("e.etype", "e.u", "e.v", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(etype, node, out_weight, in_weight, neighbours)."""
    both = edges.select("etype", F.col("u").alias("node"), F.col("weight").alias("o"), F.lit(0).cast("bigint").alias("i"), F.lit(1).alias("n"))
    both = both.unionByName(edges.select("etype", F.col("v").alias("node"), F.lit(0).cast("bigint").alias("o"), F.col("weight").alias("i"), F.lit(0).alias("n")))
    return both.groupBy("etype", "node").agg(F.sum("o").alias("out_weight"), F.sum("i").alias("in_weight"), F.sum("n").alias("neighbours"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are in the node table."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "u"), "u", "left_semi").join(n.withColumnRenamed("node", "v"), "v", "left_semi")


def proximity_edges(centres: DataFrame, value: list[str], k: int, h: float) -> DataFrame:
    """(u, v, weight): each centre's k nearest centres (itself counted) by planar distance, kernel weight, itself left out."""
    a, b = centres.alias("a"), centres.alias("b")
    d = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in value))
    # only centres within h have weight: cells of side h, each centre copied to the cells around its own
    cell = [F.floor(F.col(c) / h) for c in value]
    left = centres.withColumn("_cell", F.concat_ws("/", *cell))
    around = centres
    for i, c in enumerate(value):
        around = around.withColumn(f"_o{i}", F.explode(F.array(*(F.lit(x) for x in (-1, 0, 1)))))
    right = around.withColumn("_cell", F.concat_ws("/", *(F.floor(F.col(c) / h) + F.col(f"_o{i}") for i, c in enumerate(value))))
    a, b = left.alias("a"), right.alias("b")
    near = a.join(b, F.col("a._cell") == F.col("b._cell")).withColumn("_d", d).where(F.col("_d") <= h)
    r = F.row_number().over(Window.partitionBy("a.id").orderBy("_d", "b.id"))
    near = near.withColumn("_r", r).where((F.col("_r") <= k) & (F.col("a.id") != F.col("b.id")))
    return near.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), kernel(F.col("_d"), h).alias("weight"))
