"""Top N items within every group.

First pass: each group's scores are counted in a histogram whose bins keep the order of the scores (a signed logarithmic
scale, so no minimum or maximum is needed beforehand).  Partial counts are merged before the shuffle.  The first bin at
which the running count reaches N is a safe threshold: at least N rows survive it.  Second pass: rows past their group's
threshold are dropped where they are read, and the survivors are ranked exactly by (score, tie key).

Only groups of more than ``small`` rows get a threshold, so the threshold table has at most rows / small entries; it is
broadcast while it is below ``broadcast_rows`` (counted) and otherwise joined with the large side salted.  The final
ranking keeps N rows a group in every task before its shuffle (a window group limit), so a group in which a third of all
rows share one score is cut where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.storage import at_most


def _bin(score: Column) -> Column:
    """A long that never falls when the score rises; at most some 40,000 different values."""
    size = F.least(F.log2(1.0 + F.least(F.abs(score), F.lit(1e300)) * 1024.0) * 32.0, F.lit(1e6))
    return (F.signum(score) * F.floor(size)).cast("bigint")


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, *, descending: bool = False, unique: bool = False, small: int = 1000, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """(group, tie, score, rank): the n rows of every group with the smallest (largest) score, ties by the tie key ascending.

    Rows with a null group, tie key or score, or a score that is not a number, take no part; -0.0 equals 0.0; rows equal
    in group, tie key and score count once.  Groups with fewer than n rows give all of them.  ``unique`` says that there are
    no such repeated rows: the histogram then shuffles one count for each bin and task only.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(tie).alias("_t"), (F.col(score).cast("double") + 0.0).alias("_s"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_t").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    rows = rows.withColumn("_b", (-_bin(F.col("_s")) if descending else _bin(F.col("_s"))))
    # repeated rows would raise a bin's count without adding a survivor: the histogram counts different rows
    once = rows if unique else rows.select("_g", "_b", "_t", "_s").distinct()
    counts = once.groupBy("_g", "_b").agg(F.count("*").alias("_c"))
    run = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_g")
    cut = counts.withColumn("_run", F.sum("_c").over(run)).withColumn("_all", F.sum("_c").over(whole))
    cut = cut.where((F.col("_all") > small) & (F.col("_run") >= n)).groupBy("_g").agg(F.min("_b").alias("_max"))
    if at_most(cut, broadcast_rows):
        rows = rows.join(F.broadcast(cut), "_g", "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_t"), F.lit(salts)))
        cut = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        rows = rows.join(cut, ["_g", "_salt"], "left")
    rows = rows.where(F.col("_max").isNull() | (F.col("_b") <= F.col("_max"))).select("_g", "_t", "_s")
    order = [F.col("_s").desc() if descending else F.col("_s").asc(), F.col("_t").asc()]
    rank = Window.partitionBy("_g").orderBy(*order)
    # dense_rank gives repeated rows one rank; the limit on it is pushed below the shuffle
    best = rows.withColumn("_r", F.dense_rank().over(rank)).where(F.col("_r") <= n).distinct()
    return best.select(F.col("_g").alias(group), F.col("_t").alias(tie), F.col("_s").alias(score), F.col("_r").cast("bigint").alias("rank"))
