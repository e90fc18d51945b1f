"""Word statistics: counts, vocabularies, tf-idf, grid cells and how local a word is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.ranking import first_rows, positions


def word_counts(tok: DataFrame) -> DataFrame:
    return tok.groupBy("word").agg(F.count("*").alias("cnt"))


def inverted_index(tok: DataFrame) -> DataFrame:
    """(word, tid, n): one posting a row, how often the post holds the word; a word of a third of all posts has as many rows,
    not a list that one task must hold."""
    return tok.groupBy("word", "tid").agg(F.count("*").alias("n"))


def infrequent(counts: DataFrame, th: int) -> DataFrame:
    return counts.where(F.col("cnt") <= th)


def frequent(counts: DataFrame, th: int) -> DataFrame:
    return counts.where(F.col("cnt") >= th)


def vocabulary(counts: DataFrame, first: int, last: int) -> DataFrame:
    """(word, cnt, rank): ranks first to last - 1 from 0, by count falling, ties by word.  A take-ordered, no full sort."""
    top = counts.where("word <> ''").orderBy(F.desc("cnt"), "word").limit(last)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "word")) - 1)  # at most ``last`` rows
    return r.where(F.col("rank") >= first).select("word", "cnt", F.col("rank").cast("bigint").alias("rank"))


def tfidf(tok: DataFrame, records: int) -> DataFrame:
    """(word, tf, idf, score): tf over all tokens, idf = max(ln(N / df), 1e-10)."""
    per = tok.groupBy("word", "tid").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("cnt"), F.count("*").alias("df"))
    total = per.agg(F.sum("cnt").alias("total"))
    t = per.crossJoin(F.broadcast(total))  # one row
    idf = F.greatest(F.log(F.lit(float(records)) / F.col("df")), F.lit(1e-10))
    t = t.withColumn("tf", F.col("cnt") / F.col("total")).withColumn("idf", idf)
    return t.select("word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("score"))


def cell_spread(tok: DataFrame) -> DataFrame:
    """(word, freq, n_cells, entropy, localness) from (tid, word, cell): different posts by cell.

    entropy = -sum p ln p over cells; localness = ln(min(freq, 40000)) - entropy.
    """
    cells = tok.select("word", "cell", "tid").distinct().groupBy("word", "cell").agg(F.count("*").alias("n"))
    # -sum p ln p = ln(total) - sum(n ln n) / total: one aggregation
    per = cells.groupBy("word").agg(F.sum("n").alias("freq"), F.count("*").alias("n_cells"), F.sum(F.col("n") * F.log("n")).alias("_s"))
    ent = F.log("freq") - F.col("_s") / F.col("freq")
    return per.withColumn("entropy", ent).withColumn("localness", F.log(F.least("freq", F.lit(40000))) - ent).drop("_s")


def top_fraction(scored: DataFrame, score: str, key: str, fraction: float) -> DataFrame:
    """The first floor(n * fraction) rows by score falling, ties by key."""
    return first_rows(scored, [F.desc(score), F.col(key).asc()], fraction)


def encode(counts: DataFrame, key: str, min_freq: int) -> DataFrame:
    """(key, cnt, id): id 0 for the most frequent; keys below ``min_freq`` get none.

    No task sorts the whole vocabulary, nor all the keys of one count (see ``positions``).
    """
    kept = counts.where(F.col("cnt") >= min_freq).select(key, "cnt")
    return positions(kept, [F.desc("cnt"), F.col(key).asc()], name="id").select(key, "cnt", (F.col("id") - 1).alias("id"))
