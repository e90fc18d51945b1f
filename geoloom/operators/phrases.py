"""Phrase mining: frequent n-grams, concordance, segmentation, support and merging."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.ranking import positions
from geoloom.storage import at_most, cut


def frequent_ngrams(records: DataFrame, tokens: str, max_n: int, threshold: int) -> DataFrame:
    """(phrase, n, cnt): overlapping n-grams without '$' that occur at least ``threshold`` times, all prefixes frequent too.

    One pass a length; an n-gram is only made where its prefix is frequent (a semi-join on the shorter phrases, which are
    written as a table first).  Ends at the first length without phrases, as none longer can be frequent.
    """
    base = records.select(F.monotonically_increasing_id().alias("_id"), F.col(tokens).alias("_w"))
    out, prev = None, None
    for n in range(1, max_n + 1):
        at = F.explode(F.sequence(F.lit(1), F.size("_w") - (n - 1)))
        g = base.where(F.size("_w") >= n).select("_w", at.alias("_i")).select(F.slice("_w", F.col("_i"), n).alias("_g")).where(~F.array_contains("_g", "$"))
        if prev is not None:
            g = g.withColumn("phrase", F.array_join(F.slice("_g", 1, n - 1), " ")).join(prev.select("phrase"), "phrase", "left_semi")
        c = g.select(F.array_join("_g", " ").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= threshold)
        c, _ = cut(c.select("phrase", F.lit(n).cast("bigint").alias("n"), "cnt"), "grams")
        if prev is not None and c.isEmpty():
            break
        out, prev = (c if out is None else out.unionByName(c)), c
    return out


def concordance(phrases: DataFrame, total_tokens: int) -> DataFrame:
    """(phrase, f1, f2, f3, f4) for phrases of two words or more: the best split into two known phrases AB and CD.

    p = cnt / (tokens / n); f1 = p / (p_AB p_CD); f2 = cnt / sqrt(cnt_AB cnt_CD); f3 = sqrt(cnt) ln f1; f4 = p ln f1.
    """
    p = phrases.withColumn("p", F.col("cnt") / (F.lit(float(total_tokens)) / F.col("n")))
    w = F.split("phrase", " ")
    cut = p.where("n >= 2").withColumn("_k", F.explode(F.sequence(F.lit(1), (F.col("n") - 1).cast("int"))))
    cut = cut.withColumn("_a", F.array_join(F.slice(w, 1, F.col("_k")), " ")).withColumn("_b", F.array_join(F.slice(w, F.col("_k") + 1, (F.col("n") - F.col("_k")).cast("int")), " "))
    a = p.select(F.col("phrase").alias("_a"), F.col("p").alias("pa"), F.col("cnt").alias("ca"))
    b = p.select(F.col("phrase").alias("_b"), F.col("p").alias("pb"), F.col("cnt").alias("cb"))
    j = cut.join(a, "_a").join(b, "_b").withColumn("_m", F.col("pa") * F.col("pb"))
    best = j.groupBy("phrase", "cnt", "p").agg(F.max(F.struct("_m", "_k", "ca", "cb")).alias("x"))
    f1 = F.col("p") / F.col("x._m")
    return best.select(
        "phrase", f1.alias("f1"), (F.col("cnt") / F.sqrt(F.col("x.ca").cast("double") * F.col("x.cb"))).alias("f2"), (F.sqrt("cnt") * F.log(f1)).alias("f3"), (F.col("p") * F.log(f1)).alias("f4")
    )


def stopword_features(phrases: DataFrame, stop: DataFrame, idf: DataFrame) -> DataFrame:
    """(phrase, avg_idf, stop_ratio, first_stop, last_stop); words without an idf count 0."""
    w = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("i", "word"))
    w = w.join(stop.select("word", F.lit(1).alias("s")).distinct(), "word", "left").join(idf.select("word", "idf"), "word", "left")
    s = F.coalesce("s", F.lit(0))
    return w.groupBy("phrase").agg(
        F.avg(F.coalesce("idf", F.lit(0.0))).alias("avg_idf"), F.avg(s).alias("stop_ratio"), F.min_by(s, "i").cast("bigint").alias("first_stop"), F.max_by(s, "i").cast("bigint").alias("last_stop")
    )


def _neighbours(words: str) -> Column:
    """Neighbouring words of an array as (a, b)."""
    w = F.col(words)
    return F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("a"), F.slice(w, 2, F.size(w) - 1).alias("b"))


def bigram_scores(records: DataFrame, words: str, min_count: int) -> DataFrame:
    """(a, b, cnt_a, cnt_b, cnt_ab, score) from arrays of words: (ab - min) / a / b * N; pairs don't cross records.

    A record's pairs are made where the record lies; only counts are shuffled.
    """
    uni = records.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    nxt = records.where(F.size(words) > 1).select(F.explode(_neighbours(words)).alias("p"))
    bi = nxt.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("cnt_ab"))
    total = uni.agg(F.sum("n").alias("_N"))
    j = bi.join(uni.select(F.col("word").alias("a"), F.col("n").alias("cnt_a")), "a").join(uni.select(F.col("word").alias("b"), F.col("n").alias("cnt_b")), "b")
    j = j.where((F.col("cnt_a") >= min_count) & (F.col("cnt_b") >= min_count)).crossJoin(F.broadcast(total))
    score = (F.col("cnt_ab") - min_count) / F.col("cnt_a") / F.col("cnt_b") * F.col("_N")
    return j.select("a", "b", "cnt_a", "cnt_b", "cnt_ab", score.alias("score"))


def join_bigrams(records: DataFrame, words: str, scores: DataFrame, threshold: float, id_col: str = "tid", broadcast_rows: int = 200_000) -> DataFrame:
    """(id, words): neighbouring words whose score passes the threshold joined by '_'; a joined word can't start the next pair.

    The pairs above the threshold are joined to each position (broadcast while they are at most ``broadcast_rows``, counted);
    the left-to-right choice is a fold over the flags.
    """
    hot = scores.where(F.col("score") > threshold).select("a", "b", F.lit(True).alias("hot"))
    w = F.col(words)
    tok = records.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"))).alias("pos", "p"))
    tok = tok.select("id", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    tok = tok.join(F.broadcast(hot) if at_most(hot, broadcast_rows) else hot, ["a", "b"], "left")
    rows = tok.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "a", F.coalesce("hot", F.lit(False)).alias("hot")))).alias("r"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("glue"))

    def step(s, x):
        glued = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.concat(F.element_at(s["out"], -1), F.lit("_"), x["a"])))
        return F.struct(F.when(s["glue"], glued).otherwise(F.concat(s["out"], F.array(x["a"]))).alias("out"), (~s["glue"] & x["hot"]).alias("glue"))

    return rows.select(F.col("id").alias(id_col), F.aggregate("r", start, step, lambda s: s["out"]).alias("words"))


def support_filter(ranked: DataFrame, segmented: DataFrame, sigma: int) -> DataFrame:
    """Ranked phrases (phrase, score) whose '_'-joined lower form occurs at least sigma times among segmented tokens (word)."""
    n = segmented.groupBy(F.lower("word").alias("_key")).agg(F.count("*").alias("support"))
    j = ranked.withColumn("_key", F.replace(F.lower("phrase"), F.lit(" "), F.lit("_"))).join(n, "_key", "left")
    return j.withColumn("support", F.coalesce("support", F.lit(0))).where(F.col("support") >= sigma).drop("_key")


def combine_phrases(ranked: DataFrame) -> DataFrame:
    """Lengths 2 to 6 in one list (phrase, score), blanks to '_'."""
    n = F.size(F.split("phrase", " "))
    return ranked.where(n.between(2, 6)).select(F.replace("phrase", F.lit(" "), F.lit("_")).alias("phrase"), "score")


def prune_by_window(ranked: DataFrame, half: int, threshold: float, most: int) -> DataFrame:
    """Per length, rows (phrase, n, score, quality) in score order up to the first position whose mean quality over +-half
    falls below the threshold, and no more than ``most``."""
    r, _ = cut(positions(ranked, [F.desc("score"), F.desc("phrase")], by="n"), "positions")
    # the mean over neighbours in a list that no task holds: blocks of positions, each with the rows around it
    size = max(10_000, 4 * half)
    block = F.floor(F.col("pos") / size)
    edges = F.array_distinct(F.array(block, F.floor((F.col("pos") - half) / size), F.floor((F.col("pos") + half) / size)))
    around = Window.partitionBy("n", "_block").orderBy("pos").rowsBetween(-half, half)
    mean = r.select("n", "pos", "quality", F.explode(edges).alias("_block")).withColumn("_m", F.avg("quality").over(around)).where(F.col("_block") == block)
    low = mean.where(F.col("_m") < threshold).groupBy("n").agg(F.min("pos").alias("_cut"))
    return r.join(F.broadcast(low), "n", "left").where((F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))) & (F.col("pos") <= most)).select("phrase", "n", "score", "quality", F.col("pos").cast("bigint").alias("pos"))


def length_normalised(phrases: DataFrame) -> DataFrame:
    """prob = cnt over the sum of its length; two small aggregations instead of a window over one length."""
    s = phrases.groupBy("n").agg(F.sum("cnt").alias("_s"))
    return phrases.join(F.broadcast(s), "n").select("phrase", "n", "cnt", (F.col("cnt") / F.col("_s")).alias("prob"))


def segment(words: Column, costs: dict[str, float], penalty: float, max_n: int = 6) -> Column:
    """array<string>: the segmentation of an array of words with the greatest sum of ln p - (len - 1) ln penalty.

    ``costs`` maps phrases to ln p; a word without one costs ln 1e-12; of equal sums the longer first segment wins.  The
    map is broadcast with the function: keep it to the dictionary of phrases above a threshold.
    """
    unknown, pen = math.log(1e-12), math.log(penalty)

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        def one(w):
            if w is None:
                return None
            best, back = [0.0], [0]
            for i in range(1, len(w) + 1):
                top, at = -math.inf, i - 1
                for j in range(max(0, i - max_n), i):
                    p = costs.get(" ".join(w[j:i]), unknown if i - j == 1 else None)
                    if p is not None and best[j] + p - (i - j - 1) * pen > top:
                        top, at = best[j] + p - (i - j - 1) * pen, j
                best.append(top)
                back.append(at)
            out, i = [], len(w)
            while i:
                out.append(" ".join(w[back[i] : i]))
                i = back[i]
            return out[::-1]

        return batch.map(one)

    return run(words)
