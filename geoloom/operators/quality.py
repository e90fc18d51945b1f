"""Phrase quality: automatic labels, forest scores, re-estimation of segment counts and propagation over neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.phrases import segment
from geoloom.operators.ranking import first_rows, positions
from geoloom.storage import at_most, cut, release


def auto_labels(feats: DataFrame, names: list[str], known: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(phrase, label): z-scored features, k-means on known phrases (one of each cluster is 1) and on the rest (0)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    prep = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="skip"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True)])
    x = prep.fit(feats).transform(feats).select("phrase", "_z")
    kn = known.select("phrase").distinct()
    out = None
    for label, part, clusters in ((1, x.join(kn, "phrase", "left_semi"), k), (0, x.join(kn, "phrase", "left_anti"), 2 * k)):
        c = KMeans(k=clusters, featuresCol="_z", predictionCol="_c", seed=seed).fit(part).transform(part)
        one = c.groupBy("_c").agg(F.min_by("phrase", F.struct(F.xxhash64("phrase", F.lit(seed)), "phrase")).alias("phrase")).select("phrase", F.lit(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def forest_scores(feats: DataFrame, names: list[str], labels: DataFrame, trees: int = 100, depth: int = 18, seed: int = 0, most: int = 100_000) -> tuple[DataFrame, list[float]]:
    """((phrase, score), importances): mean leaf value of regression trees fitted on the labelled phrases (at most ``most``,
    checked), balanced by weight."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    v = VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="skip").transform(feats)
    if not at_most(labels, most):
        raise ValueError(f"more than {most} labels; fit on a sample of them")
    lab = labels.select("phrase", F.col("label").cast("double").alias("_y"))
    n = lab.groupBy("_y").agg(F.count("*").alias("_n"))
    train = v.join(F.broadcast(lab.join(n, "_y").withColumn("_w", 1 / F.col("_n"))), "phrase")
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, featuresCol="_v", labelCol="_y", weightCol="_w", seed=seed, featureSubsetStrategy="onethird").fit(train)
    return model.transform(v).select("phrase", F.col("prediction").alias("score")), list(model.featureImportances.toArray())


def reestimate(records: DataFrame, tokens: str, phrases: DataFrame, rounds: int = 2, penalty: float = 4.0, most: int = 500_000) -> DataFrame:
    """(phrase, n, cnt): segment counts after some rounds of segmenting with the current probabilities and counting again.

    Each round normalises the counts per length, lowers longer phrases by the penalty and segments every record.  The
    dictionary goes to the tasks as a map while it has at most ``most`` entries (checked), else this raises: raise the
    support threshold.
    """
    spark, now, path = records.sparkSession, phrases.select("phrase", "n", "cnt"), None
    for _ in range(rounds):
        if not at_most(now, most):
            raise ValueError(f"more than {most} phrases; raise the support threshold")
        d = now.toPandas()
        total = d.groupby("n")["cnt"].transform("sum")
        costs = {p: math.log(c / t) for p, c, t in zip(d["phrase"], d["cnt"], total)}
        seg = records.select(F.explode(segment(F.col(tokens), costs, penalty)).alias("phrase"))
        new, at = cut(seg.groupBy("phrase").agg(F.count("*").alias("cnt")).withColumn("n", F.size(F.split("phrase", " ")).cast("bigint")).select("phrase", "n", "cnt"), "segments")
        if path:
            release(spark, path)
        now, path = new, at
    return now


def find_penalty(records: DataFrame, tokens: str, phrases: DataFrame, good: DataFrame, broken_share: float = 0.05, steps: int = 6, most: int = 500_000) -> float:
    """The largest penalty, by bisection of its logarithm between 1e-6 and 200, at which at most ``broken_share`` of the good
    phrases come apart when segmented alone.  The dictionary goes to the tasks while it has at most ``most`` entries (checked)."""
    lo, hi = math.log(1e-6), math.log(200.0)
    if not at_most(phrases, most):
        raise ValueError(f"more than {most} phrases; raise the support threshold")
    d = phrases.toPandas()
    total = d.groupby("n")["cnt"].transform("sum")
    costs = {p: math.log(c / t) for p, c, t in zip(d["phrase"], d["cnt"], total)}
    words = good.select(F.split("phrase", " ").alias("w"))
    n = max(1, words.count())
    for _ in range(steps):
        mid = (lo + hi) / 2
        broken = words.select(F.size(segment(F.col("w"), costs, math.exp(mid))).alias("k")).where("k > 1").count()
        lo, hi = (mid, hi) if broken <= broken_share * n else (lo, mid)
    return math.exp(lo)


def propagate(scores: DataFrame, neighbours: DataFrame, stop: DataFrame, alpha: float = 0.7, rounds: int = 5) -> DataFrame:
    """(word, score): unknown words start with the mean over their 3 neighbours' sim * score, then every round takes alpha of
    the old score and the rest from the weighted mean of the neighbours; phrases with a given score keep it.

    ``scores`` (word, score) are given; ``neighbours`` (word, near, sim).  A stopword's neighbour mean counts 0.
    """
    spark = scores.sparkSession
    given = scores.select("word", F.col("score").alias("given"))
    base = neighbours.join(given.withColumnRenamed("word", "near"), "near", "left").groupBy("word").agg((F.sum(F.col("sim") * F.coalesce("given", F.lit(0.0))) / 3).alias("start"))
    now = base.join(given, "word", "full").select("word", F.coalesce("given", "start").alias("score"), "given")
    is_stop = stop.select("word", F.lit(True).alias("s")).distinct()
    now, path = cut(now, "quality")
    for _ in range(rounds):
        mean = neighbours.join(now.select(F.col("word").alias("near"), "score"), "near").groupBy("word").agg((F.sum(F.col("sim") * F.col("score")) / F.nullif(F.sum("sim"), F.lit(0.0))).alias("m"))
        m = F.when(F.col("s"), F.lit(0.0)).otherwise(F.coalesce("m", F.lit(0.0)))
        nxt, at = cut(now.join(mean, "word", "left").join(is_stop, "word", "left").select("word", F.coalesce("given", alpha * F.col("score") + (1 - alpha) * m).alias("score"), "given"), "quality")
        release(spark, path)
        now, path = nxt, at
    return now.select("word", "score")


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    s = df.agg(*(f(c).alias(f"{k}_{c}") for c in cols for f, k in ((F.avg, "m"), (F.stddev_samp, "s"))))
    return df.crossJoin(F.broadcast(s)).select("*", *(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias(f"z_{c}") for c in cols)).drop(*(f"{k}_{c}" for c in cols for k in "ms"))


def top_half(counts: DataFrame, key: str) -> DataFrame:
    """The first half of the rows by count falling, ties by key."""
    return first_rows(counts, [F.desc("cnt"), F.col(key).asc()], 0.5)


def ranked(scores: DataFrame) -> DataFrame:
    """Adds pos: order by (score, phrase) falling inside each length."""
    sized = scores.withColumn("n", F.size(F.split("phrase", " ")).cast("bigint"))
    return positions(sized, [F.desc("score"), F.desc("phrase")], by="n")
