"""Ranks with ties, rank metrics, classification metrics and model evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.storage import at_most, cut, release


def mid_rank(scores: DataFrame, case: str, score: str, is_truth: str) -> DataFrame:
    """(case, rank): the truth's rank among all scores of its case, 1 best, the middle one of equals."""
    truth = scores.where(is_truth).select(case, F.col(score).alias("_t"))
    j = scores.where(~F.col(is_truth)).select(case, score).join(truth, case, "right")
    return j.groupBy(case).agg((F.sum(F.coalesce((F.col(score) > F.col("_t")).cast("int"), F.lit(0))) + (F.sum(F.coalesce((F.col(score) == F.col("_t")).cast("int"), F.lit(0))) + 2) / 2).alias("rank"))


def rank_metrics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.round(F.avg(1 / F.col("rank")), 4).alias("mrr"), F.round(F.avg("rank"), 4).alias("mean_rank"))


def prf1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of class 1; a ratio without cases is null."""
    tp, fp, fn = (F.sum(((F.col(predicted) == p) & (F.col(label) == t)).cast("double")) for p, t in ((1, 1), (1, 0), (0, 1)))
    c = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return c.select(
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def balanced(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """All rows of class 1 and as many of class 0, those with the least seeded hash of the key."""
    n = df.where(F.col(label) == 1).count()
    return df.where(F.col(label) == 1).unionByName(df.where(F.col(label) == 0).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n))


def split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Adds is_train by a seeded hash of the key."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def event_classifier(df: DataFrame, features: list[str], label: str, key: str, keep: int = 5, seed: int = 0) -> DataFrame:
    """(key, label, predicted, probability) of the held-out half: scaling and logistic regression, after dropping features one
    by one, the smallest weight first, until ``keep`` are left.  Fitted on the training half only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = split(df.where(F.col(label).isNotNull()).dropna(subset=features), key, 0.5, seed).withColumn("_label", F.col(label).cast("double"))
    train, test = rows.where("is_train"), rows.where("not is_train")
    use = list(features)
    while True:
        model = Pipeline(stages=[VectorAssembler(inputCols=use, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="_label", maxIter=50)]).fit(train)
        if len(use) <= keep:
            break
        weight = model.stages[-1].coefficients.toArray()
        use.pop(int(abs(weight).argmin()))
    out = model.transform(test)
    return out.select(key, label, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("probability"))


def repeated_classifier(df: DataFrame, features: list[str], label: str, key: str, repeats: int = 100, keep: int = 5, rounds: int = 30, ridge: float = 1.0, most: int | None = None, local: int = 50_000, seed: int = 0) -> DataFrame:
    """(repeat, precision, recall, f1) of class 1, one row a repeat; ``mean_metrics`` averages them.

    A repeat draws as many rows of class 0 as there are of class 1, halves them by a seeded hash, scales by the training
    half, drops the feature with the smallest weight until ``keep`` are left, and fits a logistic regression (Newton steps
    with a ridge) on what is left.  Rows with a null or no number in a feature or the label take no part.  Up to ``local``
    labelled rows (counted) go to every task and repeats are spread over the cluster; more stay where they are, and every
    Newton step of all repeats is one pass over them, with the same draws.  More than ``most`` raise, where that is given.
    """
    import numpy as np
    import pandas as pd

    rows = df.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_y"), *(F.col(c).cast("double").alias(c) for c in features)).dropna()
    for c in features:
        rows = rows.where(~F.isnan(c))
    rows = rows.distinct()
    if most is not None and not at_most(rows, most):
        raise ValueError(f"more than {most} labelled rows; give a sample of them")
    if not at_most(rows, local):
        return _classifier_by_passes(rows, features, key, repeats, keep, rounds, ridge, seed)
    given = rows.orderBy(key, *features).toPandas()  # at most ``local`` rows
    x, y = given[features].to_numpy(dtype=float), given["_y"].to_numpy()

    def logistic(a: np.ndarray, t: np.ndarray) -> np.ndarray:
        a = np.c_[a, np.ones(len(a))]
        w = np.zeros(a.shape[1])
        penalty = np.diag([ridge] * (a.shape[1] - 1) + [1e-9])
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + penalty, a.T @ (t - q) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-10:
                break
        return w

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf["id"]:
                rng = np.random.default_rng(seed * 1_000_003 + int(r))
                one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
                some = np.r_[one, rng.permutation(zero)[: len(one)]]
                some = rng.permutation(some)
                train, test = some[: len(some) // 2], some[len(some) // 2 :]
                use = list(range(len(features)))
                if len(train) and len(test):
                    mean, sd = x[train].mean(0), x[train].std(0)
                    z = (x - mean) / np.where(sd > 0, sd, 1)
                    while len(use) > keep:
                        use.pop(int(np.abs(logistic(z[train][:, use], y[train])[:-1]).argmin()))
                    w = logistic(z[train][:, use], y[train])
                    said = np.c_[z[test][:, use], np.ones(len(test))] @ w > 0
                    tp, fp, fn = (int((said & (y[test] == 1)).sum()), int((said & (y[test] == 0)).sum()), int((~said & (y[test] == 1)).sum()))
                    out.append((int(r), tp / (tp + fp) if tp + fp else None, tp / (tp + fn) if tp + fn else None, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else None))
                else:
                    out.append((int(r), None, None, None))
            yield pd.DataFrame(out, columns=["repeat", "precision", "recall", "f1"]).astype({"precision": "float64", "recall": "float64", "f1": "float64"})

    schema = "repeat bigint, precision double, recall double, f1 double"
    return df.sparkSession.range(repeats).repartition(min(repeats, 100)).mapInPandas(run, schema).replace(float("nan"), None)


def _classifier_by_passes(rows: DataFrame, features: list[str], key: str, repeats: int, keep: int, rounds: int, ridge: float, seed: int) -> DataFrame:
    """``repeated_classifier`` over rows (key, _y, features) that no task holds as a whole.  Rows are numbered by key in their
    class, a task draws for its own rows from the numbers alone (memory: a number a row), and what a pass brings to the
    driver is a few sums a repeat."""
    import numpy as np
    import pandas as pd

    from geoloom.operators.ranking import positions

    spark, f = rows.sparkSession, len(features)
    numbered, at = cut(positions(rows, [F.col(key).asc(), *(F.col(c).asc() for c in features)], by="_y", name="_no"), "labelled")
    size = {r["_y"]: r["n"] for r in numbered.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows
    ones, zeros = size.get(1, 0), size.get(0, 0)
    total = ones + min(ones, zeros)
    schema = "repeat bigint, precision double, recall double, f1 double"
    if total // 2 == 0:
        return spark.createDataFrame([(r, None, None, None) for r in range(repeats)], schema)

    def draw(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        one, no = pdf["_y"].to_numpy() == 1, pdf["_no"].to_numpy(dtype=np.int64) - 1
        part = np.zeros((len(pdf), repeats), np.uint8)  # 1: training half, 2: the other half
        for r in range(repeats):
            rng = np.random.default_rng(seed * 1_000_003 + r)
            place = np.full(zeros, -1)
            place[rng.permutation(zeros)[:ones]] = np.arange(ones, total)
            order = np.empty(total, np.int64)
            order[rng.permutation(total)] = np.arange(total)
            where = np.where(one, no, -1)
            where[~one] = place[no[~one]]
            part[where >= 0, r] = np.where(order[where[where >= 0]] < total // 2, 1, 2)
        yield pdf[["_y", *features]].assign(part=[p.tobytes() for p in part])

    drawn, drawn_at = cut(numbered.mapInPandas(draw, "_y int, " + ", ".join(f"`{c}` double" for c in features) + ", part binary"), "drawn")
    release(spark, at)

    def sums(half: int, width: int, each) -> np.ndarray:
        """One pass: what ``each`` (repeat, rows' features, labels) adds up to over the rows of a half, a row a repeat."""

        def add(batches):
            out = np.zeros((repeats, width))
            for pdf in batches:
                x, y = pdf[features].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float)
                part = np.frombuffer(b"".join(pdf["part"]), np.uint8).reshape(len(pdf), repeats)
                for r in range(repeats):
                    i = part[:, r] == half
                    out[r] += each(r, x[i], y[i])
            yield pd.DataFrame({"r": range(repeats), "s": list(out)})

        got = drawn.mapInPandas(add, "r int, s array<double>").groupBy("r").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s"))
        return np.array([r.s for r in got.orderBy("r").collect()])  # ``repeats`` rows

    mean = sums(1, f, lambda r, x, y: x.sum(0)) / (total // 2)
    sd = np.sqrt(sums(1, f, lambda r, x, y: ((x - mean[r]) ** 2).sum(0)) / (total // 2))
    sd = np.where(sd > 0, sd, 1)
    use = [list(range(f)) for _ in range(repeats)]

    def scaled(r: int, x: np.ndarray, use) -> np.ndarray:
        return np.c_[((x - mean[r]) / sd[r])[:, use[r]], np.ones(len(x))]

    while True:
        n = len(use[0]) + 1
        w, open_ = np.zeros((repeats, n)), np.ones(repeats, bool)
        penalty = np.diag([ridge] * (n - 1) + [1e-9])
        for _ in range(rounds):

            def newton(r: int, x: np.ndarray, y: np.ndarray, w=w.copy(), open_=open_.copy(), use=use) -> np.ndarray:
                if not open_[r]:
                    return np.zeros(n * n + n)
                a = scaled(r, x, use)
                q = 1 / (1 + np.exp(-np.clip(a @ w[r], -30, 30)))
                return np.r_[((a * (q * (1 - q))[:, None]).T @ a).ravel(), a.T @ (y - q)]

            got = sums(1, n * n + n, newton)
            for r in np.flatnonzero(open_):
                step = np.linalg.solve(got[r, : n * n].reshape(n, n) + penalty, got[r, n * n :] - penalty @ w[r])
                w[r] += step
                open_[r] = np.abs(step).max() >= 1e-10
            if not open_.any():
                break
        if len(use[0]) <= keep:
            break
        use = [[c for i, c in enumerate(u) if i != int(np.abs(w[r][:-1]).argmin())] for r, u in enumerate(use)]

    def counts(r: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        said = scaled(r, x, use) @ w[r] > 0
        return np.array([(said & (y == 1)).sum(), (said & (y == 0)).sum(), (~said & (y == 1)).sum()])

    out = []
    for r, (tp, fp, fn) in enumerate(sums(2, 3, counts)):
        out.append((r, *(float(tp / d) if d else None for d in (tp + fp, tp + fn)), float(2 * tp / (2 * tp + fp + fn)) if tp + fp + fn else None))
    release(spark, drawn_at)
    return spark.createDataFrame(out, schema)


def mean_metrics(repeats: DataFrame, method: str) -> DataFrame:
    """(method, precision, recall, f1): the means over all repeats that have a value."""
    return repeats.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))).select(F.lit(method).alias("method"), "precision", "recall", "f1")


def forest_importance(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 0) -> DataFrame:
    """(feature, importance, rank) of a random forest classifier on the complete labelled rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = df.where(F.col(label).isNotNull()).dropna(subset=features).withColumn("_label", F.col(label).cast("double"))
    v = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, featuresCol="_v", labelCol="_label", seed=seed).fit(v)
    named = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda f: (-f[1], f[0]))
    return df.sparkSession.createDataFrame([(f, i, r + 1) for r, (f, i) in enumerate(named)], "feature string, importance double, rank bigint")


def agreement_counts(answers: DataFrame, section: str, truth: str, said: str, semantic: int = 5) -> DataFrame:
    """(section, asked, answered, right) and below them the totals 'semantic' (the first sections), 'syntactic' and 'all';
    an unanswered question has a null in ``said``."""
    ok = [F.count("*").alias("asked"), F.count(said).alias("answered"), F.coalesce(F.sum((F.col(said) == F.col(truth)).cast("bigint")), F.lit(0).cast("bigint")).alias("right")]
    rows = answers.select(F.col(section).alias("section"), said, truth)
    out = rows.groupBy(F.col("section").cast("string").alias("section")).agg(*ok)
    part = F.when(F.col("section") <= semantic, "semantic").otherwise("syntactic")
    return out.unionByName(rows.groupBy(part.alias("section")).agg(*ok)).unionByName(rows.agg(*ok).select(F.lit("all").alias("section"), "asked", "answered", "right"))
