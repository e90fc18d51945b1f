"""Word vectors: training, similarity and analogy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.scalar import cosine, unit


def skip_gram(records: DataFrame, tokens: str, dim: int = 50, window: int = 5, min_count: int = 5, seed: int = 0, rounds: int = 1) -> DataFrame:
    """(word, vec): skip-gram with hierarchical softmax."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, inputCol=tokens, outputCol="_v", seed=seed, maxIter=rounds).fit(records.where(F.size(tokens) > 0))
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def _cbow(dim: int, window: int, negative: int, alpha: float, seed: int):
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(pdf["part"].iloc[0]))
        start = pdf[pdf["words"].isna()].sort_values("word")
        names, noise = start["word"].to_numpy(), start["cnt"].to_numpy(dtype=float) ** 0.75
        index = {w: i for i, w in enumerate(names)}
        vec = np.array(start["vec"].tolist(), dtype=np.float32).reshape(-1, dim)
        out = np.array(start["ctx"].tolist(), dtype=np.float32).reshape(-1, dim)
        touched = np.zeros(len(names))
        target, around = [], []
        for words in sorted(map(list, pdf["words"].dropna())):
            ids = [index[w] for w in words if w in index]
            for i, w in enumerate(ids):
                near = [c for c in ids[max(0, i - window) : i] + ids[i + 1 : i + 1 + window]]
                if near:
                    target.append(w)
                    around.append(near + [-1] * (2 * window - len(near)))
        if target:
            t, a = np.array(target), np.array(around)
            draw = np.cumsum(noise / noise.sum())
            order = rng.permutation(len(t))
            for at in range(0, len(t), 128):
                rows = order[at : at + 128]
                rate = alpha * max(1e-4, 1 - at / len(t))
                c, held = a[rows], a[rows] >= 0
                mean = (vec[np.maximum(c, 0)] * held[:, :, None]).sum(1) / held.sum(1)[:, None]
                err = np.zeros_like(mean)
                for k in range(negative + 1):
                    b = t[rows] if k == 0 else np.minimum(np.searchsorted(draw, rng.random(len(rows))), len(names) - 1)
                    g = ((k == 0) - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", mean, out[b]), -6, 6)))) * rate
                    if k:
                        g = np.where(b == t[rows], 0, g)
                    err += g[:, None] * out[b]
                    np.add.at(out, b, (g[:, None] * mean).astype(np.float32))
                    np.add.at(touched, b, 1)
                flat = c[held]
                np.add.at(vec, flat, np.repeat(err, held.sum(1), axis=0).astype(np.float32))
                np.add.at(touched, flat, 1)
        return pd.DataFrame({"word": names, "vec": list(vec), "ctx": list(out), "touched": touched + 1e-9})

    return run


def cbow(records: DataFrame, tokens: str, dim: int = 50, window: int = 5, min_count: int = 5, negative: int = 5, rounds: int = 3, alpha: float = 0.05, part_records: int = 20_000, seed: int = 0) -> DataFrame:
    """(word, vec): continuous bag of words with negative sampling, words of at least ``min_count`` occurrences.

    Records go to tasks by a hash, about ``part_records`` each; every round all tasks train on their own records from the same
    vectors, which are then averaged by how often a task touched a word.  A task holds the vectors of its own words only.
    """
    from geoloom.storage import cut, release

    spark = records.sparkSession
    r = records.where(F.size(tokens) > 1).select(F.col(tokens).alias("words"))
    parts = max(1, -(-r.count() // part_records))
    r, at = cut(r.withColumn("part", F.pmod(F.xxhash64("words", F.lit(seed)), F.lit(parts))), "records")
    counts = records.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)
    first = F.array(*((F.pmod(F.xxhash64("word", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5) / dim for i in range(dim)))
    vecs, last = cut(counts.select("word", "cnt", first.cast("array<float>").alias("vec"), F.array_repeat(F.lit(0.0), dim).cast("array<float>").alias("ctx")), "vectors")
    ends, ends_at = cut(r.select("part", F.explode("words").alias("word")).distinct(), "ends")
    none, empty = F.lit(None), F.lit(None).cast("array<float>")
    for k in range(rounds):
        own = ends.join(vecs, "word").select("part", none.cast("array<string>").alias("words"), "word", "cnt", "vec", "ctx")
        rows = own.unionByName(r.select("part", "words", none.cast("string").alias("word"), none.cast("bigint").alias("cnt"), empty.alias("vec"), empty.alias("ctx")))
        out = rows.groupBy("part").applyInPandas(_cbow(dim, window, negative, alpha * (1 - k / rounds), seed + 1000 * k), "word string, vec array<float>, ctx array<float>, touched double")
        mean = [F.sum(F.col("touched") * F.col(c)[i]) / F.sum("touched") for c in ("vec", "ctx") for i in range(dim)]
        new = out.groupBy("word").agg(F.array(*mean[:dim]).cast("array<float>").alias("vec"), F.array(*mean[dim:]).cast("array<float>").alias("ctx"))
        new, new_at = cut(counts.join(new, "word", "left").join(vecs.select("word", F.col("vec").alias("_v"), F.col("ctx").alias("_c")), "word").select("word", "cnt", F.coalesce("vec", "_v").alias("vec"), F.coalesce("ctx", "_c").alias("ctx")), "vectors")
        release(spark, last)
        vecs, last = new, new_at
    release(spark, at, ends_at)
    return vecs.select("word", "vec")


def subsample(tok: DataFrame, counts: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Token rows (tid, pos, word) kept with probability (sqrt(c / (s N)) + 1) s N / c, drawn by a seeded hash."""
    total = counts.agg(F.sum("cnt").alias("_N"))
    x = F.col("cnt") / (F.lit(share) * F.col("_N"))
    keep = counts.crossJoin(F.broadcast(total)).select("word", ((F.sqrt(x) + 1) / x).alias("_p"))
    u = F.pmod(F.xxhash64("tid", "pos", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return tok.join(keep, "word").where(u < F.col("_p")).drop("_p")


def similar(vectors: DataFrame, words: list, k: int = 40) -> DataFrame:
    """(word, sim): the k words nearest to the normalised sum of the query words' vectors, themselves left out."""
    q = vectors.where(F.col("word").isin(words)).select(F.posexplode(unit("vec")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    q = q.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))  # one vector
    s = vectors.where(~F.col("word").isin(words)).crossJoin(F.broadcast(q)).withColumn("sim", cosine("vec", "q", 0.0))
    return s.orderBy(F.desc("sim"), "word").limit(k).select("word", "sim")


def analogy_answers(vectors: DataFrame, questions: DataFrame, most: int = 200_000) -> DataFrame:
    """Questions (section, a, b, c, d) with said, the word nearest to vec(b) - vec(a) + vec(c) by unit vectors, the three left
    out, ties by the smaller word; null where a word of the question, the answer included, has no vector.

    The vocabulary, at most ``most`` words (checked), goes to every task; questions are answered where they lie.
    """
    import numpy as np
    import pandas as pd

    from geoloom.storage import at_most

    if not at_most(vectors, most):
        raise ValueError(f"more than {most} words; keep the frequent ones")
    v = vectors.select("word", unit("vec").alias("vec")).orderBy("word").toPandas()
    names, x = v["word"].to_numpy(), np.array(v["vec"].tolist(), dtype=float)
    at = {w: i for i, w in enumerate(names)}

    def run(batches):
        for pdf in batches:
            said = []
            for a, b, c, d in zip(pdf["a"], pdf["b"], pdf["c"], pdf["d"]):
                if not all(w in at for w in (a, b, c, d)):
                    said.append(None)
                    continue
                s = np.round(x @ (x[at[b]] - x[at[a]] + x[at[c]]), 12)
                s[[at[a], at[b], at[c]]] = -np.inf
                said.append(names[int(s.argmax())])
            yield pdf.assign(said=pd.Series(said, dtype=object, index=pdf.index))

    kind = dict(vectors.dtypes)["word"]
    q = questions.select("section", "a", "b", "c", "d")
    return q.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in q.dtypes) + f", said {kind}")


def analogy(vectors: DataFrame, a, b, c, k: int = 40) -> DataFrame:
    """(word, sim): nearest to vec(b) - vec(a) + vec(c), unit vectors, the three words left out."""
    sign = F.when(F.col("word") == a, -1.0).otherwise(1.0)
    q = vectors.where(F.col("word").isin([a, b, c])).select(sign.alias("s"), F.posexplode(unit("vec")).alias("i", "x")).groupBy("i").agg(F.sum(F.col("s") * F.col("x")).alias("x"))
    q = q.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))  # one vector
    s = vectors.where(~F.col("word").isin([a, b, c])).crossJoin(F.broadcast(q)).withColumn("sim", cosine("vec", "q", 0.0))
    return s.orderBy(F.desc("sim"), "word").limit(k).select("word", "sim")
