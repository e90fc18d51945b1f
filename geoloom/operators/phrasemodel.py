"""From ranked phrases to a segmentation model and back to text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.phrases import prune_by_window
from geoloom.operators.ranking import positions
from geoloom.storage import at_most


def at_least(scored: DataFrame, threshold: float) -> DataFrame:
    """Phrases with a score of at least the threshold."""
    return scored.where(F.col("score") >= threshold)


def rank_list(scored: DataFrame, threshold: float) -> DataFrame:
    """Phrases above a threshold; one outside (0, 1] counts as 0.5."""
    return scored.where(F.col("score") > (threshold if 0 < threshold <= 1 else 0.5))


def prune_and_combine(ranked: DataFrame, half: int, threshold: float, most: int) -> tuple[DataFrame, DataFrame]:
    """((phrase, score, pos), (n, kept)): each length from 2 to 6 cut where its mean quality falls (``prune_by_window``), then
    one list by score and phrase falling; and how many of each length were kept."""
    kept = prune_by_window(ranked.where(F.col("n").between(2, 6)), half, threshold, most).select("phrase", "n", "score")
    return positions(kept.select("phrase", "score"), [F.desc("score"), F.desc("phrase")]), kept.groupBy("n").agg(F.count("*").alias("kept"))


def without(features: DataFrame, *forbidden: str) -> DataFrame:
    """The feature table without columns that must not be learnt from; unknown names are ignored."""
    return features.drop(*forbidden)


def replace_scores(ranked: DataFrame, poor: DataFrame) -> DataFrame:
    """Ranked phrases with the score 0 for those listed in ``poor`` (phrase): concepts that a lexicon knows as no nouns."""
    hit = poor.select("phrase", F.lit(True).alias("_poor")).distinct()
    return ranked.join(hit, "phrase", "left").withColumn("score", F.when(F.col("_poor"), F.lit(0.0)).otherwise(F.col("score"))).drop("_poor")


def keywords(tagged: DataFrame, tags: list[str], entities: DataFrame) -> DataFrame:
    """(tid, words): for every post its tokens with one of the tags in order, then its entities (tid, pos, entity), each once.

    ``tagged`` (tid, pos, token, tag).  A post with neither has no row.
    """
    t = tagged.where(F.col("tag").isin(tags)).select("tid", F.lit(0).alias("_k"), "pos", F.col("token").alias("word"))
    t = t.unionByName(entities.select("tid", F.lit(1).alias("_k"), "pos", F.col("entity").alias("word")))
    return t.groupBy("tid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_k", "pos", "word"))), lambda s: s["word"])).alias("words"))


def segmentation_model(counts: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(phrase, n, prob): the share of every phrase among those of its length; with ``scored`` (phrase, score) phrases of two
    words or more must have a score, by which the share is multiplied."""
    total = counts.groupBy("n").agg(F.sum("cnt").alias("_s"))
    p = counts.join(F.broadcast(total), "n").select("phrase", "n", (F.col("cnt") / F.col("_s")).alias("prob"))  # one row a length
    if scored is None:
        return p
    p = p.join(scored.select("phrase", "score"), "phrase", "left").where((F.col("n") == 1) | F.col("score").isNotNull())
    return p.select("phrase", "n", F.when(F.col("n") == 1, F.col("prob")).otherwise(F.col("prob") * F.col("score")).alias("prob"))


def best_splits(phrases: DataFrame, model: DataFrame, penalty: float, every: bool) -> DataFrame:
    """(phrase, n, own, best): the phrase's own probability (null if unknown) and the greatest product over its proper splits
    into known phrases, 0 if there is none.

    ``every``: each part is multiplied by ``penalty``; else a part of n words is divided by penalty ** (n - 1), and so is own.
    The parts of all phrases meet the model in one equi-join; the choice is a fold over a phrase's few parts.
    """
    w = F.split("phrase", " ")
    p = phrases.select("phrase").distinct().withColumn("n", F.size(w))
    ends = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.transform(F.sequence(i + 1, F.col("n")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    part = p.select("phrase", "n", F.explode(ends).alias("e")).select("phrase", "n", "e.i", "e.j", F.array_join(F.slice(w, F.col("e.i") + 1, F.col("e.j") - F.col("e.i")), " ").alias("part"))
    part = part.join(model.select(F.col("phrase").alias("part"), F.col("prob").cast("double").alias("prob")), "part")
    worth = F.col("prob") * F.lit(penalty) if every else F.col("prob") / F.pow(F.lit(penalty), F.col("j") - F.col("i") - 1)
    whole = (F.col("j") - F.col("i")) == F.col("n")
    g = part.groupBy("phrase", "n").agg(
        F.max(F.when(whole, F.col("prob") if every else worth)).alias("own"), F.collect_list(F.when(~whole, F.struct("i", "j", worth.alias("v")))).alias("_parts")
    )

    def step(f: Column, j: Column) -> Column:
        there = F.transform(F.filter("_parts", lambda s: s["j"] == j), lambda s: F.get(f, s["i"]) * s["v"])
        return F.concat(f, F.array(F.coalesce(F.array_max(there), F.lit(0.0))))

    best = F.element_at(F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.lit(1.0)), step), -1)
    g = g.select("phrase", "own", F.when(F.size("_parts") > 0, best).otherwise(0.0).alias("best"))
    return p.join(g, "phrase", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def recomputed_features(phrases: DataFrame, model: DataFrame, penalty: float) -> DataFrame:
    """(phrase, f1, f4): the phrase's probability over the best product of its parts, and its probability times the log of
    that; 0 for a phrase that the model does not know, 1e10 where no split is worth more than 1e-9."""
    b = best_splits(phrases, model, penalty, every=True)
    f1 = F.col("own") / F.when(F.col("best") > 1e-9, F.col("best"))
    known = F.col("own").isNotNull()
    return b.select("phrase", F.when(known, F.coalesce(f1, F.lit(1e10))).otherwise(0.0).alias("f1"), F.when(known, F.coalesce(F.col("own") * F.log(f1), F.lit(1e10))).otherwise(0.0).alias("f4"))


def broken_labels(good: DataFrame, model: DataFrame, penalty: float) -> DataFrame:
    """(phrase): good phrases that the model does not know or would rather take apart."""
    b = best_splits(good, model, penalty, every=False)
    return b.where(F.col("own").isNull() | (F.col("best") > F.col("own"))).select("phrase")


def with_scores(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Features of the phrases that have a score (phrase, score)."""
    return features.join(scores.select("phrase", "score"), "phrase")


def split_with_marks(text: str | Column) -> Column:
    """array<struct<sentence, mark>>: the pieces between sentence marks with the run of marks behind each; concatenated they are
    the text again.  Marks before the first piece come with an empty sentence.  Null for null."""
    pieces = F.regexp_extract_all(text, F.lit("[^.!?,;:\\[\\]]+[.!?,;:\\[\\]]*|^[.!?,;:\\[\\]]+"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, "^([^.!?,;:\\[\\]]*)", 1).alias("sentence"), F.regexp_extract(p, "([.!?,;:\\[\\]]*)$", 1).alias("mark")))


def rendered(text: str | Column, segments: str | Column, style: str = "brackets") -> Column:
    """The text with its phrases marked: ``segments`` (array of lower-case words and phrases in order) are found in it again.

    'brackets' sets [ ] around segments of two words or more and leaves all else as it stands; 'underscores' joins their
    words by '_'; 'clean' gives the segments alone, bracketed, parted by blanks.  Characters other than letters, digits and
    apostrophes between the words of a segment are kept in 'brackets'.  A segment that isn't found is skipped.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, parts: pd.Series) -> pd.Series:
        def one(t, seg):
            if t is None or seg is None:
                return None
            if style == "clean":
                return " ".join(f"[{s}]" if " " in s else s for s in seg)
            out, at, low = [], 0, "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
            for s in seg:
                words, start, end = s.split(" "), None, at
                for w in words:
                    i = low.find(w, end)
                    if i < 0:
                        start = None
                        break
                    start, end = i if start is None else start, i + len(w)
                if start is None:
                    continue
                body = t[start:end]
                if len(words) > 1:
                    body = f"[{body}]" if style == "brackets" else "_".join(body.split())
                out += [t[at:start], body]
                at = end
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, parts)], dtype=object)

    return run(text, segments)


def projected_neighbours(queries: DataFrame, pool: DataFrame, key: str, vec: str, dim: int, k: int = 3, axes: int = 30, shortlist: int = 100, most: int = 200_000, seed: int = 0) -> DataFrame:
    """(word, near, sim, rank): for every query (key, vec) the k nearest of the pool by inner product of unit vectors, itself
    left out, sim divided by the best one's.

    Vectors are projected on ``axes`` random directions, the ``shortlist`` nearest by the projection are ranked by the exact
    product.  The pool, a vocabulary of at most ``most`` (checked), goes to every task; queries stay where they are.  Null,
    incomplete and zero vectors take no part; ties by the smaller key.
    """
    ok = F.coalesce((F.size(vec) == dim) & (F.size(F.array_compact(vec)) == dim) & ((F.array_max(vec) > 0) | (F.array_min(vec) < 0)), F.lit(False))
    v = F.col(vec).cast("array<double>").alias("vec")
    p, q = pool.where(ok).select(F.col(key).cast("string").alias("word"), v).distinct(), queries.where(ok).select(F.col(key).cast("string").alias("word"), v).distinct()
    if not at_most(p, most):
        raise ValueError(f"more than {most} vectors in the pool; raise the support threshold")
    held = p.orderBy("word").toArrow()
    names = np.array(held["word"].to_pylist(), dtype=object)

    def matrix(column) -> np.ndarray:
        x = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=float).reshape(-1, dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x = matrix(held["vec"]) if len(names) else np.zeros((0, dim))
    turn = np.random.default_rng(seed).standard_normal((dim, axes))
    short = x @ turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            if batch.num_rows and len(names):
                y, words = matrix(batch["vec"]), batch["word"].to_pylist()
                for i in range(0, len(y), 256):
                    z = y[i : i + 256] @ turn
                    off = (z * z).sum(1)[:, None] - 2 * z @ short.T + (short * short).sum(1)
                    few = min(shortlist + 1, len(names))
                    cand = np.sort(np.argpartition(off, few - 1, axis=1)[:, :few], axis=1)
                    for j, c in enumerate(cand):
                        word = words[i + j]
                        c = c[names[c] != word]
                        s = np.round(x[c] @ y[i + j], 9)
                        best = np.lexsort((c, -s))[:k]
                        top = s[best[0]] if len(best) else 1.0
                        for r, b in enumerate(best):
                            for out, value in zip(rows, (word, names[c[b]], float(s[b] / top) if top else 0.0, r + 1)):
                                out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64())], ["word", "near", "sim", "rank"])

    return q.mapInArrow(run, "word string, near string, sim double, rank bigint")
