"""Cross-modal model: hotspots of places and times, the graph between them and words, its embedding, and predictions.

``fit_model`` chains the steps: mean shift gives the hotspots, every post goes to its nearest place and time, the
co-occurrence graph links them with words and categories of a vocabulary, neighbouring hotspots are linked by a kernel, and
edge sampling gives every node a vector.  A post's feature of a modality is a vector; a prediction scores how well the
features of several modalities agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.scalar import cosine, kernel, seconds_of_day
from geoloom.operators import clustering, embedding
from geoloom.operators.evaluate import mid_rank, rank_metrics
from geoloom.operators.graph import cooccurrence_edges, proximity_edges
from geoloom.storage import at_most

MODALITIES = {"l": "place", "t": "time", "w": "words", "c": "category"}


def post_nodes(posts: DataFrame, places: DataFrame, times: DataFrame, vocabulary: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(tid, l, t, c, words) from posts (tid, lat, lng, ts, words array, category): ids of the nearest place and time of day,
    words of the vocabulary only, categories of the list only.

    A vocabulary word that a third of all posts use would be one task of a join on words: the known words of every post are
    looked up as counts of small keys, the vocabulary being broadcast while ``at_most`` says so, else joined by word.
    """
    p = posts.withColumn("_s", seconds_of_day(F.col("ts")).cast("double"))
    p = clustering.nearest_centre(p, places, ["lat", "lng"]).withColumnRenamed("id", "l")
    p = clustering.nearest_centre(p, times.withColumnRenamed(times.columns[1], "_s") if times.columns[1] != "_s" else times, ["_s"]).withColumnRenamed("id", "t")
    known = vocabulary.select("word").distinct()
    w = p.select("tid", F.posexplode("words").alias("_i", "word")).join(F.broadcast(known) if at_most(known, 500_000) else known, "word")
    w = w.groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda s: s["word"]).alias("words"))
    c = F.when(F.col("category").isin(categories), F.col("category")) if categories else F.col("category")
    return p.select("tid", "l", "t", c.alias("c")).join(w, "tid", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def proximity_kinds(places: DataFrame, times: DataFrame, k: int, place_h: float, time_h: float) -> DataFrame:
    """(etype, u, v, weight) between neighbouring places (ll) and neighbouring times of day (tt)."""
    out = None
    for kind, centres, value, h in (("ll", places, ["lat", "lng"], place_h), ("tt", times, [times.columns[1]], time_h)):
        e = proximity_edges(centres, value, k, h).select(F.lit(kind).alias("etype"), F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "weight")
        out = e if out is None else out.unionByName(e)
    return out


def fit_model(posts: DataFrame, vocabulary: DataFrame, *, place_h: float = 0.01, time_h: float = 1000.0, k: int = 4, dim: int = 20, rounds: int = 2, categories: list[str] | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """{'places', 'times', 'nodes', 'vectors'} from posts (tid, lat, lng, ts, words array, category), located and timed."""
    places = clustering.mean_shift(posts.select("lat", "lng"), ["lat", "lng"], place_h)
    times = clustering.mean_shift(posts.select(seconds_of_day(F.col("ts")).cast("double").alias("s")), ["s"], time_h)
    nodes = post_nodes(posts, places, times, vocabulary, categories)
    edges = cooccurrence_edges(nodes).withColumn("weight", F.col("weight").cast("double"))
    edges = edges.unionByName(proximity_kinds(places, times, k, place_h, time_h))
    return {"places": places, "times": times, "nodes": nodes, "vectors": embedding.fit(edges, dim=dim, rounds=rounds, seed=seed)}


def side(kind: str, predicted: str, second_order: bool = True, use_context: bool = True) -> str:
    """Which vector stands for a node: 'ctx' only for modalities that are given, with context vectors of second order."""
    return "ctx" if use_context and second_order and kind != predicted else "vec"


def kernel_neighbours(rows: DataFrame, key: str, value: list[str], centres: DataFrame, h: float, k: int) -> DataFrame:
    """(key, id, rank, weight): a row's k nearest centres within ``h`` by planar distance, ties by id, with their kernel weight.

    Centres are found by cells of ``h``; they go to the tasks while they are few (counted), else both sides are shuffled by
    cell with the rows salted, so a cell of very many rows is several tasks.
    """
    near = centres.select("id", *(F.col(c).alias(f"_{c}") for c in value))
    own, around = rows.select(key, *value), near
    for i, c in enumerate(value):
        own = own.withColumn(f"_k{i}", F.floor(F.col(c) / h))
        around = around.withColumn(f"_k{i}", F.explode(F.sequence(F.floor(F.col(f"_{c}") / h) - 1, F.floor(F.col(f"_{c}") / h) + 1)))
    keys = [f"_k{i}" for i in range(len(value))]
    if at_most(near, 20_000):
        around = F.broadcast(around)
    else:
        own = own.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(16)))
        around = around.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
        keys.append("_salt")
    off = F.sqrt(sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in value))
    hits = own.join(around, keys).withColumn("_d", off).where(F.col("_d") <= h)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_d", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "id", "rank", kernel(F.col("_d"), h).alias("weight"))


def centre_features(rows: DataFrame, key: str, value: list[str], centres: DataFrame, vectors: DataFrame, kind: str, dim: int, h: float, k: int = 4, vector: str = "vec") -> DataFrame:
    """(key, feature): the kernel-weighted mean over a row's k nearest centres within ``h``, the nearest centre's own vector
    where none is so near; no row without a centre."""
    nearest = clustering.nearest_centre(rows.select(key, *value), centres, value).select(key, F.col("id").alias("_own"))
    hits = kernel_neighbours(rows, key, value, centres, h, k)
    far = nearest.join(hits.select(key).distinct(), key, "left_anti").select(key, F.col("_own").alias("id"), F.lit(1).alias("rank"), F.lit(0.0).alias("weight"))
    named = hits.unionByName(far).withColumn("node", F.concat(F.lit(kind + ":"), F.col("id").cast("string"))).join(vectors.select("node", F.col(vector).alias("vec")), "node")
    return embedding.kernel_smoothed(named, key, dim).withColumnRenamed("vec", "feature")


def word_features(rows: DataFrame, key: str, words: str, vectors: DataFrame, dim: int, vector: str = "vec") -> DataFrame:
    """(key, feature): the mean vector of a row's known word occurrences; zeros if none is known."""
    w = rows.select(key, F.explode(words).alias("_w")).withColumn("node", F.concat(F.lit("w:"), "_w")).join(vectors.select("node", vector), "node")
    mean = w.groupBy(key).agg(F.array(*(F.avg(F.col(vector)[i]) for i in range(dim))).alias("feature"))
    return rows.select(key).distinct().join(mean, key, "left").withColumn("feature", F.coalesce("feature", F.array_repeat(F.lit(0.0), dim)))


def category_features(rows: DataFrame, key: str, category: str, vectors: DataFrame, vector: str = "vec") -> DataFrame:
    """(key, feature): the category's vector; null if unknown."""
    v = vectors.select("node", F.col(vector).cast("array<double>").alias("feature"))
    return rows.select(key, F.concat(F.lit("c:"), category).alias("node")).join(v, "node", "left").select(key, "feature")


def agreement(features: list[str | Column]) -> Column:
    """The sum of the cosines of every two features, six digits; a null or zero feature counts 0."""
    return F.round(sum(F.coalesce(cosine(a, b, 0.0), F.lit(0.0)) for i, a in enumerate(features) for b in features[i + 1 :]), 6)


def noise_pairs(cases: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(key, other): for every case ``n`` cases drawn by a seeded hash, itself left out, with replacement.

    Cases are numbered once (``positions``) and the drawn numbers joined back, so nothing is crossed.
    """
    from geoloom.operators.ranking import positions

    ids = positions(cases.select(key).distinct(), [F.xxhash64(key, F.lit(seed)), F.col(key)], name="_no")
    total = ids.agg(F.count("*").alias("_all"))
    draw = ids.crossJoin(F.broadcast(total)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n))))  # one row
    shift = F.pmod(F.xxhash64(key, "_k", F.lit(seed)), F.greatest(F.col("_all") - 1, F.lit(1))) + 1
    draw = draw.where("_all > 1").select(key, (F.pmod(F.col("_no") - 1 + shift, F.col("_all")) + 1).alias("_no"))
    return draw.join(ids.select("_no", F.col(key).alias("other")), "_no").select(key, "other")


def evaluate_predictions(features: DataFrame, key: str, predicted: str, given: list[str], noise: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((key, rank), (mrr, mean_rank)): for every case the true feature in column ``predicted`` against those of ``noise``
    other cases, scored by their agreement with the features ``given``; ties take the middle rank."""
    own = features.select(key, *given, F.col(predicted).alias("_x")).where(F.col("_x").isNotNull())
    other = noise_pairs(own, key, noise, seed).join(own.select(F.col(key).alias("other"), F.col("_x").alias("_y")), "other").join(own.select(key, *given), key)
    truth = own.select(key, agreement([*given, "_x"]).alias("score"), F.lit(True).alias("truth"))
    false = other.select(key, agreement([*given, "_y"]).alias("score"), F.lit(False).alias("truth"))
    ranks = mid_rank(truth.unionByName(false), key, "score", "truth")
    return ranks, rank_metrics(ranks)


def neighbours_of(vectors: DataFrame, queries: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """(query, node, sim, rank): the k nodes of one kind most similar to every query's vector; a query is a node or the sum of
    two (``queries``: query, nodes array), themselves left out.

    The queries are a few (a case study); their vectors go to the tasks as rows of a broadcast, at most 1,000 (checked).
    """
    from geoloom.functions.scalar import unit
    if not at_most(queries, 1000):
        raise ValueError("more than 1,000 queries")
    q = queries.select("query", "nodes", F.explode("nodes").alias("node")).join(vectors.select("node", unit("vec").alias("u")), "node")
    dim = F.posexplode("u").alias("i", "x")
    q = q.select("query", "nodes", dim).groupBy("query", "nodes", "i").agg(F.sum("x").alias("x"))
    q = q.groupBy("query", "nodes").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
    pool = vectors.where(F.col("node").startswith(kind + ":")).select("node", "vec")
    sims = pool.join(F.broadcast(q), ~F.array_contains("nodes", F.col("node"))).select("query", "node", F.round(cosine("vec", "q", 0.0), 9).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
    return sims.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
