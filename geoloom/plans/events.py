"""Queries over candidates, vectors and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import scalar as S
from geoloom.operators import candidates as C
from geoloom.operators import evaluate as E
from geoloom.sources.formats import needed_vectors
from geoloom.sources.tables import table

QUERIES, ORACLES = {}, {}
DIM = 48


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_M = "m AS (SELECT DISTINCT candidate_id, query_id, x.tweet_id AS tid, x.user_id AS uid, x.lat AS lat, x.lng AS lng, x.\"timestamp\" AS ts FROM (SELECT candidate_id, query_id, unnest(members) AS x FROM candidates))"


def _ok(*names: str) -> str:
    return " AND ".join(f"len({n}) = 48 AND len(list_filter({n}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0" for n in names)


_V = f"v AS (SELECT DISTINCT tid, spatial_embedding::DOUBLE[] AS s, temporal_embedding::DOUBLE[] AS t, textual_embedding::DOUBLE[] AS x FROM post_embedding WHERE {_ok('spatial_embedding', 'temporal_embedding', 'textual_embedding')})"
_NZ = "len(list_filter({0}, lambda y: y <> 0)) > 0"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return C.members(table(spark, sf, "candidates")).drop("message").distinct()


def _with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = C.vectors(table(spark, sf, "post_embedding"), DIM, "spatial_embedding", "temporal_embedding", "textual_embedding")
    return _members(spark, sf).join(v, "tid")


@query(f"WITH {_M} SELECT candidate_id, count(*) AS members, count(DISTINCT uid) AS users FROM m GROUP BY candidate_id")
def d14_candidate_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).groupBy("candidate_id").agg(F.count("*").alias("members"), F.countDistinct("uid").alias("users"))


@query(f"WITH {_M}, u AS (SELECT candidate_id FROM m GROUP BY candidate_id HAVING count(DISTINCT uid) >= 5 AND count(DISTINCT uid) < 50) SELECT DISTINCT candidate_id, tid FROM m WHERE candidate_id IN (SELECT candidate_id FROM u)")
def b10_candidates_by_users(spark: SparkSession, sf: str) -> DataFrame:
    return C.keep_by_users(_members(spark, sf)).select("candidate_id", "tid").distinct()


_KEPT = f"{_M}, {_V}, k AS (SELECT m.*, v.s, v.t, v.x FROM m JOIN v ON m.tid = v.tid WHERE {_NZ.format('v.x')}), kept AS (SELECT * FROM k WHERE candidate_id IN (SELECT candidate_id FROM k GROUP BY candidate_id HAVING count(*) >= 5))"


@query(f"WITH {_KEPT} SELECT candidate_id, tid FROM kept")
def b11_nonzero_members(spark: SparkSession, sf: str) -> DataFrame:
    return C.keep_nonzero(_with_vectors(spark, sf)).select("candidate_id", "tid")


@query(f"WITH {_M}, {_V} SELECT tid, round(sqrt(list_dot_product(x, x)), 5) AS l2 FROM v WHERE tid IN (SELECT tid FROM m)")
def c4_needed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of members only, with the length of the text's."""
    v = C.vectors(table(spark, sf, "post_embedding"), DIM, "spatial_embedding", "temporal_embedding", "textual_embedding")
    return needed_vectors(v, _members(spark, sf)).select("tid", F.round(S.norm2("textual_embedding"), 5).alias("l2"))


_COS = "CASE WHEN len(list_filter({0}, lambda y: y <> 0)) > 0 AND len(list_filter({1}, lambda y: y <> 0)) > 0 THEN list_cosine_similarity({0}, {1}) END"
_MEAN = """mean AS (SELECT candidate_id, list(a ORDER BY i) AS mean FROM (SELECT candidate_id, i, avg(e / n) AS a FROM (SELECT candidate_id, sqrt(list_dot_product(x, x)) AS n, unnest(x) AS e, unnest(range(1, 49)) AS i FROM kept) GROUP BY candidate_id, i) GROUP BY candidate_id)"""


@query(f"""WITH {_KEPT}, {_MEAN}, f AS (SELECT k.*, mean, list_transform(list_zip(s, t), lambda z: (z[1] + z[2]) / 2) AS h FROM kept k JOIN mean USING (candidate_id))
SELECT candidate_id, round(avg({_COS.format('s', 'x')}), 5) AS spatial_unusualness, round(avg({_COS.format('t', 'x')}), 5) AS temporal_unusualness, round(avg({_COS.format('h', 'x')}), 5) AS st_unusualness,
round(stddev_pop(lat), 5) AS lat_std, round(stddev_pop(lng), 5) AS lng_std, round(stddev_pop(ts), 2) AS time_std, round(avg(list_cosine_similarity(x, mean)), 5) AS semantic_std, count(*)::DOUBLE AS spatial_burstiness FROM f
WHERE lat IS NOT NULL AND lng IS NOT NULL AND ts IS NOT NULL GROUP BY candidate_id""")
def d15_candidate_features(spark: SparkSession, sf: str) -> DataFrame:
    f = C.features(C.keep_nonzero(_with_vectors(spark, sf)).where("lat is not null and lng is not null and ts is not null"), DIM)
    digits = {"time_std": 2, "spatial_burstiness": 0}
    return f.select("candidate_id", *(F.round(c, digits.get(c, 5)).alias(c) for c in f.columns[1:]))


@query("""SELECT query_id, candidate_id, r AS rank FROM (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY s, candidate_id) AS r
FROM (SELECT DISTINCT candidate_id, query_id FROM candidates WHERE query_id IS NOT NULL) JOIN (SELECT DISTINCT candidate_id, st_unusualness + 0.0 AS s FROM candidate_features
WHERE lat_std < 0.02 AND lng_std < 0.02 AND st_unusualness IS NOT NULL AND NOT isnan(st_unusualness)) USING (candidate_id)) WHERE r <= 10""")
def e1_candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return C.rank_within_query(table(spark, sf, "candidates"), table(spark, sf, "candidate_features"))


@query(f"""WITH {_KEPT}, {_MEAN}, q AS (SELECT DISTINCT candidate_id, query_id FROM m WHERE query_id IS NOT NULL), u AS (SELECT candidate_id, query_id, mean FROM mean JOIN q USING (candidate_id))
SELECT a.candidate_id, round(avg(list_cosine_similarity(a.mean, b.mean)), 5) AS uniqueness FROM u a JOIN u b ON a.query_id = b.query_id AND a.candidate_id <> b.candidate_id GROUP BY a.candidate_id""")
def d21_candidate_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    m = C.keep_nonzero(_with_vectors(spark, sf))
    q = m.select("candidate_id", "query_id").where("query_id is not null").distinct()
    u = C.uniqueness(C.mean_of_units(C.with_cosines(m, DIM), "candidate_id", DIM).join(q, "candidate_id"), DIM)
    return u.where("uniqueness is not null").select("candidate_id", F.round("uniqueness", 5).alias("uniqueness"))


@query(f"""WITH {_KEPT}, {_MEAN} SELECT candidate_id, tid, rank FROM (SELECT candidate_id, tid, row_number() OVER (PARTITION BY candidate_id ORDER BY round(list_cosine_similarity(x, mean), 9) DESC, tid) AS rank FROM kept JOIN mean USING (candidate_id)) WHERE rank <= 3""")
def e4_representative_posts(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_members(C.keep_nonzero(_with_vectors(spark, sf)), DIM, 3)


@query("SELECT count(*) AS unlabelled FROM (SELECT DISTINCT candidate_id FROM candidates) WHERE candidate_id NOT IN (SELECT candidate_id FROM candidate_labels WHERE label IS NOT NULL AND candidate_id IS NOT NULL)")
def b23_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "candidate_labels").where("label is not null").select("candidate_id")
    return table(spark, sf, "candidates").select("candidate_id").distinct().join(lab, "candidate_id", "left_anti").agg(F.count("*").alias("unlabelled"))


@query("""WITH f AS (SELECT DISTINCT candidate_id, st_unusualness FROM candidate_features WHERE st_unusualness IS NOT NULL AND NOT isnan(st_unusualness)), l AS (SELECT DISTINCT candidate_id, label FROM candidate_labels WHERE label IS NOT NULL),
j AS (SELECT label, CASE WHEN st_unusualness < 0.2 THEN 1 ELSE 0 END AS p FROM f JOIN l USING (candidate_id)), c AS (SELECT sum(CASE WHEN p = 1 AND label = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN p = 1 AND label = 0 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN p = 0 AND label = 1 THEN 1.0 ELSE 0 END) AS fn FROM j)
SELECT round((tp / (tp + fp))::DOUBLE, 6) AS precision, round((tp / (tp + fn))::DOUBLE, 6) AS recall, round((2 * tp / (2 * tp + fp + fn))::DOUBLE, 6) AS f1 FROM c""")
def d23_prf1(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "candidate_features").where("st_unusualness is not null and not isnan(st_unusualness)").select("candidate_id", "st_unusualness").distinct()
    lab = table(spark, sf, "candidate_labels").where("label is not null").distinct()
    j = f.join(lab, "candidate_id").withColumn("p", (F.col("st_unusualness") < 0.2).cast("int"))
    m = E.prf1(j, "label", "p")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


_CASE = """c AS (SELECT DISTINCT candidate_id, query_id FROM candidates WHERE query_id IS NOT NULL), f AS (SELECT DISTINCT candidate_id, round(st_unusualness, 1) + 0.0 AS s FROM candidate_features WHERE st_unusualness IS NOT NULL AND NOT isnan(st_unusualness)),
j AS (SELECT query_id, candidate_id, s FROM c JOIN f USING (candidate_id)), t AS (SELECT query_id, min(candidate_id) AS candidate_id FROM j GROUP BY query_id), truth AS (SELECT j.* FROM j JOIN t USING (query_id, candidate_id)),
r AS (SELECT t.query_id, (SELECT count(*) FILTER (j.s > t.s) + (count(*) FILTER (j.s = t.s AND j.candidate_id <> t.candidate_id) + 2) / 2.0 FROM j WHERE j.query_id = t.query_id) AS rank FROM truth t)"""


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "candidates").select("candidate_id", "query_id").where("query_id is not null").distinct()
    f = table(spark, sf, "candidate_features").where("st_unusualness is not null and not isnan(st_unusualness)").select("candidate_id", (F.round("st_unusualness", 1) + 0.0).alias("s")).distinct()
    j = c.join(f, "candidate_id")
    t = j.groupBy("query_id").agg(F.min("candidate_id").alias("_t"))
    j = j.join(t, "query_id").withColumn("truth", F.col("candidate_id") == F.col("_t"))
    return E.mid_rank(j, "query_id", "s", "truth")


@query(f"WITH {_CASE} SELECT query_id, rank::DOUBLE AS rank FROM r")
def e7_rank_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf)


@query(f"WITH {_CASE} SELECT round(avg(1 / rank::DOUBLE), 4) AS mrr, round(avg(rank::DOUBLE), 4) AS mean_rank FROM r")
def d22_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return E.rank_metrics(_ranks(spark, sf))


_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query(f"WITH {_E}, q AS (SELECT v FROM e WHERE vec_id = 0) SELECT e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS sim FROM e, q WHERE e.vec_id <> 0 ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.vec_id LIMIT 20")
def e5_knn_single(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).withColumn("_c", S.cosine("embedding", "q", 0.0))  # one query row
    return s.orderBy(F.desc("_c"), "vec_id").limit(20).select("vec_id", F.round("_c", 6).alias("sim"))


@query(f"WITH {_E}, a AS (SELECT v FROM e WHERE vec_id = 0), b AS (SELECT v FROM e WHERE vec_id = 1) SELECT e.vec_id, round(list_cosine_similarity(e.v, a.v) + list_cosine_similarity(e.v, b.v), 6) AS score FROM e, a, b WHERE e.vec_id > 1 ORDER BY list_cosine_similarity(e.v, a.v) + list_cosine_similarity(e.v, b.v) DESC, e.vec_id LIMIT 20")
def e6_knn_pair(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id < 2").agg(F.max(F.when(F.col("vec_id") == 0, F.struct("vec_id", "embedding")))["embedding"].alias("a"), F.max(F.when(F.col("vec_id") == 1, F.struct("vec_id", "embedding")))["embedding"].alias("b"))
    s = e.where("vec_id > 1").crossJoin(F.broadcast(q)).withColumn("_c", S.cosine("embedding", "a", 0.0) + S.cosine("embedding", "b", 0.0))  # one query row
    return s.orderBy(F.desc("_c"), "vec_id").limit(20).select("vec_id", F.round("_c", 6).alias("score"))


@query(f"WITH {_E}, q AS (SELECT list_transform(list_zip(a.v, b.v, c.v), lambda z: z[2] / sqrt(list_dot_product(b.v, b.v)) - z[1] / sqrt(list_dot_product(a.v, a.v)) + z[3] / sqrt(list_dot_product(c.v, c.v))) AS v FROM e a, e b, e c WHERE a.vec_id = 0 AND b.vec_id = 1 AND c.vec_id = 2) SELECT e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS sim FROM e, q WHERE e.vec_id > 2 ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.vec_id LIMIT 40")
def e16_analogy(spark: SparkSession, sf: str) -> DataFrame:
    from geoloom.operators.wordvectors import analogy

    return analogy(table(spark, sf, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec")), 0, 1, 2).select(F.col("word").alias("vec_id"), F.round("sim", 6).alias("sim"))


@query(f"WITH {_E}, n AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS l2, list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') AS l1 FROM e) SELECT vec_id, round(l1, 5) AS l1, round(l2, 5) AS l2 FROM n")
def g30_vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.norm1("embedding"), 5).alias("l1"), F.round(S.norm2("embedding"), 5).alias("l2"))


@query(f"WITH {_V}, p AS (SELECT tid, {_COS.format('s', 't')} AS a, {_COS.format('s', 'x')} AS b, {_COS.format('t', 'x')} AS c FROM v) SELECT tid, round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) AS score FROM p")
def g27_cross_modal_score(spark: SparkSession, sf: str) -> DataFrame:
    v = C.vectors(table(spark, sf, "post_embedding"), DIM, "spatial_embedding", "temporal_embedding", "textual_embedding")
    s = S.cosine("spatial_embedding", "temporal_embedding", 0.0) + S.cosine("spatial_embedding", "textual_embedding", 0.0) + S.cosine("temporal_embedding", "textual_embedding", 0.0)
    return v.select("tid", F.round(s, 6).alias("score"))


@query()
def h43_event_classifier(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "candidate_features").distinct().join(table(spark, sf, "candidate_labels").where("label is not null").distinct(), "candidate_id")
    names = ["spatial_unusualness", "temporal_unusualness", "st_unusualness", "lat_std", "lng_std", "time_std", "semantic_std", "spatial_burstiness"]
    f = f.replace(float("nan"), None)
    return E.event_classifier(f, names, "label", "candidate_id")


@query()
def h12_mixture_clusters(spark: SparkSession, sf: str) -> DataFrame:
    from geoloom.operators.mixture import cluster_windows

    m = _with_vectors(spark, sf).where("query_id is not null and lat is not null and lng is not null").select("query_id", "tid", "lat", "lng", F.col("textual_embedding").alias("vec")).distinct()
    m = m.where((F.array_max("vec") > 0) | (F.array_min("vec") < 0))
    return cluster_windows(m, "query_id").select("query_id", "tid", "cluster_id")


@query()
def h41_spherical_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    from geoloom.operators.clustering import spherical_kmeans

    return spherical_kmeans(table(spark, sf, "embeddings"), "embedding", 8).select("vec_id", "cluster")
