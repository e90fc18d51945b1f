"""The queries of problems 2 to 10 and the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.ngrams import marked, ngram_counts
from geoloom.llm.clusters import close_clusters, minhash_groups, typical_members
from geoloom.llm.encode import encoded, token_count
from geoloom.llm.lookalike import canonical_forms, visual_words
from geoloom.llm.neighbours import nearest
from geoloom.llm.packing import pack, summary
from geoloom.llm.pairs import PairTable, post_words
from geoloom.llm.sentences import sentences
from geoloom.llm.top_n import top_n
from geoloom.sources.tables import table, tokens
from geoloom.storage import at_most, cut, release


def _pair_scores(spark: SparkSession, sf_dir: str, min_both: int) -> DataFrame:
    """The table is fed as the posts arrive: those of the first nine tenths of all arrivals, then the rest as a change."""
    rows = table(spark, sf_dir, "tweet").select("tid", "words", F.col("ingested_at").cast("double").alias("at")).where("tid is not null")
    line = rows.agg(F.percentile_approx("at", 0.9, 1000)).first()[0]
    early = F.coalesce(F.col("at") <= line, F.lit(True)) if line is not None else F.lit(True)
    base = rows.groupBy("tid").agg(F.max(early).alias("had"), F.min(F.when(early, F.col("words"))).alias("old"), F.min("words").alias("new"))
    base, at = cut(base, "baskets")
    none, basket = F.lit(None).cast("array<string>"), lambda c: F.coalesce(tokens(c), F.array().cast("array<string>"))
    pairs = PairTable(spark, min_both=min_both)
    pairs.apply(base.where("had").select(none.alias("before"), basket("old").alias("after")), scores=False)
    later = base.where("not had or not (old <=> new)")
    pairs.apply(later.select(F.when(F.col("had"), basket("old")).alias("before"), basket("new").alias("after")))
    release(spark, at)
    return pairs.scores()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word_a, word_b): pairs of words in at least 10 posts together, at least 8 times as many as by chance."""
    s = _pair_scores(spark, sf_dir, 10)
    return s.where(F.col("lift") >= 8).select(F.col("a").alias("word_a"), F.col("b").alias("word_b"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word_a, word_b, n_a, n_b, n_ab, lift) of every pair of words that posts use together."""
    s = _pair_scores(spark, sf_dir, 1)
    return s.select(F.col("a").alias("word_a"), F.col("b").alias("word_b"), "n_a", "n_b", "n_ab", "lift")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_tid, tid): posts joined by chains of posts at most 80 m and 600 s apart, at least 5 together."""
    posts = table(spark, sf_dir, "tweet").select("tid", "lat", "lng", "ts")
    return close_clusters(posts, "tid", "lat", "lng", "ts", 80.0, 600, 5).select(F.col("cluster").alias("cluster_tid"), F.col("id").alias("tid"))


def p3_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_tid, size, rank, tid): the size of every cluster and its three most typical posts."""
    posts = table(spark, sf_dir, "tweet").select("tid", "lat", "lng", "ts")
    found = close_clusters(posts, "tid", "lat", "lng", "ts", 80.0, 600, 5)
    t = typical_members(found, posts, "tid", "lat", "lng", "ts", 80.0, 600)
    return t.select(F.col("cluster").alias("cluster_tid"), "size", "rank", F.col("id").alias("tid"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component_tid, medoid_tid, tid, size): groups of at least two posts by MinHash, Jaccard and medoids, see README."""
    posts = table(spark, sf_dir, "tweet").select("tid", "lat", "lng", "ts")
    g = minhash_groups(posts, "tid", "lat", "lng", "ts", 80.0, 600, 2)
    return g.select(F.col("component").alias("component_tid"), F.col("medoid").alias("medoid_tid"), F.col("id").alias("tid"), "size")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid_a, tid_b): posts of which one is among the 5 most similar to the other, with a cosine of at least 0.95."""
    near = nearest(table(spark, sf_dir, "post_embedding"), "tid", "textual_embedding", 5, dim=48, min_similarity=0.95, margin=0.1, scan=False)  # the graph finds pairs as close as these
    return near.select(F.least("id", "near").alias("tid_a"), F.greatest("id", "near").alias("tid_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, near, sim, rank): the 5 most similar posts, for the posts whose tid is divisible by 20, among all posts."""
    near = nearest(table(spark, sf_dir, "post_embedding"), "tid", "textual_embedding", 5, dim=48, queries=F.col("id") % 20 == 0)
    return near.select(F.col("id").alias("tid"), "near", "sim", "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, candidate_id): the ten candidates of each query with the smallest st_unusualness."""
    cand = table(spark, sf_dir, "candidates").select("candidate_id", "query_id").where("query_id is not null").distinct()
    feat = table(spark, sf_dir, "candidate_features").select("candidate_id", "st_unusualness")
    feat = feat.where("st_unusualness is not null and not isnan(st_unusualness)").distinct()
    return top_n(cand.join(feat, "candidate_id"), "query_id", "st_unusualness", "candidate_id", 10, unique=True).select("query_id", "candidate_id")


def _spellings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    posts = table(spark, sf_dir, "tweet").select("tid", "words").where("tid is not null and words is not null")
    vocab = table(spark, sf_dir, "vocab").select("word", "word_id")
    seen = posts.select(F.explode(visual_words("words")).alias("value"))
    return posts, canonical_forms(seen, vocab)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, word_id): a reader sees the vocab word in the post, but no token of the post is exactly that word."""
    posts, forms = _spellings(spark, sf_dir)
    forms, _ = cut(forms.where("word_id is not null"), "forms")
    seen = posts.withColumn("value", F.explode(F.array_distinct(visual_words("words"))))
    if at_most(forms, 200_000):
        seen = seen.join(F.broadcast(forms), "value")
    else:  # a word that a third of all posts hold is spread over as many tasks as there are salts
        salted = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31)).cast("array<bigint>")))
        seen = seen.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(32))).join(salted, ["value", "salt"])
    return seen.where(~F.array_contains(tokens("words"), F.col("canonical"))).select("tid", "word_id").distinct()


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, canonical, word_id): the consistent form of every word that a post shows."""
    return _spellings(spark, sf_dir)[1]


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, cf, df, mark): occurrences and posts of every word, marked if too rare or too common."""
    posts = post_words(table(spark, sf_dir, "tweet").select("tid", "words")).select(tokens("words").alias("terms"))
    n = table(spark, sf_dir, "tweet").select("tid").where("tid is not null").distinct().count()
    return marked(ngram_counts(posts, max_n=1), n, 5, 0.04).select(F.col("ngram").alias("word"), "cf", "df", "mark")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, mark): words that fewer than 5 posts or more than 4 % of all posts hold."""
    return p7_counts(spark, sf_dir).where("mark is not null").select("word", "mark")


def p7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ngram, n, cf, df): every n-gram of up to three words, its occurrences and posts."""
    posts = post_words(table(spark, sf_dir, "tweet").select("tid", "words")).select(tokens("words").alias("terms"))
    return ngram_counts(posts, max_n=3).withColumn("ngram", F.replace("ngram", F.lit("\x1f"), F.lit(" ")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document by byte_bpe_50k."""
    return table(spark, sf_dir, "documents").select("doc_id", encoded("text").alias("ids"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, size, container, fill): documents in containers of 2,048 tokens of byte_bpe_50k."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", token_count("text").alias("n")), "doc_id", "n", 2048)


def p9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers used, the certified lower bound, tokens and the share of unused space."""
    return summary(p9_containers(spark, sf_dir), 2048)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, end_pos): where the sentences of every document end, in code points."""
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_kind").select("doc_id", "end_pos")


QUERIES = {f.__name__: f for f in (p2_found, p2_scores, p3_found, p3_typical, p3_groups, p4_found, p4_neighbours, p5_found, p6_found, p6_forms, p7_found, p7_counts, p7_ngrams, p8_ids, p9_containers, p9_summary, p10_found)}

_POSTS = """post AS (SELECT tid, min(words) AS words FROM tweet WHERE tid IS NOT NULL GROUP BY tid),
word AS (SELECT tid, w, i FROM (SELECT tid, unnest(string_split(words, ' ')) AS w, unnest(range(1, len(string_split(words, ' ')) + 1)) AS i FROM post) WHERE w <> '')"""

_PAIRS = f"""WITH {_POSTS},
held AS (SELECT DISTINCT tid, w FROM word),
n AS (SELECT count(*) AS n FROM post),
one AS (SELECT w, count(*) AS c FROM held GROUP BY w),
two AS (SELECT x.w AS word_a, y.w AS word_b, count(*) AS n_ab FROM held x JOIN held y ON x.tid = y.tid AND x.w < y.w GROUP BY 1, 2)"""

ORACLES = {
    "p2_found": f"""{_PAIRS}
SELECT word_a, word_b FROM two JOIN one a ON a.w = word_a JOIN one b ON b.w = word_b, n WHERE n_ab >= 10 AND n_ab * n >= 8 * a.c * b.c""",
    "p2_scores": f"""{_PAIRS}
SELECT word_a, word_b, a.c AS n_a, b.c AS n_b, n_ab, n_ab::DOUBLE * n / (a.c::DOUBLE * b.c) AS lift FROM two JOIN one a ON a.w = word_a JOIN one b ON b.w = word_b, n""",
    "p3_found": """
WITH RECURSIVE p AS (
  SELECT DISTINCT tid, lat, lng - 360 * floor((lng + 180) / 360) AS lng, ts FROM tweet
  WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND abs(lng) < 1e15 AND NOT (lat = 0 AND lng = 0) AND ts IS NOT NULL),
cell AS (SELECT *, floor(ts / 601)::BIGINT AS c FROM p),
near AS (SELECT *, unnest([c - 1, c, c + 1]) AS k FROM cell),
link AS (
  SELECT a.tid AS x, b.tid AS y FROM cell a JOIN near b ON a.c = b.k AND a.tid <> b.tid
  WHERE abs(a.ts - b.ts) <= 600 AND abs(a.lat - b.lat) < 0.001
    AND 2 * 6373000 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 80),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
named AS (SELECT x AS tid, least(x, min(y)) AS cluster_tid FROM reach GROUP BY x),
big AS (SELECT cluster_tid FROM named GROUP BY cluster_tid HAVING count(*) >= 5)
SELECT cluster_tid, tid FROM named WHERE cluster_tid IN (SELECT cluster_tid FROM big)""",
    "p3_typical": """
WITH RECURSIVE p AS (
  SELECT DISTINCT tid, lat, lng - 360 * floor((lng + 180) / 360) AS lng, ts FROM tweet
  WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND abs(lng) < 1e15 AND NOT (lat = 0 AND lng = 0) AND ts IS NOT NULL),
cell AS (SELECT *, floor(ts / 601)::BIGINT AS c FROM p),
near AS (SELECT *, unnest([c - 1, c, c + 1]) AS k FROM cell),
link AS (
  SELECT a.tid AS x, b.tid AS y FROM cell a JOIN near b ON a.c = b.k AND a.tid <> b.tid
  WHERE abs(a.ts - b.ts) <= 600 AND abs(a.lat - b.lat) < 0.001
    AND 2 * 6373000 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 80),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
named AS (SELECT x AS tid, least(x, min(y)) AS cluster_tid FROM reach GROUP BY x),
big AS (SELECT cluster_tid FROM named GROUP BY cluster_tid HAVING count(*) >= 5),
found AS (SELECT cluster_tid, named.tid, lat, lng, ts FROM named JOIN p ON p.tid = named.tid WHERE cluster_tid IN (SELECT cluster_tid FROM big)),
rel AS (SELECT f.*, r.lng + (f.lng - r.lng - 360 * floor((f.lng - r.lng + 180) / 360)) AS x FROM found f JOIN found r ON r.tid = f.cluster_tid),
mean AS (SELECT cluster_tid, count(*) AS size, avg(lat) AS y, avg(x) AS x0, avg(ts) AS t FROM rel GROUP BY cluster_tid),
apart AS (SELECT rel.cluster_tid, size, tid, round(pow(2 * 6373000 * asin(least(1, sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x0 - x) / 2), 2)))) / 80, 2) + pow((ts - t) / 600, 2), 9) AS o FROM rel JOIN mean USING (cluster_tid))
SELECT cluster_tid, size, rank, tid FROM (SELECT *, row_number() OVER (PARTITION BY cluster_tid ORDER BY o, tid) AS rank FROM apart) WHERE rank <= 3""",
    "p4_found": """
WITH ok AS (SELECT DISTINCT tid, textual_embedding::DOUBLE[] AS v FROM post_embedding
  WHERE len(textual_embedding) = 48 AND len(list_filter(textual_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(textual_embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.tid AS x, b.tid AS y, list_cosine_similarity(a.v, b.v) AS c FROM ok a JOIN ok b ON a.tid <> b.tid WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
best AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM near)
SELECT DISTINCT least(x, y) AS tid_a, greatest(x, y) AS tid_b FROM best WHERE r <= 5""",
    "p5_found": """
SELECT query_id, candidate_id FROM (
  SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY st_unusualness + 0.0, candidate_id) AS r
  FROM (SELECT DISTINCT candidate_id, query_id FROM candidates WHERE query_id IS NOT NULL)
  JOIN (SELECT DISTINCT candidate_id, st_unusualness FROM candidate_features WHERE st_unusualness IS NOT NULL AND NOT isnan(st_unusualness)) USING (candidate_id))
WHERE r <= 10""",
    "p7_found": f"""WITH {_POSTS},
df AS (SELECT w AS word, count(DISTINCT tid) AS d FROM word GROUP BY w)
SELECT word, CASE WHEN d < 5 THEN 'rare' ELSE 'common' END AS mark FROM df, (SELECT count(*) AS n FROM post) WHERE d < 5 OR d > 0.04 * n""",
    "p7_counts": f"""WITH {_POSTS}
SELECT w AS word, count(*) AS cf, count(DISTINCT tid) AS df,
  CASE WHEN count(DISTINCT tid) < 5 THEN 'rare' WHEN count(DISTINCT tid) > 0.04 * any_value(n) THEN 'common' END AS mark
FROM word, (SELECT count(*) AS n FROM post) GROUP BY w""",
    "p7_ngrams": f"""WITH {_POSTS},
place AS (SELECT tid, w, row_number() OVER (PARTITION BY tid ORDER BY i) AS k FROM word),
gram AS (SELECT tid, w AS ngram, 1 AS n FROM place
  UNION ALL SELECT a.tid, a.w || ' ' || b.w, 2 FROM place a JOIN place b ON a.tid = b.tid AND b.k = a.k + 1
  UNION ALL SELECT a.tid, a.w || ' ' || b.w || ' ' || c.w, 3 FROM place a JOIN place b ON a.tid = b.tid AND b.k = a.k + 1 JOIN place c ON a.tid = c.tid AND c.k = a.k + 2)
SELECT ngram, n::BIGINT AS n, count(*) AS cf, count(DISTINCT tid) AS df FROM gram GROUP BY ngram, n""",
}
