"""Queries over phrases, segmentation, word vectors and the other fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.scalar import seconds_of_day
from geoloom.operators import clustering as K
from geoloom.operators import embedding as E
from geoloom.operators import phrases as P
from geoloom.operators import quality as Q
from geoloom.operators import wordvectors as V
from geoloom.operators.graph import cooccurrence_edges
from geoloom.plans.posts import POST, TOK, _nodes
from geoloom.sources.posts import post_tokens, posts, to_clean_lines, parse_clean
from geoloom.sources.tables import table, tokens, wrap_lng
from geoloom.storage import at_most

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, "words").select("tid", tokens("words").alias("w")).where(F.size("w") > 0)


def _grams(most: int, threshold: int = 20) -> str:
    """SQL of the frequent n-grams up to ``most`` words, each length from the tokens of the one before."""
    out = [f"{POST}, {TOK}, o1 AS (SELECT tid, pos, word AS phrase FROM tok), g1 AS (SELECT phrase, 1 AS n, count(*) AS cnt FROM o1 GROUP BY 1 HAVING count(*) >= {threshold})"]
    for n in range(2, most + 1):
        out.append(f"o{n} AS (SELECT a.tid, a.pos, a.phrase || ' ' || b.word AS phrase FROM o{n - 1} a JOIN tok b ON a.tid = b.tid AND b.pos = a.pos + {n - 1} WHERE a.phrase IN (SELECT phrase FROM g{n - 1}))")
        out.append(f"g{n} AS (SELECT phrase, {n} AS n, count(*) AS cnt FROM o{n} GROUP BY 1 HAVING count(*) >= {threshold})")
    return ", ".join([*out, "gram AS (" + " UNION ALL ".join(f"SELECT * FROM g{n}" for n in range(1, most + 1)) + ")"])


_GRAMS = _grams(6)


@query(f"WITH {_GRAMS} SELECT phrase, n::BIGINT AS n, cnt FROM gram")
def d27_frequent_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return P.frequent_ngrams(_records(spark, sf), "w", 6, 20)


@query(f"""WITH {_GRAMS}, s AS (SELECT count(*) AS total FROM tok), p AS (SELECT phrase, n, cnt, cnt / (total::DOUBLE / n) AS p FROM gram, s),
k AS (SELECT phrase, cnt, p, string_split(phrase, ' ') AS w, unnest(range(1, n)) AS k FROM p WHERE n >= 2), c AS (SELECT k.*, array_to_string(w[1:k], ' ') AS a, array_to_string(w[k + 1:], ' ') AS b FROM k),
j AS (SELECT c.phrase, c.cnt, c.p, k, a.p * b.p AS m, a.cnt AS ca, b.cnt AS cb, row_number() OVER (PARTITION BY c.phrase ORDER BY a.p * b.p DESC, k DESC) AS r FROM c JOIN p a ON a.phrase = c.a JOIN p b ON b.phrase = c.b)
SELECT phrase, round(p / m, 5) AS f1, round(cnt / sqrt(ca::DOUBLE * cb), 6) AS f2, round(sqrt(cnt) * ln(p / m), 5) AS f3, round(p * ln(p / m), 8) AS f4 FROM j WHERE r = 1""")
def h28_phrase_concordance(spark: SparkSession, sf: str) -> DataFrame:
    g = d27_frequent_ngrams(spark, sf)
    n = post_tokens(spark, sf).count()
    c = P.concordance(g, n)
    return c.select("phrase", F.round("f1", 5).alias("f1"), F.round("f2", 6).alias("f2"), F.round("f3", 5).alias("f3"), F.round("f4", 8).alias("f4"))


@query(f"WITH {_GRAMS}, s AS (SELECT n, sum(cnt) AS s FROM gram GROUP BY n) SELECT phrase, gram.n::BIGINT AS n, cnt, round(cnt / s, 8) AS prob FROM gram JOIN s ON gram.n = s.n")
def d31_length_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return P.length_normalised(d27_frequent_ngrams(spark, sf)).withColumn("prob", F.round("prob", 8))


_BI = f"""{POST}, {TOK}, u AS (SELECT word, count(*) AS n FROM tok GROUP BY word), s AS (SELECT count(*) AS total FROM tok), b AS (SELECT x.word AS a, y.word AS b, count(*) AS cnt_ab FROM tok x JOIN tok y ON x.tid = y.tid AND y.pos = x.pos + 1 GROUP BY 1, 2),
sc AS (SELECT a, b, ua.n AS cnt_a, ub.n AS cnt_b, cnt_ab, (cnt_ab - 5)::DOUBLE / ua.n / ub.n * total AS score FROM b JOIN u ua ON ua.word = a JOIN u ub ON ub.word = b, s WHERE ua.n >= 5 AND ub.n >= 5)"""


@query(f"WITH {_BI} SELECT a, b, cnt_a, cnt_b, cnt_ab, score FROM sc")
def d33_bigram_scores(spark: SparkSession, sf: str) -> DataFrame:
    return P.bigram_scores(_records(spark, sf), "w", 5)


@query(f"""WITH RECURSIVE {_BI}, hot AS (SELECT DISTINCT a, b FROM sc WHERE score > 5), t AS (SELECT x.tid, x.pos, x.word, hot.a IS NOT NULL AS hot FROM tok x LEFT JOIN tok y ON x.tid = y.tid AND y.pos = x.pos + 1 LEFT JOIN hot ON hot.a = x.word AND hot.b = y.word),
walk AS (SELECT tid, pos, word, hot, false AS glued FROM t WHERE pos = 1 UNION ALL SELECT t.tid, t.pos, t.word, t.hot, walk.hot AND NOT walk.glued FROM walk JOIN t ON t.tid = walk.tid AND t.pos = walk.pos + 1),
part AS (SELECT tid, pos, word, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY pos) AS g FROM walk), joined AS (SELECT tid, g, string_agg(word, '_' ORDER BY pos) AS w FROM part GROUP BY tid, g)
SELECT tid, string_agg(w, ' ' ORDER BY g) AS words FROM joined GROUP BY tid""")
def h42_joined_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    j = P.join_bigrams(_records(spark, sf), "w", P.bigram_scores(_records(spark, sf), "w", 5), 5.0)
    return j.select("tid", F.array_join("words", " ").alias("words"))


@query(f"WITH {_GRAMS}, l AS (SELECT lower(word) AS k, count(*) AS n FROM tok GROUP BY 1), r AS (SELECT phrase, n, cnt::DOUBLE AS score FROM gram) SELECT phrase, score, coalesce(l.n, 0) AS support FROM r LEFT JOIN l ON l.k = replace(lower(phrase), ' ', '_') WHERE coalesce(l.n, 0) >= 30")
def b15_support_filter(spark: SparkSession, sf: str) -> DataFrame:
    r = d27_frequent_ngrams(spark, sf).select("phrase", F.col("cnt").cast("double").alias("score"))
    return P.support_filter(r, post_tokens(spark, sf).select("word"), 30).withColumn("support", F.col("support").cast("bigint"))


@query(f"WITH {_GRAMS} SELECT replace(phrase, ' ', '_') AS phrase, cnt::DOUBLE AS score FROM gram WHERE n BETWEEN 2 AND 6")
def e12_combine_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return P.combine_phrases(d27_frequent_ngrams(spark, sf).select("phrase", F.col("cnt").cast("double").alias("score")))


@query(f"""WITH {_GRAMS}, r AS (SELECT phrase, n::BIGINT AS n, cnt::DOUBLE AS score, cnt::DOUBLE / 100 AS quality, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, phrase DESC) AS pos FROM gram),
m AS (SELECT *, avg(quality) OVER (PARTITION BY n ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM r), c AS (SELECT n, min(pos) AS cut FROM m WHERE a < 0.5 GROUP BY n)
SELECT phrase, m.n, score, quality, pos FROM m LEFT JOIN c ON c.n = m.n WHERE (cut IS NULL OR pos < cut) AND pos <= 200""")
def b18_pruned_phrases(spark: SparkSession, sf: str) -> DataFrame:
    r = d27_frequent_ngrams(spark, sf).select("phrase", "n", F.col("cnt").cast("double").alias("score"), (F.col("cnt") / 100).alias("quality"))
    return P.prune_by_window(r, 2, 0.5, 200)


@query(f"WITH {_GRAMS} SELECT phrase, cnt FROM gram WHERE n = 1 QUALIFY row_number() OVER (ORDER BY cnt DESC, phrase) <= (SELECT count(*) // 2 FROM gram WHERE n = 1)")
def e14_top_half(spark: SparkSession, sf: str) -> DataFrame:
    return Q.top_half(d27_frequent_ngrams(spark, sf).where("n = 1"), "phrase").select("phrase", "cnt")


@query(f"""WITH {_GRAMS}, idf AS (SELECT word, round(greatest(ln((SELECT count(*) FROM post) / count(DISTINCT tid)), 1e-10), 6) AS idf FROM tok GROUP BY word), w AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS word, unnest(range(1, n + 1)) AS i FROM gram),
x AS (SELECT phrase, i, coalesce(idf, 0) AS idf, CASE WHEN len(w.word) <= 4 THEN 1 ELSE 0 END AS s FROM w LEFT JOIN idf USING (word))
SELECT phrase, round(avg(idf), 5) AS avg_idf, round(avg(s), 5) AS stop_ratio, arg_min(s, i)::BIGINT AS first_stop, arg_max(s, i)::BIGINT AS last_stop FROM x GROUP BY phrase""")
def d30_stopword_features(spark: SparkSession, sf: str) -> DataFrame:
    from geoloom.plans.posts import d3_tfidf

    g = d27_frequent_ngrams(spark, sf)
    idf = d3_tfidf(spark, sf).select("word", "idf")
    f = P.stopword_features(g, idf.where(F.length("word") <= 4).select("word"), idf)  # words of up to four letters stand in for a list
    return f.select("phrase", F.round("avg_idf", 5).alias("avg_idf"), F.round("stop_ratio", 5).alias("stop_ratio"), "first_stop", "last_stop")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return h28_phrase_concordance(spark, sf).join(d30_stopword_features(spark, sf), "phrase")


_F = ["f1", "f2", "f3", "f4", "avg_idf", "stop_ratio"]


@query()
def h25_phrase_quality(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    known = Q.top_half(d27_frequent_ngrams(spark, sf).where("n >= 2"), "phrase")
    lab = Q.auto_labels(f, _F, known, 8)
    return Q.ranked(Q.forest_scores(f, _F, lab, 20, 8)[0])


@query()
def h30_viterbi_segments(spark: SparkSession, sf: str) -> DataFrame:
    return Q.reestimate(_records(spark, sf), "w", d27_frequent_ngrams(spark, sf))


@query()
def h39_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return V.skip_gram(_records(spark, sf), "w", 16, min_count=20)


def _h38(rounds: int = 5) -> str:
    out = [f"""{_GRAMS}, u AS (SELECT word, count(*) AS n FROM tok GROUP BY word), s AS (SELECT count(*) AS total FROM tok), b AS (SELECT x.word AS a, y.word AS b, count(*) AS cnt_ab FROM tok x JOIN tok y ON x.tid = y.tid AND y.pos = x.pos + 1 GROUP BY 1, 2),
sc AS (SELECT a, b, (cnt_ab - 20)::DOUBLE / ua.n / ub.n * total AS score FROM b JOIN u ua ON ua.word = a JOIN u ub ON ub.word = b, s WHERE ua.n >= 20 AND ub.n >= 20),
near AS (SELECT a AS word, b AS near, least(score / 10, 1.0) AS sim FROM sc WHERE score > 0), given AS (SELECT phrase AS word, cnt / (cnt + 100.0::DOUBLE) AS given FROM gram WHERE length(phrase) > 4), stop AS (SELECT DISTINCT word FROM near WHERE length(word) <= 3),
base AS (SELECT near.word, sum(sim * coalesce(given, 0)) / 3 AS start FROM near LEFT JOIN given ON given.word = near.near GROUP BY near.word),
r0 AS (SELECT coalesce(base.word, given.word) AS word, coalesce(given, start) AS score, given FROM base FULL JOIN given ON given.word = base.word)"""]
    for i in range(rounds):
        out.append(f"m{i} AS (SELECT near.word, sum(sim * score) / nullif(sum(sim), 0) AS m FROM near JOIN r{i} ON r{i}.word = near.near GROUP BY near.word)")
        out.append(f"r{i + 1} AS (SELECT r.word, coalesce(given, 0.7 * score + 0.3 * (CASE WHEN stop.word IS NOT NULL THEN 0 ELSE coalesce(m, 0) END)) AS score, given FROM r{i} r LEFT JOIN m{i} ON m{i}.word = r.word LEFT JOIN stop ON stop.word = r.word)")
    return f"WITH {', '.join(out)} SELECT word, round(score, 6) AS score FROM r{rounds}"


@query(_h38())
def h38_propagated_quality(spark: SparkSession, sf: str) -> DataFrame:
    g = d27_frequent_ngrams(spark, sf)
    b = P.bigram_scores(_records(spark, sf), "w", 20).where("score > 0")
    near = b.select(F.col("a").alias("word"), F.col("b").alias("near"), F.least(F.col("score") / 10, F.lit(1.0)).alias("sim"))
    given = g.select(F.col("phrase").alias("word"), (F.col("cnt") / (F.col("cnt") + 100)).alias("score")).where("length(word) > 4")
    return Q.propagate(given, near, near.select("word").where("length(word) <= 3")).select("word", F.round("score", 6).alias("score"))


@query()
def h1_mean_shift_times(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "ts").where("ts is not null").select(seconds_of_day(F.col("ts")).cast("double").alias("s"))
    return K.mean_shift(p, ["s"], 1000.0)


@query()
def h1_mean_shift_places(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "lat", "lng", located=True).select("lat", wrap_lng(F.col("lng")).alias("lng"))
    return K.mean_shift(p, ["lat", "lng"], 0.01)


@query()
def h7_graph_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return E.fit(cooccurrence_edges(_nodes(spark, sf)), dim=10, rounds=2)


@query(f"WITH {POST} SELECT tid, uid, lat, lng, ts, array_to_string(string_split(words, ' '), ' ') AS words FROM post WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND ts IS NOT NULL AND created_at IS NOT NULL AND words IS NOT NULL AND raw IS NOT NULL")
def a27_clean_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Posts written in the clean line layout and parsed again."""
    p = posts(spark, sf, "uid", "lat", "lng", "created_at", "ts", "words", "raw").dropna().where("not isnan(lat) and not isnan(lng)")
    lines = to_clean_lines(p.withColumn("words", F.split("words", " ", -1)))
    return parse_clean(lines).select("tid", "uid", "lat", "lng", "ts", F.array_join("words", " ").alias("words"))


@query()
def h36_segmented_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their known phrases in brackets."""
    import math

    phrases = d27_frequent_ngrams(spark, sf)
    if not at_most(phrases, 500_000):  # the dictionary goes to every task
        raise ValueError("too many phrases; raise the support threshold")
    d = phrases.toPandas()
    costs = {p: math.log(c / t) for p, c, t in zip(d["phrase"], d["cnt"], d.groupby("n")["cnt"].transform("sum"))}
    w = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}']+"), lambda x: x != "")
    seg = P.segment(w, costs, 4.0)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(seg, lambda s: F.when(F.instr(s, " ") > 0, F.concat(F.lit("["), s, F.lit("]"))).otherwise(s)), " ").alias("segmented"))
