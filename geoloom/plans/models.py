"""Queries over the mixtures, the cross-modal model, phrase contexts and models, and repeated evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.scalar import seconds_of_day, squared_distance
from geoloom.operators import bins as B
from geoloom.operators import candidates as C
from geoloom.operators import contexts as X
from geoloom.operators import crossmodal as M
from geoloom.operators import evaluate as E
from geoloom.operators import mixture as V
from geoloom.operators import phrasemodel as PM
from geoloom.operators import quality as Q
from geoloom.operators import wordvectors as W
from geoloom.plans.events import _E, _M, DIM, _members, _with_vectors
from geoloom.plans.phrases import _GRAMS, _records, d27_frequent_ngrams, h28_phrase_concordance
from geoloom.plans.posts import _CATS, PLACE, POST
from geoloom.sources.posts import post_tokens, posts
from geoloom.sources.tables import table, tokens, wrap_lng
from geoloom.storage import cut

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# mixtures


@query(f"""WITH {_M}, s AS (SELECT candidate_id, count(*) AS n, sum(lat) AS y, sum(lng) AS x, sum(lat * lat) AS yy, sum(lat * lng) AS yx, sum(lng * lng) AS xx FROM m WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) GROUP BY candidate_id)
SELECT candidate_id, n, round(y / (n + 0.5), 5) AS mean_y, round(x / (n + 0.5), 5) AS mean_x, round(yy + 0.01 - y * y / (n + 0.5), 2) AS yy, round(yx - y * x / (n + 0.5), 2) AS yx, round(xx + 0.01 - x * x / (n + 0.5), 2) AS xx FROM s""")
def d34_cluster_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """What a Gaussian cluster keeps of its points, candidates taken as clusters."""
    m = _members(spark, sf).where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")
    s = C.place_statistics(m, "candidate_id")
    return s.select("candidate_id", "n", *(F.round(c, 5).alias(c) for c in ("mean_y", "mean_x")), *(F.round(c, 2).alias(c) for c in ("yy", "yx", "xx")))


def _streams(binned: DataFrame, width: int, length: int = 336) -> DataFrame:
    """Binned rows with their stream, ``length`` bins each.  A stream has the ``width`` - 1 bins before its own too, so that
    its first window ends at its own first bin and every bin from the ``width``-th on has a window."""
    s = F.floor(F.col("bin_id") / length)
    return binned.withColumn("stream", F.explode(F.when(F.col("bin_id") % length > length - width, F.array(s, s + 1)).otherwise(F.array(s))))


def _binned_vectors(spark: SparkSession, sf: str, width: int = 6) -> DataFrame:
    """Posts with a place, a time and a text vector: bin, coordinates scaled over all of them; and a row without a vector for
    bins that have other posts.  A week of bins is a stream."""
    p = posts(spark, sf, "lat", "lng", "ts", located=True).where("ts is not null").select("tid", "lat", wrap_lng(F.col("lng")).alias("lng"), "ts")
    v = C.vectors(table(spark, sf, "post_embedding"), DIM, "textual_embedding").where((F.array_max("textual_embedding") > 0) | (F.array_min("textual_embedding") < 0))
    b = B.anchored_bins(p).join(v.withColumnRenamed("textual_embedding", "vec"), "tid", "left")
    b, _ = cut(b.select("bin_id", "tid", "lat", "lng", "vec"), "binned")
    rows = Q.zscore(b.where("vec is not null"), ["lat", "lng"]).select("bin_id", "tid", F.col("z_lat").alias("lat"), F.col("z_lng").alias("lng"), "vec").na.fill(0.0, ["lat", "lng"])
    empty = b.where("vec is null").groupBy("bin_id").agg(F.min("tid").alias("tid")).select("bin_id", "tid", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"), F.lit(None).cast(dict(b.dtypes)["vec"]).alias("vec"))
    return _streams(rows.unionByName(empty), width)


@query()
def f3_sliding_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the last six bins at every bin: the oldest bin leaves the sampler, the new one enters; a week is a stream, which
    begins with a fit of the window that ends at its first bin."""
    return V.slide_windows(_binned_vectors(spark, sf), "stream", 6, V.PRESETS["toy"])


@query()
def h23_sliding_text_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The same by text alone."""
    return V.slide_windows(_binned_vectors(spark, sf), "stream", 6, V.PRESETS["text"])


@query()
def h24_batch_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Likelihood after every sweep of a text-only fit of each query's members."""
    m = _with_vectors(spark, sf).where("query_id is not null").select("query_id", "tid", F.col("textual_embedding").alias("vec")).distinct()
    return V.batch_mixture(m.where((F.array_max("vec") > 0) | (F.array_min("vec") < 0)), "query_id", replace(V.PRESETS["batch"], kappa_steps=200))


@query()
def h50_em_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """(tid, cluster_id, score): soft clusters of all text vectors, hard assignment at the end."""
    v = C.vectors(table(spark, sf, "post_embedding"), DIM, "textual_embedding").where((F.array_max("textual_embedding") > 0) | (F.array_min("textual_embedding") < 0))
    return V.em_mixture(v, "textual_embedding", DIM, 64)[0].select("tid", "cluster_id", "score")


# cross-modal model


def _located(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "lat", "lng", "ts", "words", "category", located=True).where("ts is not null")
    return p.select("tid", "lat", wrap_lng(F.col("lng")).alias("lng"), "ts", F.coalesce(tokens("words"), F.array().cast("array<string>")).alias("words"), "category")


def _model(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    p, _ = cut(_located(spark, sf), "located")
    words = p.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).where("cnt >= 20")
    return p, M.fit_model(p, words, dim=16, categories=_CATS)


@query()
def h10_cross_modal_model(spark: SparkSession, sf: str) -> DataFrame:
    """(node, kind, length): every node of the model with the length of its vector."""
    v = _model(spark, sf)[1]["vectors"]
    return v.select("node", F.substring("node", 1, 1).alias("kind"), F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("length"))


@query()
def h44_cross_modal_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """(target, mrr, mean_rank): how well place, time and words are told from those of ten other posts by the other two."""
    p, m = _model(spark, sf)
    v, times = m["vectors"], m["times"]
    day = p.withColumn("s", seconds_of_day(F.col("ts")).cast("double"))

    def feature(kind: str, side: str) -> DataFrame:
        if kind == "w":
            f = M.word_features(p, "tid", "words", v, 16, side)
        elif kind == "l":
            f = M.centre_features(p, "tid", ["lat", "lng"], m["places"], v, "l", 16, 0.01, vector=side)
        else:
            f = M.centre_features(day, "tid", ["s"], times, v, "t", 16, 1000.0, vector=side)
        return cut(f.withColumnRenamed("feature", kind), "features")[0]

    made = {(kind, side): feature(kind, side) for kind in "lwt" for side in ("vec", "ctx")}
    out = None
    for target in "wlt":
        f = made["l", M.side("l", target)].join(made["t", M.side("t", target)], "tid").join(made["w", M.side("w", target)], "tid")
        r = M.evaluate_predictions(f, "tid", target, [k for k in "lwt" if k != target])[1].select(F.lit(target).alias("target"), "mrr", "mean_rank")
        out = r if out is None else out.unionByName(r)
    return out


@query()
def h45_case_study(spark: SparkSession, sf: str) -> DataFrame:
    """Words nearest to the three commonest words and to the sum of the first two."""
    v = _model(spark, sf)[1]["vectors"]
    top = [r.word for r in post_tokens(spark, sf).groupBy("word").count().orderBy(F.desc("count"), "word").limit(3).collect()]
    q = [(w, [f"w:{w}"]) for w in top] + ([(" + ".join(top[:2]), [f"w:{w}" for w in top[:2]])] if len(top) > 1 else [])
    return M.neighbours_of(v, spark.createDataFrame(q, "query string, nodes array<string>"), "w")


@query(f"""WITH {POST}, {PLACE}, s AS (SELECT poi_id, lat AS y, lng AS x0 FROM poi WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)),
d AS (SELECT tid, poi_id, sqrt((lat - y) * (lat - y) + (x - x0) * (x - x0)) AS d FROM place, s WHERE abs(lat - y) <= 0.0021), r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, poi_id) AS r FROM d WHERE d <= 0.002)
SELECT tid, poi_id, r AS rank, round(exp(-(d / 0.002) * (d / 0.002) / 2), 6) AS weight FROM r WHERE r <= 4""")
def c11_kernel_places(spark: SparkSession, sf: str) -> DataFrame:
    """The four places nearest to every post within a bandwidth, with their kernel weights."""
    p = posts(spark, sf, "lat", "lng", located=True).select("tid", "lat", wrap_lng(F.col("lng")).alias("lng"))
    c = table(spark, sf, "poi").where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").select(F.col("poi_id").alias("id"), "lat", "lng")
    return M.kernel_neighbours(p, "tid", ["lat", "lng"], c, 0.002, 4).select("tid", F.col("id").alias("poi_id"), F.col("rank").cast("bigint").alias("rank"), F.round("weight", 6).alias("weight"))


# vectors


@query(f"WITH {_E}, q AS (SELECT v FROM e WHERE vec_id = 0) SELECT vec_id, round(list_sum(list_transform(list_zip(e.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 5) AS d FROM e, q WHERE vec_id <> 0 ORDER BY list_sum(list_transform(list_zip(e.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), vec_id LIMIT 40")
def e20_nearest_by_square(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).withColumn("_d", squared_distance("embedding", "q"))  # one query row
    return s.orderBy("_d", "vec_id").limit(40).select("vec_id", F.round("_d", 5).alias("d"))


@query(f"WITH {_E}, u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), q AS (SELECT list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) AS v FROM u a, u b WHERE a.vec_id = 3 AND b.vec_id = 4) SELECT u.vec_id, round(list_cosine_similarity(u.v, q.v), 6) AS sim FROM u, q WHERE u.vec_id NOT IN (3, 4) ORDER BY list_cosine_similarity(u.v, q.v) DESC, u.vec_id LIMIT 40")
def e15_similar_to_several(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))
    return W.similar(v, [3, 4]).select(F.col("word").alias("vec_id"), F.round("sim", 6).alias("sim"))


@query()
def h39_continuous_bag_of_words(spark: SparkSession, sf: str) -> DataFrame:
    """(word, vec) by the words around, where ``h39_word_vectors`` goes by the word."""
    return W.cbow(_records(spark, sf), "w", 16, min_count=20)


_ASK = "(SELECT vec_id AS a, vec_id + 1 AS b, vec_id + 2 AS c, vec_id + 3 AS d, vec_id // 10 % 8 + 1 AS section FROM embeddings WHERE vec_id % 10 = 0)"


@query(f"""WITH {_E}, u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), ask AS {_ASK},
q AS (SELECT ask.*, list_transform(list_zip(ua.v, ub.v, uc.v), lambda z: z[2] - z[1] + z[3]) AS v FROM ask JOIN u ua ON ua.vec_id = a JOIN u ub ON ub.vec_id = b JOIN u uc ON uc.vec_id = c JOIN u ud ON ud.vec_id = d)
SELECT q.section::BIGINT AS section, a, b, c, d, (SELECT arg_min(w.vec_id, {{'s': -round(list_dot_product(w.v, q.v), 9), 'i': w.vec_id}}) FROM u w WHERE w.vec_id NOT IN (a, b, c)) AS said FROM q""")
def e17_analogy_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The answer to every question of a test of analogies; questions with a word that has no vector have none."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))
    i = F.col("vec_id")
    q = table(spark, sf, "embeddings").where("vec_id % 10 = 0").select((F.floor(i / 10) % 8 + 1).alias("section"), i.alias("a"), (i + 1).alias("b"), (i + 2).alias("c"), (i + 3).alias("d"))
    return W.analogy_answers(v, q).where("said is not null")


_SAID = """f AS (SELECT candidate_id, min(st_unusualness) AS s FROM candidate_features GROUP BY candidate_id), l AS (SELECT DISTINCT candidate_id, label FROM candidate_labels WHERE label IS NOT NULL),
j AS (SELECT l.candidate_id % 7 + 1 AS section, label, CASE WHEN s IS NULL OR isnan(s) THEN NULL WHEN s < 0.2 THEN 1 ELSE 0 END AS said FROM l LEFT JOIN f USING (candidate_id))"""


@query(f"""WITH {_SAID} SELECT section::VARCHAR AS section, count(*) AS asked, count(said) AS answered, sum(CASE WHEN said = label THEN 1 ELSE 0 END)::BIGINT AS "right" FROM j GROUP BY section
UNION ALL SELECT CASE WHEN section <= 5 THEN 'semantic' ELSE 'syntactic' END, count(*), count(said), sum(CASE WHEN said = label THEN 1 ELSE 0 END)::BIGINT FROM j GROUP BY 1
UNION ALL SELECT 'all', count(*), count(said), sum(CASE WHEN said = label THEN 1 ELSE 0 END)::BIGINT FROM j""")
def d38_accuracy_counters(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "candidate_features").groupBy("candidate_id").agg(F.min("st_unusualness").alias("s"))
    lab = table(spark, sf, "candidate_labels").where("label is not null").select("candidate_id", "label").distinct()
    j = lab.join(f, "candidate_id", "left").withColumn("said", F.when(~F.isnan("s"), (F.col("s") < 0.2).cast("int"))).withColumn("section", F.col("candidate_id") % 7 + 1)
    return E.agreement_counts(j, "section", "label", "said")


@query("""WITH j AS (SELECT query_id, candidate_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s, candidate_id) AS r
FROM (SELECT DISTINCT candidate_id, query_id FROM candidates WHERE query_id IS NOT NULL) JOIN (SELECT DISTINCT candidate_id, st_unusualness + 0.0 AS s FROM candidate_features
WHERE lat_std < 0.02 AND lng_std < 0.02 AND st_unusualness IS NOT NULL AND NOT isnan(st_unusualness)) USING (candidate_id)) SELECT query_id, candidate_id, row_number() OVER (ORDER BY s, candidate_id, query_id) AS pos FROM j WHERE r <= 10""")
def e2_ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return C.rank_all(table(spark, sf, "candidates"), table(spark, sf, "candidate_features"))


_EVENT = ["spatial_unusualness", "temporal_unusualness", "st_unusualness", "lat_std", "lng_std", "time_std", "semantic_std", "spatial_burstiness"]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "candidate_features").distinct().join(table(spark, sf, "candidate_labels").where("label is not null").distinct(), "candidate_id").replace(float("nan"), None)


@query()
def h43_repeated_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """(method, precision, recall, f1): means over 100 repeats of balancing, halving, feature elimination and regression, for
    all features and for the one of unusualness alone."""
    rows = _labelled(spark, sf)
    out = None
    for method, names in (("all", _EVENT), ("unusualness", ["st_unusualness"])):
        m = E.mean_metrics(E.repeated_classifier(rows, names, "label", "candidate_id"), method)
        out = m if out is None else out.unionByName(m)
    return out


@query()
def h43_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return E.forest_importance(_labelled(spark, sf), _EVENT, "label")


# phrases in context


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return X.sentence_pieces(table(spark, sf, "documents"), "doc_id", "text")


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentences, occurrences of the phrases of two or three words that occur 20 times, these phrases)."""
    s, _ = cut(_sentences(spark, sf), "sentences")
    each = s.select("doc_id", "sent", F.explode(X._occurrences("pieces", 3, 2)).alias("o")).select("o.phrase")
    known = each.groupBy("phrase").agg(F.count("*").alias("cnt")).where("cnt >= 20").select("phrase")
    known, _ = cut(known, "known")
    return s, X.occurrences(s, known, 3), known


_SENT = r"""s AS (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS sent FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.!?,;:\[\]]'), lambda x: regexp_matches(x, '[A-Za-z]')) AS l FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, sent, regexp_extract_all(s, '(?s)[A-Za-z]+|[^A-Za-z]') AS p FROM s), k AS (SELECT doc_id, sent, p, unnest(range(1, len(p) + 1)) AS k FROM p),
o AS (SELECT doc_id, sent, lower(p[k] || ' ' || p[k + 2]) AS phrase, [p[k], p[k + 2]] AS w, [p[k + 1]] AS parts, CASE WHEN k > 1 THEN p[k - 1] END AS b, p[k + 3] AS a FROM k WHERE regexp_matches(p[k], '^[A-Za-z]') AND regexp_matches(p[k + 2], '^[A-Za-z]')
  UNION ALL SELECT doc_id, sent, lower(p[k] || ' ' || p[k + 2] || ' ' || p[k + 4]), [p[k], p[k + 2], p[k + 4]], [p[k + 1], p[k + 3]], CASE WHEN k > 1 THEN p[k - 1] END, p[k + 5] FROM k WHERE regexp_matches(p[k], '^[A-Za-z]') AND regexp_matches(p[k + 2], '^[A-Za-z]') AND regexp_matches(p[k + 4], '^[A-Za-z]')),
known AS (SELECT phrase FROM o GROUP BY phrase HAVING count(*) >= 20), f AS (SELECT * FROM o WHERE phrase IN (SELECT phrase FROM known))"""


@query(f"""WITH {_SENT} SELECT phrase, count(*) AS n FROM f GROUP BY phrase""")
def c16_dictionary_matches(spark: SparkSession, sf: str) -> DataFrame:
    s, _, known = _found(spark, sf)
    return X.match_counts(s, known, 3)


@query(f"""WITH {_SENT} SELECT phrase, count(*) AS total, round(avg(CASE WHEN b = '"' AND a = '"' THEN 1.0 ELSE 0 END), 6) AS quote, round(avg(CASE WHEN list_contains(parts, '-') THEN 1.0 ELSE 0 END), 6) AS dash,
round(avg(CASE WHEN b = '(' AND a = ')' THEN 1.0 ELSE 0 END), 6) AS parenthesis, round(avg(CASE WHEN len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 THEN 1.0 ELSE 0 END), 6) AS capital FROM f GROUP BY phrase""")
def d28_punctuation_features(spark: SparkSession, sf: str) -> DataFrame:
    f = X.punctuation_features(_found(spark, sf)[1])
    return f.select("phrase", "total", *(F.round(c, 6).alias(c) for c in ("quote", "dash", "parenthesis", "capital")))


def _word_statistics(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, p) and (word, idf) of the sentences' own words."""
    w = sentences.select("doc_id", F.explode(F.filter("pieces", lambda x: x.rlike("^[A-Za-z]"))).alias("word")).withColumn("word", F.lower("word"))
    per = w.groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("cnt"), F.count("*").alias("df"))
    all_ = per.agg(F.sum("cnt").alias("total")).crossJoin(sentences.agg(F.countDistinct("doc_id").alias("docs")))
    per = per.crossJoin(F.broadcast(all_))  # one row
    return per.select("word", (F.col("cnt") / F.col("total")).alias("p")), per.select("word", F.greatest(F.log(F.col("docs") / F.col("df")), F.lit(1e-10)).alias("idf"))


@query(f"""WITH {_SENT}, own AS (SELECT doc_id, sent, list_transform(list_filter(p, lambda x: regexp_matches(x, '^[A-Za-z]')), lambda x: lower(x)) AS w FROM p),
ctx AS (SELECT a.doc_id, a.sent, list_concat(list_concat(a.w, coalesce(b.w, [])), coalesce(c.w, [])) AS ctx FROM own a LEFT JOIN own b ON b.doc_id = a.doc_id AND b.sent = a.sent - 1 LEFT JOIN own c ON c.doc_id = a.doc_id AND c.sent = a.sent + 1),
wd AS (SELECT doc_id, unnest(w) AS word FROM own), st AS (SELECT word, count(*)::DOUBLE / (SELECT count(*) FROM wd) AS p, greatest(ln((SELECT count(DISTINCT doc_id) FROM s)::DOUBLE / count(DISTINCT doc_id)), 1e-10) AS idf FROM wd GROUP BY word),
c AS (SELECT doc_id, sent, phrase, count(*) AS c FROM f GROUP BY 1, 2, 3), t AS (SELECT c.*, ctx, string_split(phrase, ' ') AS ws FROM c JOIN ctx USING (doc_id, sent)),
x AS (SELECT phrase, c, ctx, ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t), y AS (SELECT phrase, i, word, c, len(list_filter(ctx, lambda z: z = word)) - c * len(list_filter(ws, lambda z: z = word)) AS surplus FROM x),
z AS (SELECT phrase, i, word, sum(CASE WHEN surplus > 0 THEN c ELSE 0 END) AS f, sum(c * greatest(surplus, 0)) AS more, sum(c) AS total FROM y GROUP BY 1, 2, 3)
SELECT phrase, round(sqrt(sum(pow(f / total, 2) * pow(ln(p), 2)) / sum(pow(ln(p), 2))), 6) AS outside, round(sum(more / total * idf) / sum(idf), 6) AS new_outside FROM z JOIN st USING (word) GROUP BY phrase""")
def h29_outside_features(spark: SparkSession, sf: str) -> DataFrame:
    s, _, known = _found(spark, sf)
    f = X.outside_features(s, known, *_word_statistics(s), 3)
    return f.select("phrase", F.round("outside", 6).alias("outside"), F.round("new_outside", 6).alias("new_outside"))


# phrase models


_MODEL = f"{_GRAMS}, total AS (SELECT n, sum(cnt) AS s FROM gram GROUP BY n), model AS (SELECT phrase, gram.n AS n, cnt / s AS prob FROM gram JOIN total ON gram.n = total.n)"


def _splits(worth: str) -> str:
    """SQL of the best product over the proper splits, part by part from the left; ``worth`` is what a part of n words counts."""
    return f"""span AS (SELECT w.phrase, len(w.ws) AS len, i, j, {worth} AS v FROM (SELECT phrase, string_split(phrase, ' ') AS ws FROM gram) w, range(0, 6) a(i), range(1, 7) b(j), model m
  WHERE i < j AND j <= len(w.ws) AND NOT (i = 0 AND j = len(w.ws)) AND m.phrase = array_to_string(w.ws[i + 1:j], ' ')),
walk AS (SELECT phrase, len, j, v FROM span WHERE i = 0 UNION ALL SELECT walk.phrase, walk.len, span.j, walk.v * span.v FROM walk JOIN span ON span.phrase = walk.phrase AND span.i = walk.j),
best AS (SELECT phrase, max(v) AS best FROM walk WHERE j = len GROUP BY phrase)"""


@query(f"WITH RECURSIVE {_MODEL}, {_splits('m.prob * 0.5')} SELECT model.phrase, round(CASE WHEN best > 1e-9 THEN prob / best ELSE 1e10 END, 4) AS f1, round(CASE WHEN best > 1e-9 THEN prob * ln(prob / best) ELSE 1e10 END, 6) AS f4 FROM model LEFT JOIN best USING (phrase)")
def h33_recomputed_features(spark: SparkSession, sf: str) -> DataFrame:
    g = d27_frequent_ngrams(spark, sf)
    r = PM.recomputed_features(g, PM.segmentation_model(g), 0.5)
    return r.select("phrase", F.round("f1", 4).alias("f1"), F.round("f4", 6).alias("f4"))


@query(f"WITH RECURSIVE {_MODEL}, {_splits('m.prob / pow(4.0, m.n - 1)')} SELECT model.phrase FROM model JOIN best USING (phrase) WHERE n >= 2 AND best > prob / pow(4.0, n - 1)")
def h32_broken_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of two words or more that the model at a penalty of 4 takes apart."""
    g = d27_frequent_ngrams(spark, sf)
    return PM.broken_labels(g.where("n >= 2"), PM.segmentation_model(g), 4.0)


@query(f"WITH {_MODEL}, sc AS (SELECT phrase, cnt / (cnt + 100.0) AS score FROM gram WHERE cnt >= 30) SELECT phrase, model.n::BIGINT AS n, round(CASE WHEN model.n = 1 THEN prob ELSE prob * score END, 9) AS prob FROM model LEFT JOIN sc USING (phrase) WHERE model.n = 1 OR score IS NOT NULL")
def h34_segmentation_model(spark: SparkSession, sf: str) -> DataFrame:
    g = d27_frequent_ngrams(spark, sf)
    scored = g.where("cnt >= 30").select("phrase", (F.col("cnt") / (F.col("cnt") + 100.0)).alias("score"))
    return PM.segmentation_model(g, scored).withColumn("prob", F.round("prob", 9))


@query(f"WITH {_GRAMS} SELECT phrase, cnt / (cnt + 100.0) AS score, 'at least' AS kept FROM gram WHERE cnt / (cnt + 100.0) >= 0.3 UNION ALL SELECT phrase, cnt / (cnt + 100.0), 'rank list' FROM gram WHERE cnt / (cnt + 100.0) > 0.5")
def b16_b17_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    r = d27_frequent_ngrams(spark, sf).select("phrase", (F.col("cnt") / (F.col("cnt") + 100.0)).alias("score"))
    return PM.at_least(r, 0.3).withColumn("kept", F.lit("at least")).unionByName(PM.rank_list(r, 7.0).withColumn("kept", F.lit("rank list")))


@query(f"""WITH {_GRAMS}, r AS (SELECT phrase, n, cnt::DOUBLE AS score, cnt::DOUBLE / 100 AS quality, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, phrase DESC) AS pos FROM gram WHERE n BETWEEN 2 AND 6),
m AS (SELECT *, avg(quality) OVER (PARTITION BY n ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM r), c AS (SELECT n, min(pos) AS cut FROM m WHERE a < 0.25 GROUP BY n)
SELECT phrase, score, row_number() OVER (ORDER BY score DESC, phrase DESC) AS pos FROM m LEFT JOIN c ON c.n = m.n WHERE (cut IS NULL OR m.pos < cut) AND m.pos <= 200""")
def e13_prune_and_combine(spark: SparkSession, sf: str) -> DataFrame:
    r = d27_frequent_ngrams(spark, sf).select("phrase", "n", F.col("cnt").cast("double").alias("score"), (F.col("cnt") / 100).alias("quality"))
    return PM.prune_and_combine(r, 2, 0.25, 200)[0]


@query(f"""WITH {_GRAMS}, s AS (SELECT count(*) AS total FROM tok), p AS (SELECT phrase, n, cnt, cnt / (total::DOUBLE / n) AS p FROM gram, s),
k AS (SELECT phrase, cnt, p, string_split(phrase, ' ') AS w, unnest(range(1, n)) AS k FROM p WHERE n >= 2), c AS (SELECT k.*, array_to_string(w[1:k], ' ') AS a, array_to_string(w[k + 1:], ' ') AS b FROM k),
j AS (SELECT c.phrase, c.p, a.p * b.p AS m, c.cnt FROM c JOIN p a ON a.phrase = c.a JOIN p b ON b.phrase = c.b) SELECT phrase, round(max(p) / max(m), 5) AS f1, max(cnt) / (max(cnt) + 100.0) AS score FROM j GROUP BY phrase HAVING max(cnt) >= 25""")
def c8_features_with_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Features of phrases that have a score; those that must not be learnt from are left out."""
    g = d27_frequent_ngrams(spark, sf)
    scored = g.where("cnt >= 25").select("phrase", (F.col("cnt") / (F.col("cnt") + 100.0)).alias("score"))
    return PM.with_scores(PM.without(h28_phrase_concordance(spark, sf), "f2", "f3", "f4", "constant"), scored)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?s)[^.!?,;:\[\]]+[.!?,;:\[\]]*|^[.!?,;:\[\]]+'))::BIGINT AS pieces, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def g6_sentences_with_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every text; the characters of all pieces and marks are those of the text."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", PM.split_with_marks("text").alias("p"))
    whole = F.length(F.array_join(F.transform("p", lambda x: F.concat(x["sentence"], x["mark"])), ""))
    return d.select("doc_id", F.size("p").cast("bigint").alias("pieces"), whole.cast("bigint").alias("chars"))


@query("SELECT doc_id, text AS rendered FROM documents WHERE text IS NOT NULL")
def g12_rendered_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their phrases in brackets; without the brackets set here they are the texts."""
    w = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}']+"), lambda x: x != "")
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", w.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(2)), lambda i: F.array_join(F.slice("w", i + 1, 2), " "))).otherwise(F.col("w"))
    open_, close = "\u0001", "\u0002"
    marked = F.translate("text", "[]", open_ + close)
    return d.select("doc_id", F.translate(F.translate(PM.rendered(marked, pairs), "[]", ""), open_ + close, "[]").alias("rendered"))


@query()
def h37_projected_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return PM.projected_neighbours(v, v, "vec_id", "embedding", 64)


@query()
def h31_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """(penalty): the largest at which no more than a twentieth of the phrases of two words or more come apart."""
    g = d27_frequent_ngrams(spark, sf)
    return spark.createDataFrame([(Q.find_penalty(_records(spark, sf), "w", g, g.where("n >= 2").select("phrase")),)], "penalty double")
