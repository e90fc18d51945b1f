"""Queries over text layouts and small post operators: written as lines, parsed again, compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import scalar as S
from geoloom.functions import text as T
from geoloom.operators import bins as B
from geoloom.operators import phrasemodel as PM
from geoloom.operators.graph import cooccurrence_edges
from geoloom.operators import candidates as C
from geoloom.operators.candidates import vectors
from geoloom.operators.evaluate import balanced
from geoloom.operators.ranking import top_lines
from geoloom.plans.events import _KEPT, _M, _V, DIM, _members, _with_vectors, d23_prf1
from geoloom.plans.phrases import _GRAMS, d27_frequent_ngrams
from geoloom.plans.posts import _BINS, _GRAPH, CELL, PLACE, POST, TOK, _cell, _nodes, d1_word_counts
from geoloom.sources import formats as L
from geoloom.sources import posts as R
from geoloom.sources.posts import posts
from geoloom.sources.tables import table, tokens

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(values: DataFrame) -> DataFrame:
    """Values with the number of their line; a file's lines would have theirs."""
    return values.withColumn("line_no", F.monotonically_increasing_id())


# posts


_WHOLE = "lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND ts IS NOT NULL AND words IS NOT NULL AND raw IS NOT NULL AND uid IS NOT NULL"


@query(f"""WITH p AS (SELECT DISTINCT tid, uid, lat, lng, ts, words, raw, poi_id, poi_lat, poi_lng, category, poi_name FROM tweet WHERE tid IS NOT NULL AND created_at IS NOT NULL AND {_WHOLE})
SELECT tid, coalesce(poi_id, '') AS poi_id, CASE WHEN isnan(poi_lat) THEN NULL ELSE poi_lat END AS poi_lat, CASE WHEN isnan(poi_lng) THEN NULL ELSE poi_lng END AS poi_lng, coalesce(category, '') AS category, coalesce(poi_name, '') AS poi_name FROM p""")
def a3_posts_with_places(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with their place in the clean layout, parsed again."""
    names = ["tid", "uid", "lat", "lng", "created_at", "ts", "words", "raw", "poi_id", "poi_lat", "poi_lng", "category", "poi_name"]
    p = table(spark, sf, "tweet").where(f"tid is not null and created_at is not null and {_WHOLE}").select(*names).distinct()
    lines = p.select(F.array_join(F.array(*(F.coalesce(F.when(F.col(c).isNotNull(), F.col(c).cast("string")), F.lit("")) for c in names)), "\x01").alias("value"))
    out = R.parse_clean(lines)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("poi_lat", "poi_lng")]
    return out.select("tid", "poi_id", *clean, "category", "poi_name")


@query(f"WITH p AS (SELECT DISTINCT tid, lat, lng, ts, words, category, raw FROM tweet WHERE tid IS NOT NULL AND {_WHOLE}), w AS (SELECT *, array_to_string(list_filter(string_split_regex(words, '[ \t\n\f\r' || chr(11) || ']+'), lambda x: x <> ''), ' ') AS ws FROM p) SELECT tid, lat, lng, ts, ws AS words, '' AS category, 'ny' AS layout FROM w UNION ALL SELECT tid, lat, lng, ts, ws, coalesce(category, ''), 'checkin' FROM w UNION ALL SELECT tid, lat, lng, ts, words, NULL, 'json' FROM p")
def a4_older_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts in three older layouts, parsed again."""
    p = table(spark, sf, "tweet").where(f"tid is not null and {_WHOLE}").select("tid", "uid", "lat", "lng", "ts", "words", "category", "raw").distinct()
    none, cat = F.lit(""), F.coalesce("category", F.lit(""))
    out = None
    for layout, fields in (("ny", ["tid", none, "lat", "lng", none, "ts", "words"]), ("checkin", ["tid", none, "lat", "lng", none, "ts", cat, "words"])):
        line = p.select(F.array_join(F.array(*((F.col(c) if isinstance(c, str) else c).cast("string") for c in fields)), "\x01").alias("value"))
        one = R.parse_legacy(line, layout).select("tid", "lat", "lng", "ts", F.array_join("words", " ").alias("words"), "category", F.lit(layout).alias("layout"))
        out = one if out is None else out.unionByName(one)
    obj = F.struct(F.col("tid").alias("id"), "uid", F.lit("").alias("time"), F.col("ts").alias("timestamp"), "lat", "lng", F.col("raw").alias("text"), F.split("words", " ", -1).alias("phrases"))
    j = R.parse_json_posts(p.select(F.to_json(obj).alias("value")))
    return out.unionByName(j.select("tid", "lat", "lng", "ts", F.array_join("words", " ").alias("words"), F.lit(None).cast("string").alias("category"), F.lit("json").alias("layout")))


@query("SELECT DISTINCT tid, lat, lng FROM tweet WHERE tid IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
def a5_locations(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tweet").where("tid is not null and lat is not null and lng is not null").select("tid", L.location(F.concat_ws(",", "lat", "lng")).alias("at")).distinct()
    return t.select("tid", "at.lat", "at.lng")


@query(f"WITH {POST}, {TOK} SELECT tid, array_to_string(list(word ORDER BY pos), ' ') AS words FROM tok WHERE len(word) > 5 GROUP BY tid")
def b1_tagged_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens with a tag of the set; the tag here is the token's length class."""
    tag = F.transform(tokens("words"), lambda w: F.struct(w.alias("token"), F.when(F.length(w) > 5, "N").otherwise("O").alias("tag")))
    t = posts(spark, sf, "words").select("tid", T.filter_by_tag(tag, ["N"]).alias("t")).where(F.size("t") > 0)
    return t.select("tid", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("words"))


@query(f"""WITH {POST}, {TOK}, k AS (SELECT tid, word, min(pos) AS p FROM tok WHERE len(word) > 5 GROUP BY tid, word UNION ALL SELECT tid, word, 1000000 + min(pos) FROM tok WHERE word IN (SELECT word FROM vocab) AND len(word) <= 5 GROUP BY tid, word)
SELECT tid, array_to_string(list(word ORDER BY p), ' ') AS words FROM k GROUP BY tid""")
def b2_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens with a tag of the set, then the entities (here short words of the vocabulary), each once."""
    t = R.post_tokens(spark, sf).select("tid", "pos", F.col("word").alias("token"), F.when(F.length("word") > 5, "N").otherwise("O").alias("tag"))
    short = table(spark, sf, "vocab").where("length(word) <= 5").select(F.col("word").alias("token")).distinct()
    e = t.join(F.broadcast(short), "token", "left_semi").select("tid", "pos", F.col("token").alias("entity"))  # a fixed vocabulary
    return PM.keywords(t, ["N"], e).select("tid", F.array_join("words", " ").alias("words"))


@query("SELECT DISTINCT tid, epoch_us(ingested_at) // 1000000 - 946857600 AS seconds FROM tweet WHERE tid IS NOT NULL AND ingested_at IS NOT NULL")
def g13_seconds_since_epoch(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tweet").where("tid is not null and ingested_at is not null")
    return t.select("tid", S.seconds_since_epoch(F.col("ingested_at").cast("timestamp")).alias("seconds")).distinct()


@query(f"""WITH p AS (SELECT DISTINCT tid, lat, lng, poi_lat AS y, poi_lng AS x FROM tweet WHERE tid IS NOT NULL AND lat BETWEEN -90 AND 90 AND poi_lat BETWEEN -90 AND 90 AND abs(lng) <= 180 AND abs(poi_lng) <= 180 AND NOT isnan(lat) AND NOT isnan(lng) AND NOT isnan(poi_lat) AND NOT isnan(poi_lng))
SELECT tid, round(sqrt((lat - y) * (lat - y) + (lng - x) * (lng - x)), 6) AS planar, round(2 * 6373.0 * asin(sqrt(least(1.0, pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lng) / 2), 2)))), 5) AS km FROM p""")
def g17_distance_to_place(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tweet").where("tid is not null and lat between -90 and 90 and poi_lat between -90 and 90 and abs(lng) <= 180 and abs(poi_lng) <= 180 and not isnan(lat) and not isnan(lng) and not isnan(poi_lat) and not isnan(poi_lng)")
    t = t.select("tid", "lat", "lng", "poi_lat", "poi_lng").distinct()
    at = [F.col(c) for c in ("lat", "lng", "poi_lat", "poi_lng")]
    return t.select("tid", F.round(S.euclidean(*at), 6).alias("planar"), F.round(S.haversine_km(*at), 5).alias("km"))


# texts


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?,;:''\[\]]'), lambda s: trim(s, ' ') <> ''))::BIGINT AS parts FROM documents WHERE text IS NOT NULL""")
def g5_sentence_parts_kept(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.split_sentences_kept("text")).cast("bigint").alias("parts"))


@query("SELECT doc_id, len(list_filter(string_split(text, ' '), lambda s: s <> ''))::BIGINT AS pieces, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS line FROM documents WHERE text IS NOT NULL")
def g9_pieces_and_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.split_by("text", " ")).cast("bigint").alias("pieces"), T.clean_line("text").alias("line"))


# bins and queries


_ASKED = "asked AS (SELECT DISTINCT query_id, bin_id, nth FROM (SELECT query_id, unnest(query_bin_list) AS bin_id, unnest(range(0, len(query_bin_list))) AS nth FROM candidates WHERE query_id IS NOT NULL))"


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "candidates").where("query_id is not null").select("query_id", F.col("query_bin_list").alias("bins")).distinct()


@query(f"WITH RECURSIVE {_BINS}, {_ASKED} SELECT query_id, bin_id, nth::BIGINT AS nth, tid FROM binned JOIN asked USING (bin_id)")
def c3_posts_of_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The posts of every bin of every query."""
    q = L.bins_of_queries(B.anchored_bins(posts(spark, sf, "ts")), _queries(spark, sf))
    return q.select("query_id", "bin_id", F.col("nth").cast("bigint").alias("nth"), "tid").distinct()


@query(f"WITH RECURSIVE {_BINS}, {_ASKED}, {_M}, k AS (SELECT DISTINCT query_id, tid, candidate_id AS cluster_id FROM m) SELECT DISTINCT binned.tid, query_id, bin_id, cluster_id FROM binned JOIN asked USING (bin_id) JOIN k USING (query_id, tid)")
def c2_posts_with_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The posts of every query with the cluster they are in, candidates taken as clusters; joined by key, not by position."""
    q = L.bins_of_queries(B.anchored_bins(posts(spark, sf, "ts")), _queries(spark, sf))
    k = _members(spark, sf).select("query_id", "tid", F.col("candidate_id").alias("cluster_id")).distinct()
    return L.with_clusters(q, k).select("tid", "query_id", "bin_id", "cluster_id").distinct()


@query(f"WITH RECURSIVE {_BINS} SELECT bin_id, count(*) AS n FROM binned WHERE bin_id < (SELECT max(bin_id) FROM binned) GROUP BY bin_id")
def a19_manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    return L.parse_manifest(L.manifest_lines(B.manifest(B.anchored_bins(posts(spark, sf, "ts"))), 48))


@query(f"WITH RECURSIVE {_BINS}, f AS (SELECT bin_id, min(ts) AS ts FROM binned GROUP BY bin_id), w AS (SELECT bin_id FROM f WHERE bin_id >= 4 AND bin_id <= (SELECT max(bin_id) FROM f) - 6 AND ts % 86400 BETWEEN 39600 AND 79200) SELECT unnest(range(bin_id, bin_id + 6))::INTEGER AS bin_id, bin_id AS start FROM w")
def a11_query_file(spark: SparkSession, sf: str) -> DataFrame:
    """Windows written as lines of bins in order of their first, parsed again."""
    w = B.query_windows(B.anchored_bins(posts(spark, sf, "ts")), 4, 6)
    q = R.query_lines(_lines(L.query_text(w)))
    first = q.groupBy("query_id").agg(F.min("bin_id").cast("bigint").alias("start"))
    return q.join(first, "query_id").select("bin_id", "start")


# candidates


@query("SELECT DISTINCT candidate_id, query_id, len(query_bin_list)::INTEGER AS bins, len(members)::INTEGER AS members, list_sum(list_transform(members, lambda m: m.tweet_id))::BIGINT AS tids FROM candidates WHERE members IS NOT NULL AND query_bin_list IS NOT NULL")
def a15_candidate_file(spark: SparkSession, sf: str) -> DataFrame:
    c = L.parse_candidates(L.candidate_lines(table(spark, sf, "candidates").where("members is not null and query_bin_list is not null")))
    total = F.aggregate("members", F.lit(0).cast("bigint"), lambda s, m: s + m["tweet_id"])
    return c.select("candidate_id", "query_id", F.size("query_bin_list").alias("bins"), F.size("members").alias("members"), total.alias("tids")).distinct()


@query("SELECT DISTINCT candidate_id, spatial_unusualness, temporal_unusualness, st_unusualness, lat_std, lng_std, time_std, semantic_std, spatial_burstiness FROM candidate_features WHERE candidate_id IS NOT NULL")
def a30_feature_file(spark: SparkSession, sf: str) -> DataFrame:
    """Features in their file, parsed again; the rows are told apart by value, but keep the sign of a zero, which distinct drops."""
    f = L.parse_features(L.feature_lines(table(spark, sf, "candidate_features").where("candidate_id is not null")))
    return f.withColumn("_row", F.struct(*f.columns)).dropDuplicates(f.columns).select("_row.*")


@query("SELECT DISTINCT candidate_id FROM candidate_labels WHERE label = 1")
def a17_true_events(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates labelled 1, from the label file."""
    lab = table(spark, sf, "candidate_labels").select(F.concat_ws("\t", "candidate_id", F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("value"))
    return L.true_events(L.parse_labels(lab))


@query("SELECT candidate_id, label FROM candidate_labels WHERE candidate_id IS NOT NULL")
def a16_label_file(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "candidate_labels").where("candidate_id is not null").select(F.concat(F.col("candidate_id").cast("string"), F.lit("\t"), F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("value"))
    return L.parse_labels(lab)


@query(f"WITH {_KEPT} SELECT candidate_id, count(*) AS size, least(count(*), 3) AS posts FROM kept GROUP BY candidate_id")
def h47_candidate_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate's size and the number of posts that describe it, from the description file."""
    m = C.keep_nonzero(_with_vectors(spark, sf))
    said = C.members(table(spark, sf, "candidates")).select("candidate_id", "tid", "message").distinct()
    said = said.join(m.select("candidate_id", "tid"), ["candidate_id", "tid"], "left_semi")
    lines = L.description_lines(C.top_members(m, DIM, 3), said)
    d = lines.select(F.from_json("value", "candidate_id bigint, size bigint, posts array<string>").alias("d"))
    return d.select("d.candidate_id", "d.size", F.size("d.posts").cast("bigint").alias("posts"))


@query("""WITH f AS (SELECT DISTINCT candidate_id, st_unusualness FROM candidate_features WHERE st_unusualness IS NOT NULL AND NOT isnan(st_unusualness)), l AS (SELECT DISTINCT candidate_id, label FROM candidate_labels WHERE label IS NOT NULL),
j AS (SELECT label, CASE WHEN st_unusualness < 0.2 THEN 1 ELSE 0 END AS p FROM f JOIN l USING (candidate_id)), c AS (SELECT sum(CASE WHEN p = 1 AND label = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p = 1 AND label = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN p = 0 AND label = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS fn FROM j)
SELECT 'threshold' || chr(9) || printf('%.4f', tp / (tp + fp)) || chr(9) || printf('%.4f', tp / (tp + fn)) || chr(9) || printf('%.4f', 2 * tp / (2 * tp + fp + fn)) AS value FROM c""")
def a31_metric_file(spark: SparkSession, sf: str) -> DataFrame:
    return L.metric_lines(d23_prf1(spark, sf).withColumn("method", F.lit("threshold")))


@query("SELECT label::INTEGER AS label, CASE WHEN label = 1 THEN count(*) ELSE least(count(*), (SELECT count(*) FROM (SELECT DISTINCT candidate_id, label FROM candidate_labels) WHERE label = 1)) END AS n FROM (SELECT DISTINCT candidate_id, label FROM candidate_labels) WHERE label IS NOT NULL GROUP BY label")
def d36_balanced_classes(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "candidate_labels").distinct()
    return balanced(lab, "label", "candidate_id").groupBy("label").agg(F.count("*").alias("n"))


# graph, vectors, words, phrases


@query(f"WITH {_V} SELECT tid, round(x[1], 5) AS first, round(x[48], 5) AS last FROM v")
def a18_window_file(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and two coordinates in a window file, parsed again; the post's number stands for a coordinate."""
    v = vectors(table(spark, sf, "post_embedding"), DIM, "spatial_embedding", "temporal_embedding", "textual_embedding")
    w = L.parse_window(L.window_lines(v.select(F.col("textual_embedding").alias("vec"), F.col("tid").cast("decimal(20,0)").alias("lat"), F.lit(0.5).alias("lng"))), DIM)
    return w.select(F.col("lat").cast("bigint").alias("tid"), F.round(F.get("vec", F.lit(0)), 5).alias("first"), F.round(F.get("vec", F.lit(47)), 5).alias("last"))


@query("SELECT label::INTEGER AS cluster_id, count(*) AS n FROM embeddings GROUP BY label")
def a13_membership_file(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.slice("embedding", 1, 3).alias("scores"), F.col("label").alias("cluster_id"))
    return L.parse_membership(_lines(L.membership_lines(e))).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query(f"WITH {POST}, {PLACE} SELECT {CELL}::VARCHAR AS word, count(*) AS cnt FROM place GROUP BY 1")
def a34_grid_file(spark: SparkSession, sf: str) -> DataFrame:
    """Cells and their posts written as counts and parsed again."""
    c = posts(spark, sf, "lat", "lng", located=True).select(_cell().alias("cell")).groupBy("cell").agg(F.count("*").alias("cnt"))
    return L.parse_counts(L.count_lines(c, "cell"))


@query(f"WITH {POST}, {PLACE}, c AS (SELECT word, cell, count(DISTINCT tid) AS n FROM (SELECT tid, {CELL} AS cell, unnest(list_filter(string_split(words, ' '), lambda y: y <> '')) AS word FROM place) GROUP BY word, cell) SELECT word, cell, n FROM c")
def d40_distribution_file(spark: SparkSession, sf: str) -> DataFrame:
    """Every word's distribution over cells, written as an object a word and read again."""
    p = posts(spark, sf, "lat", "lng", "words", located=True).select("tid", _cell().alias("cell"), F.explode(tokens("words")).alias("word"))
    return L.parse_distribution(L.distribution_lines(p.distinct().groupBy("word", "cell").agg(F.count("*").alias("n"))))


@query(f"WITH {POST}, {TOK}, c AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word) SELECT row_number() OVER (ORDER BY cnt DESC, word) AS pos, word || ' ' || cnt AS line FROM c ORDER BY cnt DESC, word LIMIT 20")
def e19_top_words(spark: SparkSession, sf: str) -> DataFrame:
    return top_lines(d1_word_counts(spark, sf), "word", "cnt", 20)


@query(f"WITH {_GRAPH}, known AS (SELECT word FROM vocab) SELECT etype, u, v, weight::DOUBLE AS weight FROM edges WHERE etype = 'ww' AND u IN (SELECT word FROM known) AND v IN (SELECT word FROM known)")
def a23_edge_file(spark: SparkSession, sf: str) -> DataFrame:
    """Word pairs written as an edge file and parsed again, edges with an unknown end left out."""
    e = cooccurrence_edges(_nodes(spark, sf), ["ww"]).where("not contains(u, '\t') and not contains(v, '\t')")
    return L.parse_edges(L.edge_lines(e), table(spark, sf, "vocab").select(F.col("word").alias("node")))


@query("SELECT vec_id::VARCHAR AS node, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS l2 FROM embeddings")
def a24_vector_file(spark: SparkSession, sf: str) -> DataFrame:
    v = L.parse_vectors(L.vector_lines(table(spark, sf, "embeddings"), "vec_id", "embedding"), 64)
    return v.select("node", F.round(S.norm2("vec"), 4).alias("l2"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, list_sum(list_transform(embedding, lambda x: CASE WHEN abs(x) <= 1e-8 THEN 0 WHEN x > 0 THEN 1 ELSE -1 END))::BIGINT AS signs FROM embeddings")
def g35_literal_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as lists in text, parsed again."""
    v = table(spark, sf, "embeddings").select("vec_id", L.literal_list(L.list_text("embedding")).alias("v"))
    signs = F.aggregate(F.transform("v", lambda x: S.sign(x)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), signs.alias("signs"))


@query(f"WITH {POST}, {TOK} SELECT word, count(*) AS cnt FROM tok WHERE NOT regexp_matches(word, '[\\n\\r]') GROUP BY word")
def a36_vocabulary_file(spark: SparkSession, sf: str) -> DataFrame:
    return L.parse_counts(L.count_lines(d1_word_counts(spark, sf).where("not (word rlike '[\\n\\r]')")))


@query(f"WITH {_GRAMS} SELECT lower(phrase) AS phrase, cnt::DOUBLE AS cnt FROM gram WHERE phrase NOT LIKE '%,%'")
def a21_phrase_file(spark: SparkSession, sf: str) -> DataFrame:
    g = d27_frequent_ngrams(spark, sf).where("not contains(phrase, ',')")
    return L.parse_phrases(L.phrase_lines(g, "cnt"), "cnt")
