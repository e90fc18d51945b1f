"""Queries over posts: scans, words, grids, graph, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import scalar as S
from geoloom.functions import text as T
from geoloom.operators import bins as B
from geoloom.operators import graph as G
from geoloom.operators import words as W
from geoloom.sources.posts import post_tokens, posts
from geoloom.sources.tables import table, tokens, wrap_lng

QUERIES, ORACLES = {}, {}

#: Shared by the SQL: one row a tid, its tokens, its place.
POST = "post AS (SELECT DISTINCT tid, uid, lat, lng, created_at, ts, words, raw, category FROM tweet WHERE tid IS NOT NULL)"
TOK = "tok AS (SELECT tid, w AS word, i AS pos FROM (SELECT tid, unnest(list_filter(string_split(words, ' '), lambda x: x <> '')) AS w, unnest(range(1, len(list_filter(string_split(words, ' '), lambda x: x <> '')) + 1)) AS i FROM post))"
PLACE = "place AS (SELECT *, lng - 360 * floor((lng + 180) / 360) AS x FROM post WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND abs(lng) < 1e15 AND NOT (lat = 0 AND lng = 0))"
CELL = "(floor((lat + 90) * 20) * 7200 + floor((x + 180) * 20))::BIGINT"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _cell():
    return (F.floor((F.col("lat") + 90) * 20) * 7200 + F.floor((wrap_lng(F.col("lng")) + 180) * 20)).cast("bigint")


@query(f"WITH {POST} SELECT tid, uid, ts, coalesce(len(list_filter(string_split(words, ' '), lambda x: x <> '')), 0)::BIGINT AS n_words FROM post WHERE ts IS NOT NULL")
def a1_post_scan(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, "uid", "ts", "words").where("ts is not null").select("tid", "uid", "ts", F.when(F.col("words").isNull(), 0).otherwise(F.size(tokens("words"))).cast("bigint").alias("n_words"))


@query(f"WITH {POST} SELECT tid, ts % 86400 AS second, ts % 604800 AS week_second, floor((ts % 604800) / 86400)::BIGINT + 1 AS weekday, floor((ts % 86400) / 3600)::BIGINT AS hour, strftime(make_timestamp((ts % 86400) * 1000000), '%H:%M:%S') AS clock FROM post WHERE ts >= 0")
def a3_time_of_post(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts")
    return posts(spark, sf, "ts").where("ts >= 0").select("tid", S.seconds_of_day(t).alias("second"), S.seconds_of_week(t).alias("week_second"), S.weekday(t).alias("weekday"), S.hour(t).alias("hour"), S.clock(t).alias("clock"))


@query(f"WITH {POST} SELECT uid, count(*) AS n FROM post WHERE ts % 86400 BETWEEN 39600 AND 79200 GROUP BY uid")
def b8_proper_time(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, "uid", "ts").where(S.is_proper_time(F.col("ts"))).groupBy("uid").agg(F.count("*").alias("n"))


@query(f"WITH {POST} SELECT tid FROM post WHERE len(list_filter(string_split(words, ' '), lambda x: x <> '')) > 0")
def b4_nonempty_posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, "words").where(F.size(tokens("words")) > 0).select("tid")


@query(f"WITH {POST}, {PLACE}, s AS (SELECT avg(lat) AS ma, stddev_samp(lat) AS sa, avg(x) AS mo, stddev_samp(x) AS so FROM place) SELECT tid, round((lat - ma) / sa, 6) AS z_lat, round((x - mo) / so, 6) AS z_lng FROM place, s")
def d10_coordinate_zscore(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "lat", "lng", located=True).withColumn("x", wrap_lng(F.col("lng")))
    s = p.agg(F.avg("lat").alias("ma"), F.stddev_samp("lat").alias("sa"), F.avg("x").alias("mo"), F.stddev_samp("x").alias("so"))
    return p.crossJoin(F.broadcast(s)).select("tid", F.round((F.col("lat") - F.col("ma")) / F.col("sa"), 6).alias("z_lat"), F.round((F.col("x") - F.col("mo")) / F.col("so"), 6).alias("z_lng"))  # one row


@query(f"WITH {POST}, {PLACE} SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(x) AS lng_min, max(x) AS lng_max, min(ts) AS ts_min, max(ts) AS ts_max FROM place")
def d39_ranges(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "lat", "lng", "ts", located=True).withColumn("x", wrap_lng(F.col("lng")))
    return p.agg(*(f(c).alias(f"{n}_{k}") for c, n in (("lat", "lat"), ("x", "lng"), ("ts", "ts")) for f, k in ((F.min, "min"), (F.max, "max"))))


@query(f"WITH {POST}, {TOK} SELECT word, count(*) AS cnt FROM tok GROUP BY word")
def d1_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return W.word_counts(post_tokens(spark, sf))


@query(f"WITH {POST}, {TOK}, c AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word) SELECT word, cnt, (row_number() OVER (ORDER BY cnt DESC, word) - 1)::BIGINT AS rank FROM c QUALIFY rank BETWEEN 10 AND 499")
def d2_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return W.vocabulary(d1_word_counts(spark, sf), 10, 500)


@query(f"WITH {POST}, {TOK}, c AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word) SELECT CASE WHEN cnt <= 2 THEN 'infrequent' ELSE 'frequent' END AS kind, count(*) AS words, sum(cnt)::BIGINT AS occurrences FROM c WHERE cnt <= 2 OR cnt >= 100 GROUP BY 1")
def b5_b6_word_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = d1_word_counts(spark, sf)
    both = W.infrequent(c, 2).withColumn("kind", F.lit("infrequent")).unionByName(W.frequent(c, 100).withColumn("kind", F.lit("frequent")))
    return both.groupBy("kind").agg(F.count("*").alias("words"), F.sum("cnt").alias("occurrences"))


@query(f"WITH {POST}, {TOK}, c AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word) SELECT tid, count(*) AS kept FROM tok JOIN c USING (word) WHERE cnt > 2 AND cnt < 100 GROUP BY tid")
def b3_trimmed_posts(spark: SparkSession, sf: str) -> DataFrame:
    tok = post_tokens(spark, sf)
    keep = W.word_counts(tok).where((F.col("cnt") > 2) & (F.col("cnt") < 100)).select("word")
    return tok.join(keep, "word", "left_semi").groupBy("tid").agg(F.count("*").alias("kept"))


@query(f"""WITH {POST}, {TOK}, n AS (SELECT count(*) AS n FROM post), c AS (SELECT word, count(*) AS cnt, count(DISTINCT tid) AS df FROM tok GROUP BY word), s AS (SELECT sum(cnt) AS total FROM c)
SELECT word, round(cnt / total, 9) AS tf, round(greatest(ln(n / df), 1e-10), 6) AS idf, round(cnt / total * greatest(ln(n / df), 1e-10), 9) AS score FROM c, n, s""")
def d3_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    t = W.tfidf(post_tokens(spark, sf), posts(spark, sf).count())
    return t.select("word", F.round("tf", 9).alias("tf"), F.round("idf", 6).alias("idf"), F.round("score", 9).alias("score"))


@query(f"WITH {POST}, {TOK} SELECT word, tid, count(*) AS n FROM tok GROUP BY word, tid")
def d4_inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return W.inverted_index(post_tokens(spark, sf))


@query(f"""WITH {POST}, {PLACE}, c AS (SELECT least(floor(3600 * (lat + 90) / 180), 3599)::BIGINT + 3600 * least(floor(7200 * (x + 180) / 360), 7199)::BIGINT AS cell FROM place)
SELECT cell, count(*) AS n, round(-90 + 0.05::DOUBLE * (cell % 3600 + 0.5::DOUBLE), 6) AS centre_lat, round(-180 + 0.05::DOUBLE * (floor(cell / 3600) + 0.5::DOUBLE), 6) AS centre_lng FROM c GROUP BY cell""")
def g19_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a grid of 3,600 by 7,200 over the globe that hold posts, their posts and centres."""
    bins, x = [3600, 7200], wrap_lng(F.col("lng"))
    p = posts(spark, sf, "lat", "lng", located=True).select(S.raw_cell([S.grid_index(F.col("lat"), -90, 90, 3600), S.grid_index(x, -180, 180, 7200)], bins).alias("cell"))
    centre = [F.round(S.cell_centre(F.col("cell"), i, bins, low, high), 6).alias(f"centre_{c}") for i, (c, low, high) in enumerate((("lat", -90, 90), ("lng", -180, 180)))]
    return p.groupBy("cell").agg(F.count("*").alias("n")).select("cell", "n", *centre)


@query(f"WITH {POST}, {PLACE}, c AS (SELECT {CELL} AS cell, count(*) AS cnt FROM place GROUP BY 1 HAVING count(*) >= 3) SELECT cell, cnt, (row_number() OVER (ORDER BY cnt DESC, cell) - 1)::BIGINT AS id FROM c")
def d8_grid_encode(spark: SparkSession, sf: str) -> DataFrame:
    c = posts(spark, sf, "lat", "lng", located=True).select(_cell().alias("cell")).groupBy("cell").agg(F.count("*").alias("cnt"))
    return W.encode(c, "cell", 3)


@query(f"WITH {POST}, {TOK}, c AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word HAVING count(*) >= 5) SELECT word, cnt, (row_number() OVER (ORDER BY cnt DESC, word) - 1)::BIGINT AS id FROM c")
def d9_word_encode(spark: SparkSession, sf: str) -> DataFrame:
    return W.encode(d1_word_counts(spark, sf), "word", 5)


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "lat", "lng", "words", located=True).select("tid", _cell().alias("cell"), F.explode(tokens("words")).alias("word"))
    return W.cell_spread(p)


_LOCAL = f"""{POST}, {PLACE}, cells AS (SELECT word, cell, count(DISTINCT tid) AS n FROM (SELECT tid, {CELL} AS cell, unnest(list_filter(string_split(words, ' '), lambda y: y <> '')) AS word FROM place) GROUP BY word, cell),
local AS (SELECT word, sum(n)::BIGINT AS freq, count(*) AS n_cells, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM cells GROUP BY word)"""


@query(f"WITH {_LOCAL} SELECT word, freq, n_cells, round(entropy, 6) AS entropy, round(ln(least(freq, 40000)) - entropy, 6) AS localness FROM local")
def d7_word_localness(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(spark, sf).select("word", "freq", "n_cells", F.round("entropy", 6).alias("entropy"), F.round("localness", 6).alias("localness"))


_ACTIVE = f"""{_LOCAL}, scored AS (SELECT word, round(ln(least(freq, 40000)) - entropy, 6) AS localness FROM local WHERE freq >= 20), top AS (SELECT word, localness FROM scored QUALIFY row_number() OVER (ORDER BY localness DESC, word) <= (SELECT floor(count(*) * 0.3) FROM scored))"""


@query(f"WITH {_ACTIVE} SELECT word, localness FROM top")
def e3_activity_words(spark: SparkSession, sf: str) -> DataFrame:
    s = d7_word_localness(spark, sf).where("freq >= 20").select("word", "localness")
    return W.top_fraction(s, "localness", "word", 0.3)


@query(f"WITH {_ACTIVE}, {TOK} SELECT DISTINCT tid FROM tok JOIN top USING (word)")
def b7_activity_posts(spark: SparkSession, sf: str) -> DataFrame:
    return post_tokens(spark, sf).join(e3_activity_words(spark, sf).select("word"), "word", "left_semi").select("tid").distinct()


_CATS = ["Food", "Nightlife Spot", "Shop & Service", "Travel & Transport", "Arts & Entertainment", "College & University", "Outdoors & Recreation", "Professional & Other Places", "Residence"]


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "lat", "lng", "ts", "words", "category", located=True).where("ts is not null")
    return p.select("tid", _cell().alias("l"), S.hour(F.col("ts")).alias("t"), F.when(F.col("category").isin(*_CATS), F.col("category")).alias("c"), tokens("words").alias("words"))


_GRAPH = f"""{POST}, {PLACE}, node AS (SELECT tid, {CELL}::VARCHAR AS l, floor((ts % 86400) / 3600)::BIGINT::VARCHAR AS t,
  CASE WHEN category IN ({', '.join("'" + c + "'" for c in _CATS)}) THEN category END AS c, list_filter(string_split(words, ' '), lambda y: y <> '') AS ws FROM place WHERE ts IS NOT NULL),
one AS (SELECT tid, 'l' AS k, l AS x FROM node UNION ALL SELECT tid, 't', t FROM node UNION ALL SELECT tid, 'c', c FROM node WHERE c IS NOT NULL),
wrd AS (SELECT tid, 'w' AS k, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM node),
edge AS (SELECT a.k || b.k AS etype, a.x AS u, b.x AS v FROM one a JOIN one b ON a.tid = b.tid AND a.k <> b.k
  UNION ALL SELECT a.k || 'w', a.x, b.x FROM one a JOIN wrd b ON a.tid = b.tid UNION ALL SELECT 'w' || a.k, b.x, a.x FROM one a JOIN wrd b ON a.tid = b.tid
  UNION ALL SELECT 'ww', a.x, b.x FROM wrd a JOIN wrd b ON a.tid = b.tid AND a.x <> b.x),
edges AS (SELECT etype, u, v, count(*) AS weight FROM edge GROUP BY etype, u, v)"""


@query(f"WITH {_GRAPH} SELECT etype, u, v, weight FROM edges")
def h2_cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.cooccurrence_edges(_nodes(spark, sf))


@query(f"WITH {_GRAPH}, b AS (SELECT etype, u AS node, weight AS o, 0 AS i, 1 AS n FROM edges UNION ALL SELECT etype, v, 0, weight, 0 FROM edges) SELECT etype, node, sum(o)::BIGINT AS out_weight, sum(i)::BIGINT AS in_weight, sum(n)::BIGINT AS neighbours FROM b GROUP BY etype, node")
def d25_node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(h2_cooccurrence_edges(spark, sf))


@query(f"WITH {_GRAPH}, known AS (SELECT word FROM vocab) SELECT etype, count(*) AS edges, sum(weight)::BIGINT AS weight FROM edges WHERE etype = 'ww' AND u IN (SELECT word FROM known) AND v IN (SELECT word FROM known) GROUP BY etype")
def c9_known_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = G.known_edges(G.cooccurrence_edges(_nodes(spark, sf), ["ww"]), table(spark, sf, "vocab").select(F.col("word").alias("node")))
    return e.groupBy("etype").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


_CENTRE = "centre AS (SELECT poi_id AS id, lat, lng FROM poi WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng))"


@query(f"WITH {_CENTRE}, near AS (SELECT a.id AS u, b.id AS v, sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lng - b.lng) * (a.lng - b.lng)) AS d FROM centre a, centre b), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, v) AS r FROM near WHERE d <= 0.002) SELECT u, v, round(exp(-(d / 0.002) * (d / 0.002) / 2), 6) AS weight FROM r WHERE r <= 4 AND u <> v")
def h3_proximity_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "poi").where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").select(F.col("poi_id").alias("id"), "lat", "lng")
    return G.proximity_edges(c, ["lat", "lng"], 4, 0.002).withColumn("weight", F.round("weight", 6))


_BINS = f"""{POST}, sec AS (SELECT DISTINCT ts FROM post WHERE ts IS NOT NULL), nxt AS (SELECT ts, min(ts) OVER (ORDER BY ts RANGE BETWEEN 1801 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM sec),
chain AS (SELECT (SELECT min(ts) FROM sec) AS s, 0 AS bin_id UNION ALL SELECT nxt.n, chain.bin_id + 1 FROM chain JOIN nxt ON nxt.ts = chain.s WHERE nxt.n IS NOT NULL),
binned AS (SELECT p.tid, p.ts, c.bin_id::BIGINT AS bin_id, c.s AS bin_start FROM post p ASOF JOIN chain c ON p.ts >= c.s)"""


@query(f"WITH RECURSIVE {_BINS} SELECT tid, bin_id, bin_start FROM binned")
def f1_anchored_bins(spark: SparkSession, sf: str) -> DataFrame:
    return B.anchored_bins(posts(spark, sf, "ts")).select("tid", "bin_id", "bin_start")


@query(f"WITH RECURSIVE {_BINS} SELECT bin_id, count(*) AS n FROM binned WHERE bin_id < (SELECT max(bin_id) FROM binned) GROUP BY bin_id")
def d11_bin_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return B.manifest(f1_anchored_bins(spark, sf))


@query(f"WITH RECURSIVE {_BINS}, f AS (SELECT bin_id, min(ts) AS ts FROM binned GROUP BY bin_id) SELECT bin_id AS start_bin, bin_id + 5 AS last_bin FROM f WHERE bin_id >= 4 AND bin_id <= (SELECT max(bin_id) FROM f) - 6 AND ts % 86400 BETWEEN 39600 AND 79200")
def f2_query_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = B.query_windows(B.anchored_bins(posts(spark, sf, "ts")), 4, 6)
    return w.select("start_bin", F.element_at("bins", -1).alias("last_bin"))


@query(f"WITH RECURSIVE {_BINS}, n AS (SELECT bin_id, count(*) AS n FROM binned GROUP BY bin_id) SELECT bin_id, sum(n) OVER (ORDER BY bin_id RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM n")
def f3_sliding_bins(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = B.anchored_bins(posts(spark, sf, "ts")).groupBy("bin_id").agg(F.count("*").alias("n"))
    return n.select("bin_id", F.sum("n").over(Window.orderBy("bin_id").rangeBetween(-5, 0)).alias("in_window"))  # one row a bin


@query("WITH q AS (SELECT DISTINCT query_id, bin_id FROM (SELECT query_id, unnest(query_bin_list) AS bin_id FROM candidates WHERE query_id IS NOT NULL)) SELECT query_id, count(*) AS bins, min(bin_id) AS first_bin, max(bin_id) AS last_bin FROM q GROUP BY query_id")
def c3_query_bins(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "candidates").select("query_id", F.explode("query_bin_list").alias("bin_id")).where("query_id is not null").distinct()
    return q.groupBy("query_id").agg(F.count("*").alias("bins"), F.min("bin_id").alias("first_bin"), F.max("bin_id").alias("last_bin"))


@query(f"WITH {POST} SELECT tid, array_to_string(list_transform(list_filter(regexp_extract_all(raw, '[0-9a-zA-Z]+'), lambda x: len(x) >= 2), lambda x: lower(x)), ' ') AS parsed FROM post WHERE raw IS NOT NULL")
def g1_parse_words(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "raw").where("raw is not null")
    return p.select("tid", F.array_join(T.parse_words("raw"), " ").alias("parsed"))


#: The engines differ in the lower case of this letter: one point in one of them, two in the other.
_LOWER = "lower(replace(text, chr(304), 'i' || chr(775)))"


@query(f"SELECT doc_id, trim(regexp_replace({_LOWER}, '[^a-z]+', ' ', 'g')) AS phrase FROM documents WHERE text IS NOT NULL")
def g10_normalize_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.normalize_phrase("text").alias("phrase"))


@query(f"""SELECT doc_id, len(list_filter(list_transform(string_split_regex({_LOWER}, '[.!?,;:()"\\[\\]]'), lambda s: trim(regexp_replace(s, '[^a-z'']+', ' ', 'g'))), lambda s: s <> ''))::BIGINT AS sentences FROM documents WHERE text IS NOT NULL""")
def g4_sentence_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.split_sentences("text")).cast("bigint").alias("sentences"))


@query()
def g3_phrase_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.phrase_tokens("text"), " ").alias("tokens"))


def _g7() -> str:
    """The same steps in SQL; the other engine's class of blanks has one character fewer."""
    t = "text"
    for pattern, into in (
        (r"(?s)<ref[^>/]*>.*?</ref>", ""), (r"<[^>]*>", ""), (r"\[http[^\]\s\x0B]*[\s\x0B]?([^\]]*)\]", r"\1"), (r"(?i)\[\[(?:image|file|category)[^\]]*\]\]", ""),
        (r"\[\[[^|\]]*\|", "[["), (r"\{\{[^}]*\}\}", ""), (r"\{[^}]*\}", ""), (r"\[|\]", ""), (r"&[^;\s\x0B]*;", " "),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{into}', 'g')"
    t = f"lower(replace({t}, chr(304), 'i' || chr(775)))"
    for pattern, into in (("[’′]", "''"), ("''" * 2, " "), ("[“”]", '"'), ("([\"''.,()!?;:])", r" \1 "), ("[0-9]", " "), (r"[\s\x0B]+", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{into}', 'g')"
    return f"SELECT doc_id, trim({t}, ' ') AS text FROM documents"


@query(_g7())
def g7_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(T.strip_markup("text")).alias("text"))


@query(f"WITH {POST}, {PLACE}, {TOK} SELECT p.uid, count(DISTINCT t.word) AS words, count(DISTINCT p.tid) AS located FROM place p JOIN tok t USING (tid) GROUP BY p.uid")
def d13_user_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, "uid", "lat", "lng", "words", located=True).select("tid", "uid", F.explode(tokens("words")).alias("word"))
    return p.groupBy("uid").agg(F.countDistinct("word").alias("words"), F.countDistinct("tid").alias("located"))


@query(f"""WITH {POST}, {PLACE}, s AS (SELECT poi_id, lat AS y, lng AS x FROM poi WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)),
d AS (SELECT tid, poi_id, row_number() OVER (PARTITION BY tid ORDER BY (place.lat - y) * (place.lat - y) + (place.x - s.x) * (place.x - s.x), poi_id) AS r FROM place, s) SELECT tid, poi_id FROM d WHERE r = 1""")
def c10_nearest_centre(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of a fixed set of centres (planar degrees) for every located post."""
    from geoloom.operators.clustering import nearest_centre

    p = posts(spark, sf, "lat", "lng", located=True).select("tid", "lat", wrap_lng(F.col("lng")).alias("lng"))
    c = table(spark, sf, "poi").where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").select(F.col("poi_id").alias("id"), "lat", "lng")
    return nearest_centre(p, c, ["lat", "lng"]).select("tid", F.col("id").alias("poi_id"))
