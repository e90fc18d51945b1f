import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import scalar as S
from geoloom.functions import text as T
from geoloom.operators import bins as B
from geoloom.operators import clustering, embedding, evaluate, graph, mixture, phrases, quality, words, wordvectors
from geoloom.sources import posts as src


def test_grid(spark):
    r = spark.createDataFrame([(90.0, 1.0), (100.0, 100.0)], "x double, y double").select(
        S.raw_cell([S.grid_index(F.col("x"), 0, 100, 10), S.grid_index(F.col("y"), 0, 100, 10)], [10, 10]).alias("c")
    ).select("c", S.cell_centre(F.col("c"), 0, [10, 10], 0, 100).alias("x"), S.cell_centre(F.col("c"), 1, [10, 10], 0, 100).alias("y"))
    assert [tuple(x) for x in r.collect()] == [(9, 95.0, 5.0), (99, 95.0, 95.0)]


def test_time_and_kernel(spark):
    r = spark.sql("select explode(array(39599L, 39600L, 79200L, 79201L)) t").select(S.is_proper_time(F.col("t")).alias("p"), S.clock(F.col("t")).alias("c"))
    assert [(x.p, x.c) for x in r.collect()] == [(False, "10:59:59"), (True, "11:00:00"), (True, "22:00:00"), (False, "22:00:01")]
    k = spark.sql("select explode(array(0D, 2D, 2.02D)) u").select(F.round(S.kernel(F.col("u"), 2.0), 6).alias("k"))
    assert [x.k for x in k.collect()] == [1.0, 0.606531, 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(S.cosine("a", "b").alias("c"), S.cosine("a", "b", 0.0).alias("z"), S.unit("a").alias("u"), S.norm1("a").alias("n"), S.to_distribution("a").alias("d")).collect()
    assert r[0].c == pytest.approx(0.96) and r[1].c is None and r[1].z == 0.0 and r[0].u == [0.6, 0.8] and r[1].u == [0.0, 0.0] and r[0].n == 7.0 and r[1].d is None
    s = spark.sql("select array('a','c') p, array('a','b','c') w").select(S.is_subsequence(F.col("p"), F.col("w")).alias("x"), S.is_subsequence(F.col("w"), F.col("p")).alias("y")).first()
    assert (s.x, s.y) == (True, False)


def test_anchored_bins(spark, got):
    minutes = [0, 10, 30, 31, 61, 62]
    df = spark.createDataFrame([(i, m * 60) for i, m in enumerate(minutes)] + [(9, None)], "tid int, ts bigint")
    b = B.anchored_bins(df)
    assert [x[1] for x in got(b.select("tid", "bin_id"))] == [0, 0, 0, 1, 1, 2]
    assert got(B.manifest(b)) == [(0, 3), (1, 2)]
    assert B.anchored_bins(df.limit(0)).isEmpty()
    w = spark.createDataFrame([(i, 40_000 + i) for i in range(10)], "bin_id bigint, ts bigint")
    assert [r.start_bin for r in B.query_windows(w, 4, 6).collect()] == []
    assert [r.bins for r in B.query_windows(w, 3, 6).collect()] == [[3, 4, 5, 6, 7, 8]]
    assert B.sample_windows(B.query_windows(w, 2, 6), 5, 1).count() == 5


def test_localness_and_tfidf(spark):
    t = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "x", 2), (4, "x", 3)], "tid int, word string, cell int")
    r = words.cell_spread(t).first()
    assert (round(r.entropy, 6), round(r.localness, 6)) == (1.039721, 0.346574)
    t = spark.createDataFrame([(1, "data"), (1, "mining"), (2, "data"), (2, "base")], "tid int, word string")
    s = {r.word: r.score for r in words.tfidf(t, 2).collect()}
    assert s["mining"] == pytest.approx(0.173287, abs=1e-6) and s["data"] == pytest.approx(5e-11)


def test_edges(spark, got):
    n = spark.createDataFrame([(1, "1", "2", None, ["x", "y", "x"])], "tid int, l string, t string, c string, words array<string>")
    e = {(r.etype, r.u, r.v): r.weight for r in graph.cooccurrence_edges(n).collect()}
    assert e[("lt", "1", "2")] == 1 and e[("wl", "x", "1")] == 2 and e[("wl", "y", "1")] == 1 and e[("ww", "x", "y")] == 2 and e[("ww", "y", "x")] == 2 and ("ww", "x", "x") not in e
    d = {(r.etype, r.node): (r.out_weight, r.in_weight) for r in graph.degrees(graph.cooccurrence_edges(n)).collect()}
    assert d[("ww", "x")] == (2, 2)


def test_rank_metrics(spark):
    s = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (1, 0.9, False), (1, 0.1, False), (2, 0.3, True)], "c int, s double, t boolean")
    assert {r.c: r["rank"] for r in evaluate.mid_rank(s, "c", "s", "t").collect()} == {1: 2.5, 2: 1.0}
    r = evaluate.rank_metrics(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "rank double")).first()
    assert (r.mrr, r.mean_rank) == (0.5833, 2.3333)


def test_text(spark):
    df = spark.createDataFrame([("I (we) like A.B",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.phrase_tokens("t")).collect()] == [["i", "like", "a", "$", "b"], None, []]
    assert df.select(T.parse_words("t", 1)).first()[0] == ["i", "we", "like", "a", "b"]
    assert spark.createDataFrame([("a [b c] d [e]",)], "t string").select(T.bracket_offsets("t")).first()[0] == [(2, 5), (8, 9)]
    assert spark.createDataFrame([("[[a|b]] <i>x</i> {{t}} &amp; y",)], "t string").select(T.strip_markup("t")).first()[0].split() == ["b", "x", "y"]


def test_phrases(spark, got):
    r = spark.createDataFrame([(["a", "b", "a", "b", "$", "a", "b"],)], "w array<string>")
    assert got(phrases.frequent_ngrams(r, "w", 4, 3).select("phrase", "cnt")) == [("a", 3), ("a b", 3), ("b", 3)]
    costs = {"data": math.log(0.2), "mining": math.log(0.1), "data mining": math.log(0.05)}
    s = spark.createDataFrame([(["data", "mining"],), ([],), (None,)], "w array<string>").select(phrases.segment(F.col("w"), costs, 2.0))
    assert [x[0] for x in s.collect()] == [["data mining"], [], None]
    sc = spark.createDataFrame([("a", "b", 250.0), ("b", "c", 250.0)], "a string, b string, score double")
    j = phrases.join_bigrams(spark.createDataFrame([(1, ["a", "b", "c", "b", "c"])], "tid int, w array<string>"), "w", sc, 100.0)
    assert j.first().words == ["a_b", "c", "b_c"]


def test_layouts(spark):
    line = "\x01".join(["1", "2", "3.5", "4.5", "t", "7.0", "a  b", "raw"])
    df = spark.createDataFrame([(line,), (line + "\x01p\x01\x01\x01Food\x01n",), ("bad",)], "value string")
    good = src.parse_clean(df, on_error="drop").collect()
    assert len(good) == 2 and good[0].words == ["a", "", "b"] and good[0].ts == 7 and good[1].poi_lat is None and good[1].category == "Food"
    with pytest.raises(Exception):
        src.parse_clean(df).collect()
    tags = spark.createDataFrame([(0, "a\tN\t0.9"), (1, ""), (2, "b\tV\tx"), (3, "c\tN\t1")], "line_no bigint, value string")
    assert [tuple(r) for r in src.parse_tagged(tags).orderBy("post_no", "pos").collect()] == [(0, 1, "a", "N", 0.9), (1, 1, "b", "V", None), (1, 2, "c", "N", 1.0)]


def test_mixture_statistics():
    p = mixture.Params()
    n, m, s = mixture.add_point(p, 0, np.zeros(2), np.eye(2) * 0.01, np.array([1.0, 2.0]))
    assert np.allclose(m, [2 / 3, 4 / 3]) and np.allclose(s, [[0.343333, 0.666667], [0.666667, 1.343333]], atol=1e-6)
    n, m, s = mixture.add_point(p, n, m, s, np.array([1.0, 2.0]), -1)
    assert np.allclose(m, 0) and np.allclose(s, np.eye(2) * 0.01)
    assert round(mixture.empty_weight(p, 0), 6) == 2.708004
    for nu, x in ((0.0, 1.0), (0.5, 3.0), (23.0, 100.0), (31.0, 500.0)):
        a = np.linspace(0, math.pi, 200_001)
        f = x * np.cos(a) + 2 * nu * np.log(np.maximum(np.sin(a), 1e-300))
        top = f.max()
        want = nu * math.log(x / 2) - 0.5 * math.log(math.pi) - math.lgamma(nu + 0.5) + top + math.log(np.trapezoid(np.exp(f - top), a))
        assert abs(mixture.log_bessel(nu, np.array([x]))[0] - want) < 1e-4


def test_mixture_separates_groups(spark):
    rng = np.random.default_rng(0)
    data = []
    for k in range(3):
        c = rng.standard_normal(16)
        data += [(1, k * 100 + i, float(k + 0.01 * rng.standard_normal()), float(k), [float(x) for x in c + 0.05 * rng.standard_normal(16)]) for i in range(20)]
    df = spark.createDataFrame(data, "q int, tid bigint, lat double, lng double, vec array<double>")
    z = {r.tid: r.cluster_id for r in mixture.cluster_windows(df, "q", clusters=8, sweeps=15).collect()}
    assert all(len({z[k * 100 + i] for i in range(20)}) == 1 for k in range(3)) and len(set(z.values())) == 3


def test_alias_table_and_embedding(spark):
    p, a = embedding.alias_table(np.array([1.0, 3.0, 0.0, -1.0]))
    freq = np.bincount(embedding.draw((p, a), 40_000, np.random.default_rng(0)), minlength=4) / 40_000
    assert abs(freq[1] - 0.75) < 0.02 and freq[2] == freq[3] == 0
    e = [("ww", f"a{i}", f"a{j}", 5) for i in range(5) for j in range(5) if i != j] + [("ww", f"b{i}", f"b{j}", 5) for i in range(5) for j in range(5) if i != j]
    v = {r.node: np.array(r.vec) for r in embedding.fit(spark.createDataFrame(e, "etype string, u string, v string, weight bigint"), dim=8, rounds=2, samples=200.0, alpha=0.1).collect()}
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert cos(v["w:a0"], v["w:a1"]) > cos(v["w:a0"], v["w:b1"])


def test_mean_shift(spark):
    rng = np.random.default_rng(0)
    x = [float(v) for c, n in ((100, 60), (500, 40)) for v in c + 5 * rng.standard_normal(n)]
    m = clustering.mean_shift(spark.createDataFrame([(v,) for v in x], "s double"), ["s"], 40.0).orderBy("id").collect()
    assert len(m) == 2 and abs(m[0].s - 100) < 3 and abs(m[1].s - 500) < 3 and m[0].n == 60


def test_mean_shift_ends_settled(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random((3000, 2)) * [0.5, 0.2], rng.random((400, 2)) * 0.05])
    m = np.array([(r.lat, r.lng, r.n) for r in clustering.mean_shift(spark.createDataFrame(x.tolist(), "lat double, lng double"), ["lat", "lng"], 0.01).collect()])
    g: dict = {}
    for p in x:
        g.setdefault(tuple(np.floor(p / (0.01 / 20))), []).append(p)
    c, n = np.array([np.mean(p, 0) for p in g.values()]), np.array([len(p) for p in g.values()])

    def shift(a):
        near = ((c - a) ** 2).sum(1) <= 0.01**2
        return (c[near] * n[near, None]).sum(0) / n[near].sum()

    assert max(np.linalg.norm(shift(a) - a) for a in m[:, :2]) < 0.01 / 100
    cell = np.floor(c / 0.01).astype(int)
    ends = []
    for k in np.unique(cell, axis=0):  # every seed on its own, over all rows
        at = (cell == k).all(1)
        a = (c[at] * n[at, None]).sum(0) / n[at].sum()
        while np.linalg.norm((b := shift(a)) - a) >= 0.01 / 1000:
            a = b
        ends.append((int(n[((c - a) ** 2).sum(1) <= 0.01**2].sum()), *b.round(9)))
    kept: list = []
    for e in sorted(set(ends), key=lambda e: (-e[0], e[1:])):
        if all((e[1] - k[1]) ** 2 + (e[2] - k[2]) ** 2 > 0.01**2 for k in kept):
            kept.append(e)
    assert sorted(k[0] for k in kept) == sorted(m[:, 2].astype(int))


def test_phrases_up_to_six_words(spark, tmp_path):
    from geoloom.plans.phrases import d27_frequent_ngrams

    df = spark.createDataFrame([(i, "a b c d e f g") for i in range(20)] + [(20, "a b")], "tid bigint, words string")
    df.write.parquet(str(tmp_path / "tweet.parquet"))
    got = {r.phrase: (r.n, r.cnt) for r in d27_frequent_ngrams(spark, str(tmp_path)).collect()}
    assert got["a b"] == (2, 21) and got["a b c d e f"] == (6, 20) and max(n for n, _ in got.values()) == 6 and len(got) == 7 + 6 + 5 + 4 + 3 + 2


def test_parsers_take_every_text(spark, tmp_path):
    import re

    from geoloom.plans import posts as q

    texts = ["Hello, World! (x)", "Caf\u00e9 A1\nB-2; caf\u00e9.", "\u0130stanbul's 5\u212a", "\u4f60\u597d", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tid bigint, raw string").write.parquet(str(tmp_path / "tweet.parquet"))
    spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["en", "EN", "tr", None, "en", "en"]))], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    some = [(i, t) for i, t in enumerate(texts) if t is not None]
    clean = lambda t, keep="": re.sub(f"[^a-z{keep}]+", " ", t).strip(" ")
    assert {r[0]: r[1] for r in q.g1_parse_words(spark, str(tmp_path)).collect()} == {i: " ".join(w.lower() for w in re.findall("[0-9a-zA-Z]+", t) if len(w) >= 2) for i, t in some}
    assert {r[0]: r[1] for r in q.g10_normalize_phrase(spark, str(tmp_path)).collect()} == {i: clean(t.lower()) for i, t in some}
    parts = {i: sum(clean(s, "'") != "" for s in re.split('[.!?,;:()"\\[\\]]', t.lower())) for i, t in some}
    assert {r[0]: r[1] for r in q.g4_sentence_parts(spark, str(tmp_path)).collect()} == parts


def test_mixture_query_uses_the_full_model(monkeypatch, spark):
    import inspect

    from geoloom.plans import events

    seen = {}
    sign = inspect.signature(mixture.cluster_windows)

    def spy(*args, **kw):
        bound = sign.bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return spark.createDataFrame([], "query_id int, tid bigint, cluster_id int")

    monkeypatch.setattr(mixture, "cluster_windows", spy)
    empty = spark.createDataFrame([], "query_id int, tid bigint, lat double, lng double, textual_embedding array<double>")
    monkeypatch.setattr(events, "_with_vectors", lambda *_: empty)
    events.h12_mixture_clusters(spark, "")
    assert (seen["clusters"], seen["sweeps"]) == (200, 50)


def test_propagation_and_analogy(spark):
    s = spark.createDataFrame([("p q", 1.0), ("r s", 0.0)], "word string, score double")
    n = spark.createDataFrame([("p", "p q", 1.0), ("r", "r s", 1.0), ("the", "p q", 1.0)], "word string, near string, sim double")
    r = {x.word: x.score for x in quality.propagate(s, n, spark.createDataFrame([("the",)], "word string"), 0.5, 3).collect()}
    assert r["p q"] == 1.0 and r["p"] > 0.8 and r["r"] == 0.0 and r["the"] < 0.1
    v = spark.createDataFrame([("man", [1.0, 0.0]), ("king", [1.0, 1.0]), ("woman", [0.0, 0.1]), ("queen", [0.0, 1.0]), ("x", [-1.0, 0.0])], "word string, vec array<double>")
    assert wordvectors.analogy(v, "man", "king", "woman").first().word == "queen"


def test_streams_replay_like_the_batch(spark, tmp_path):
    from geoloom.streaming.bins import stream_anchored_bins

    data = [("k", i, m * 60) for i, m in enumerate([0, 10, 30, 31, 61, 62])]
    df = spark.createDataFrame(data, "uid string, tid bigint, ts bigint").withColumn("at", F.timestamp_seconds("ts"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_anchored_bins(s, "uid").writeStream.outputMode("append").format("memory").queryName("bins_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.bin_id for r in spark.table("bins_out").orderBy("tid").collect()] == [0, 0, 0, 1, 1, 2]


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p1_found" in e.queries()
