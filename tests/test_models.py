import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import settings
from geoloom.functions import scalar as S
from geoloom.functions import text as T
from geoloom.operators import bins as B
from geoloom.operators import clustering, contexts, crossmodal, evaluate, graph, mixture, phrasemodel, phrases, quality, ranking, wordvectors
from geoloom.operators import candidates as C
from geoloom.sources import formats as L
from geoloom.sources import posts as R


# positions and greedy choice


def test_positions(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40), i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s int, k int, extra string")
    got = {r.k: r.pos for r in ranking.positions(df, [F.desc("s"), F.col("k").asc()]).collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    got = {r.k: r.pos for r in ranking.positions(df, [F.desc("s"), F.col("k").asc()], by="g").collect()}
    for g in ("a", "b", None):
        assert all(got[r[2]] == i + 1 for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))))
    assert sorted(r.k for r in ranking.first_rows(df, [F.desc("s"), F.col("k").asc()], 0.3).collect()) == sorted(r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))[:150])
    assert ranking.positions(df.limit(0), [F.desc("s")]).isEmpty() and ranking.first_rows(df.limit(0), [F.desc("s")], 0.5).isEmpty()


def test_strongest_first(spark):
    rng = random.Random(1)
    n = 120
    links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(200)}
    rank = {i: rng.random() for i in range(n)}
    kept: set = set()
    for i in sorted(range(n), key=rank.get):
        if not any(tuple(sorted((i, k))) in links for k in kept):
            kept.add(i)
    nodes = spark.createDataFrame(list(rank.items()), "node int, rank double")
    assert {r.node for r in ranking.strongest_first(nodes, spark.createDataFrame(list(links), "a int, b int")).collect()} == kept


def test_nearest_centre(spark):
    rng = np.random.default_rng(0)
    c = np.r_[rng.random((60, 2)), [[5.0, 5.0], [0.5, 0.5], [0.5, 0.5]]]
    x = np.r_[rng.random((300, 2)), rng.random((5, 2)) * 40 - 20, [[0.5, 0.5]]]
    pts = spark.createDataFrame([(i, *map(float, v), "e") for i, v in enumerate(x)], "tid int, lat double, lng double, id2 string")
    cs = spark.createDataFrame([(f"c{i:02}", *map(float, v)) for i, v in enumerate(c)] + [("zz", None, 1.0)], "id string, lat double, lng double")
    got = {r.tid: r.id for r in clustering.nearest_centre(pts, cs, ["lat", "lng"]).collect()}
    d = ((x[:, None] - c[None]) ** 2)
    assert got == {i: f"c{int((d[i, :, 0] + d[i, :, 1]).argmin()):02}" for i in range(len(x))}
    assert {r.id for r in clustering.nearest_centre(pts, cs.limit(0), ["lat", "lng"]).collect()} == {None}
    one = clustering.nearest_centre(pts.select("tid", F.col("lat").alias("s")), cs.where("lat is not null").select("id", F.col("lat").alias("s")), ["s"]).collect()
    assert len(one) == len(x) and all(abs(c[int(r.id[1:]), 0] - r.s) <= abs(c[:, 0] - r.s).min() + 1e-12 for r in one)
    with pytest.raises(ValueError):
        clustering.nearest_centre(pts, cs, ["lat", "lng"], limit=3)


def test_nearest_of_many_centres(spark):
    rng = np.random.default_rng(8)
    where, at = rng.normal(0, 1, (200, 2)).tolist(), rng.normal(0, 1, (300, 2)).tolist() + [[50.0, -70.0], [0.0, 0.0]]
    cs = spark.createDataFrame([(i, *w) for i, w in enumerate(where)] + [(900, *where[0])], "id int, lat double, lng double")
    for pts in (at, at[:300]):
        df = spark.createDataFrame([(i, *w) for i, w in enumerate(pts)], "tid int, lat double, lng double")
        few, many = ({r.tid: r.id for r in clustering.nearest_centre(df, cs, ["lat", "lng"], broadcast=n).collect()} for n in (201, 5))
        assert few == many and len(many) == len(pts)
        assert all(many[i] == min(range(200), key=lambda k: (math.dist(where[k], w), k)) for i, w in enumerate(pts))
    cs = spark.range(100_001).selectExpr("id", "double(id) as s")
    assert {r.tid: r.id for r in clustering.nearest_centre(spark.createDataFrame([(1, 70_000.2), (2, -9e9)], "tid int, s double"), cs, ["s"]).collect()} == {1: 70_000, 2: 0}


# mixtures


def groups(n=20, dim=16, seed=0, keys=1):
    rng = np.random.default_rng(seed)
    out = []
    for q in range(keys):
        for k in range(3):
            c = rng.standard_normal(dim)
            out += [(q, k * 1000 + i, float(k + 0.01 * rng.standard_normal()), float(k), [float(x) for x in c + 0.05 * rng.standard_normal(dim)]) for i in range(n)]
    return out


def test_statistics_follow_points():
    p = mixture.Params(clusters=5)
    rng = np.random.default_rng(0)
    m = mixture.Mixture(p, 12, 0)
    x, d = rng.standard_normal((40, 12)), rng.standard_normal((40, 2))
    z = rng.integers(0, 5, 40)
    for i in range(40):
        m.put(x[i], d[i], z[i])
    n, mean, scatter = 0, np.zeros(2), np.eye(2) * p.delta0
    for i in np.flatnonzero(z == 2):
        n, mean, scatter = mixture.add_point(p, n, mean, scatter, d[i])
    assert n == m.count[2] and np.allclose(mean, m.place[:2, 2]) and np.allclose(scatter, m.scatter[2])
    plain = [np.array([f(d[z == k]) for k in range(5)]) for f in (lambda v: v.sum(0), lambda v: [(v[:, 0] ** 2).sum(), (v[:, 0] * v[:, 1]).sum(), (v[:, 1] ** 2).sum()])]
    a, b = mixture.scatter_of_sums(p, m.count, *plain)
    assert np.allclose(a, m.place[:2].T) and np.allclose(b, m.scatter)
    m.remove_batch(x, d, z)
    assert np.allclose(m.count, 0) and np.allclose(m.place[:2], 0) and np.allclose(m.s, m.prior) and m.nonempty == 0
    k = np.exp(np.linspace(-5, 12, 400))
    assert np.abs(mixture.log_norm(k, 48) - mixture.log_norm_by_table(k, 48)).max() < 1e-6
    assert set(mixture.PRESETS) == {"toy", "la", "ny", "text", "batch"} and mixture.PRESETS["la"].clusters == 600


def one_to_one(got, n=20):
    return all(len({got[k * 1000 + i] for i in range(n)}) == 1 for k in range(3)) and len(set(got.values())) == 3


def test_large_windows_are_swept_in_shards(spark):
    df = spark.createDataFrame(groups(30), "q int, tid bigint, lat double, lng double, vec array<double>")
    got = {r.tid: r.cluster_id for r in mixture.cluster_windows(df, "q", clusters=6, sweeps=12, split_rows=30).collect()}
    assert len(got) == 90 and one_to_one(got, 30)
    s = mixture.cluster_windows(df, "q", clusters=6, sweeps=1, split_rows=30, scores=True).first()
    assert len(s.scores) == 6
    assert mixture.cluster_windows(df.limit(0), "q").isEmpty()


def test_window_slides(spark):
    rows = [(q, b, b * 10_000 + t, y, x, v) for b in range(5) for q, t, y, x, v in groups(8)]
    df = spark.createDataFrame(rows, "q int, bin_id bigint, tid bigint, lat double, lng double, vec array<double>")
    for places in (True, False):
        p = mixture.Params(clusters=6, sweeps=12, places=places)
        got = mixture.slide_windows(df, "q", 3, p).collect()
        assert Counter(r.bin_id for r in got) == {2: 72, 3: 72, 4: 72}
        for b in (2, 3, 4):
            assert {r.tid // 10_000 for r in got if r.bin_id == b} == {b - 2, b - 1, b}
            of = {}
            for r in got:
                if r.bin_id == b:
                    of.setdefault(r.tid % 10_000 // 1000, set()).add(r.cluster_id)
            assert all(len(v) == 1 for v in of.values()) and len(set.union(*of.values())) == 3
    assert mixture.slide_windows(df.where("bin_id < 2"), "q", 3, p).isEmpty()


def test_every_bin_has_its_window(spark):
    from geoloom.plans.models import _streams

    rows = [(b, b * 10_000 + t, y, x, v) for b in range(10) if b not in (0, 5) for _, t, y, x, v in groups(3)] + [(b, b, 0.0, 0.0, None) for b in (0, 5)]
    df = _streams(spark.createDataFrame(rows, "bin_id bigint, tid bigint, lat double, lng double, vec array<double>"), 3, 4)
    got = mixture.slide_windows(df, "stream", 3, mixture.Params(clusters=6, sweeps=3)).collect()
    assert len({(r.bin_id, r.tid) for r in got}) == len(got) and all(r.stream == r.bin_id // 4 for r in got)
    for b in range(10):
        want = {k for k in range(b - 2, b + 1) if k not in (0, 5)} if b >= 2 else set()
        assert {r.tid // 10_000 for r in got if r.bin_id == b} == want
        assert sum(r.bin_id == b for r in got) == 9 * len(want)


def test_compiled_loops_draw_the_same(spark):
    from geoloom.operators import native

    rows = groups(20)
    x, d = np.array([r[4] for r in rows]), np.array([r[2:4] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = native.compiled(spark)
    assert code
    for p in (mixture.Params(clusters=9, sweeps=4), mixture.Params(clusters=9, sweeps=4, places=False, kappa_low=0.5, log_walk=True, step=0.1)):
        found = []
        for compiled in (True, False):
            if compiled:
                native.ready(code)
            assert native.running() == compiled
            m = mixture.Mixture(p, x.shape[1], 5)
            z = m.first_fit(x, d)
            z = np.r_[z, m.add_batch(x[:20], d[:20])]
            m.remove_batch(x[:10], d[:10], z[:10])
            found.append((z, m.s, m.kappa, m.count, m.place, m.own, m.weight, m.length2, m.nonempty))
            native.stop()
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(*found))


def test_batch_and_em_raise_the_likelihood(spark):
    df = spark.createDataFrame(groups(25), "q int, tid bigint, lat double, lng double, vec array<double>")
    t = sorted((r.sweep, r.log_likelihood) for r in mixture.batch_mixture(df, "q", mixture.Params(clusters=5, sweeps=10, places=False)).collect())
    assert len(t) == 10 and t[-1][1] > t[0][1]
    out, trace = mixture.em_mixture(df, "vec", 16, 3, rounds=12, seed=3)
    assert all(b >= a - 1e-6 for a, b in zip(trace[1:], trace[2:])) and out.count() == 75 and set(out.columns) == {*df.columns, "cluster_id", "score"}
    assert mixture.em_mixture(df.limit(0), "vec", 16, 3)[0].isEmpty()


# cross-modal model


def test_cross_modal_model(spark):
    rng = random.Random(0)
    rows = []
    for i in range(160):
        a = i % 2
        rows.append((i, (10.0, 20.0)[a] + rng.uniform(-0.003, 0.003), 5.0 + rng.uniform(-0.003, 0.003), (30_000, 60_000)[a] + rng.randint(0, 300), [("sun", "beach")[rng.randint(0, 1)] if a else ("rain", "coat")[rng.randint(0, 1)], "rare"][: 1 + (i == 0)], ("Food", "Odd")[a]))
    p = spark.createDataFrame(rows, "tid bigint, lat double, lng double, ts bigint, words array<string>, category string")
    voc = spark.createDataFrame([("sun",), ("beach",), ("rain",), ("coat",)], "word string")
    m = crossmodal.fit_model(p, voc, dim=8, rounds=3, categories=["Food"])
    assert m["places"].count() == 2 and m["times"].count() == 2
    nodes = {r.node for r in m["vectors"].collect()}
    assert {"w:sun", "w:rain", "c:Food"} <= nodes and "w:rare" not in nodes and "c:Odd" not in nodes
    f = crossmodal.centre_features(p, "tid", ["lat", "lng"], m["places"], m["vectors"], "l", 8, 0.01)
    w = crossmodal.word_features(p.withColumn("words", F.when(F.col("tid") == 1, F.array(F.lit("none"))).otherwise(F.col("words"))), "tid", "words", m["vectors"], 8)
    assert f.count() == w.count() == 160 and w.where("tid = 1").first().feature == [0.0] * 8
    c = {r.tid: r.feature for r in crossmodal.category_features(p, "tid", "category", m["vectors"]).collect()}
    assert c[0] is not None and c[1] is None
    both = f.withColumnRenamed("feature", "l").join(w.withColumnRenamed("feature", "w"), "tid")
    ranks, metrics = crossmodal.evaluate_predictions(both, "tid", "w", ["l"], 5)
    assert ranks.count() == 160 and 1 <= metrics.first().mean_rank <= 6
    assert crossmodal.side("w", "w") == "vec" and crossmodal.side("l", "w") == "ctx" and crossmodal.side("l", "w", second_order=False) == "vec"
    near = crossmodal.neighbours_of(m["vectors"], spark.createDataFrame([("q", ["w:sun"]), ("p", ["w:sun", "w:beach"])], "query string, nodes array<string>"), "w", 2).collect()
    assert {(r["query"], r["rank"]) for r in near} == {("q", 1), ("q", 2), ("p", 1), ("p", 2)} and all(r.node not in ("w:sun",) for r in near)
    named = L.named_by_place(m["vectors"], m["places"], "l", ["lat", "lng"])
    assert {len(r.node.split(",")) for r in named.where("node like 'l:%'").collect()} == {2} and named.count() == m["vectors"].count()


def test_noise_pairs(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = crossmodal.noise_pairs(df, "k", 4).collect()
    assert len(got) == 200 and all(r.k != r.other for r in got) and Counter(r.k for r in got) == {k: 4 for k in range(50)}
    assert crossmodal.noise_pairs(df.limit(1), "k", 4).isEmpty()


def test_kernel_smoothing(spark):
    n = spark.createDataFrame([(1, 1, 0.5, [2.0, 0.0]), (1, 2, 0.25, [0.0, 4.0]), (2, 1, 0.0, [3.0, 3.0])], "k int, rank int, weight double, vec array<double>")
    from geoloom.operators.embedding import kernel_smoothed

    assert {r.k: r.vec for r in kernel_smoothed(n, "k", 2).collect()} == {1: [0.5, 0.5], 2: [3.0, 3.0]}


def test_edges_of_some_kinds(spark):
    rng = random.Random(2)
    rows = [(i, str(rng.randint(0, 3)), rng.choice([None, "5"]), None, [rng.choice("xyz") for _ in range(rng.randint(0, 5))]) for i in range(40)]
    n = spark.createDataFrame(rows, "tid int, l string, t string, c string, words array<string>")
    want: Counter = Counter()
    for _, *sides, words in rows:
        ends = [(k, s) for k, s in zip("ltc", sides) if s is not None]
        for a in ends:
            for b in ends:
                if a != b:
                    want[a[0] + b[0], a[1], b[1]] += 1
            for w in words:
                want[a[0] + "w", a[1], w] += 1
                want["w" + a[0], w, a[1]] += 1
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if i != j and a != b:
                    want["ww", a, b] += 1
    assert {(r.etype, r.u, r.v): r.weight for r in graph.cooccurrence_edges(n).collect()} == want
    assert {(r.etype, r.u, r.v): r.weight for r in graph.cooccurrence_edges(n, ["ww", "lt"]).collect()} == {k: v for k, v in want.items() if k[0] in ("ww", "lt")}


# phrases


def test_contexts(spark):
    texts = ['He said "data mining" twice. Data-Mining is (data mining), not data  mining; big Data Mining here', "no data here. mining data mining data mining!", None, "", "data"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    s = contexts.sentence_pieces(d, "id", "text")
    known = spark.createDataFrame([("data mining",), ("data",), ("mining data mining",)], "phrase string")
    found = contexts.occurrences(s, known, 3)
    n = {r.phrase: r.n for r in contexts.match_counts(s, known, 3).collect()}
    assert n == {"data mining": 6, "data": 9, "mining data mining": 2}
    f = {r.phrase: r for r in contexts.punctuation_features(found).collect()}["data mining"]
    assert (f.total, f.quote, f.dash, f.parenthesis) == (6, 1 / 6, 1 / 6, 1 / 6) and f.capital == 2 / 6
    p = spark.createDataFrame([("data", 0.1), ("mining", 0.2)], "word string, p double")
    idf = spark.createDataFrame([("data", 1.0), ("mining", 3.0)], "word string, idf double")
    got = {r.phrase: (r.outside, r.new_outside) for r in contexts.outside_features(s, known, p, idf, 3).collect()}
    # by hand, over sentences: counts of each word around against those of the phrase's own occurrences
    sents, per = [], {"data mining": [0, [0, 0], [0, 0]], "mining data mining": [0, [0, 0, 0], [0, 0, 0]]}
    for t in texts:
        sents.append([x for x in re.split(r"[.!?,;:\[\]]", t or "") if re.search("[A-Za-z]", x)])
    for doc in sents:
        w = [re.findall("[a-z]+", x.lower()) for x in doc]
        for i, x in enumerate(doc):
            around = Counter(sum((w[j] for j in (i - 1, i, i + 1) if 0 <= j < len(w)), []))
            low = re.sub("[^a-z]", " ", x.lower())
            for ph, acc in per.items():
                c = len(re.findall(rf"(?<![a-z])(?={ph}(?![a-z]))", low))
                ws = ph.split()
                acc[0] += c
                for k, v in enumerate(ws):
                    more = around[v] - c * ws.count(v)
                    if c and more > 0:
                        acc[1][k] += c
                        acc[2][k] += c * more
    lp, di = {"data": math.log(0.1), "mining": math.log(0.2)}, {"data": 1.0, "mining": 3.0}
    for ph, (total, f, more) in per.items():
        ws = ph.split()
        a = math.sqrt(sum((x / total) ** 2 * lp[v] ** 2 for x, v in zip(f, ws)) / sum(lp[v] ** 2 for v in ws))
        b = sum(x / total * di[v] for x, v in zip(more, ws)) / sum(di[v] for v in ws)
        assert got[ph] == (pytest.approx(a), pytest.approx(b))


def test_phrase_models(spark):
    rng = random.Random(0)
    words = "abcd"
    prob = {" ".join(rng.choice(words) for _ in range(n)): rng.uniform(0.01, 0.3) for n in (1, 1, 1, 1, 2, 2, 2, 3, 3, 4) for _ in range(3)}
    ask = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(4)] + list(prob)
    model = spark.createDataFrame(list(prob.items()), "phrase string, prob double")

    def cuts(w):
        for k in range(1, len(w)):
            for at in combinations(range(1, len(w)), k):
                yield [" ".join(w[i:j]) for i, j in zip((0, *at), (*at, len(w)))]

    got = {r.phrase: (r.f1, r.f4) for r in phrasemodel.recomputed_features(spark.createDataFrame([(x,) for x in ask], "phrase string"), model, 0.7).collect()}
    broken = {r.phrase for r in phrasemodel.broken_labels(spark.createDataFrame([(x,) for x in ask], "phrase string"), model, 1.5).collect()}
    for x in set(ask):
        best = max((math.prod(prob.get(s, 0) * 0.7 for s in c) for c in cuts(x.split())), default=0)
        own = prob.get(x)
        if own is None:
            assert got[x] == (0.0, 0.0)
        elif best > 1e-9:
            assert got[x] == (pytest.approx(own / best), pytest.approx(own * math.log(own / best)))
        else:
            assert got[x] == (1e10, 1e10)
        weigh = lambda s: prob.get(s, 0) / 1.5 ** (len(s.split()) - 1)
        best = max((math.prod(weigh(s) for s in c) for c in cuts(x.split())), default=0)
        assert (x in broken) == (own is None or best > weigh(x) * (1 + 1e-12)) or abs(best - weigh(x)) < 1e-12
    c = spark.createDataFrame([("a", 1, 3), ("b", 1, 1), ("a b", 2, 4), ("b a", 2, 4)], "phrase string, n bigint, cnt bigint")
    sc = spark.createDataFrame([("a b", 0.5)], "phrase string, score double")
    assert {r.phrase: r.prob for r in phrasemodel.segmentation_model(c, sc).collect()} == {"a": 0.75, "b": 0.25, "a b": 0.25}
    r = spark.createDataFrame([("x", 0.2), ("y", 0.5), ("z", 0.9)], "phrase string, score double")
    assert {x.phrase for x in phrasemodel.at_least(r, 0.5).collect()} == {"y", "z"} and {x.phrase for x in phrasemodel.rank_list(r, 3).collect()} == {"z"}
    assert {x.phrase: x.score for x in phrasemodel.replace_scores(r, spark.createDataFrame([("z",)], "phrase string")).collect()} == {"x": 0.2, "y": 0.5, "z": 0.0}


def test_prune_by_window(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", n, float(rng.randint(0, 30)), rng.random()) for i in range(150) for n in (2, 3)]
    got = {(r.phrase, r.n): r.pos for r in phrases.prune_by_window(spark.createDataFrame(rows, "phrase string, n bigint, score double, quality double"), 3, 0.35, 60).collect()}
    want = {}
    for n in (2, 3):
        s = sorted((r for r in rows if r[1] == n), key=lambda r: (r[2], r[0]), reverse=True)
        for i, r in enumerate(s[:60]):
            near = [x[3] for x in s[max(0, i - 3) : i + 4]]
            if sum(near) / len(near) < 0.35:
                break
            want[r[0], n] = i + 1
    assert got == want


def test_marks_and_rendering(spark):
    t = ['. a b, c!! d', "x", "", None, "[z]?y"]
    df = spark.createDataFrame([(x,) for x in t], "t string").select("t", phrasemodel.split_with_marks("t").alias("p")).collect()
    assert all("".join(x.sentence + x.mark for x in r.p) == r.t for r in df if r.t is not None) and df[3].p is None
    seg = [("Big Data Mining, is it?", ["big", "data mining", "is", "it"]), ("a  b", ["a b"]), (None, ["a"]), ("zz", ["nope"]), ("é data-mining", ["é", "data mining"])]
    d = spark.createDataFrame(seg, "t string, s array<string>")
    assert [r[0] for r in d.select(phrasemodel.rendered("t", "s")).collect()] == ["Big [Data Mining], is it?", "[a  b]", None, "zz", "é [data-mining]"]
    assert [r[0] for r in d.select(phrasemodel.rendered("t", "s", "underscores")).collect()][:2] == ["Big Data_Mining, is it?", "a_b"]
    assert d.select(phrasemodel.rendered("t", "s", "clean")).first()[0] == "big [data mining] is it"


def test_projected_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 20)) + 2 * rng.standard_normal((12, 20))[rng.integers(0, 12, 400)]
    v = spark.createDataFrame([(f"w{i}", [float(a) for a in r]) for i, r in enumerate(x)] + [("zero", [0.0] * 20), ("none", None)], "word string, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got: dict = {}
    for r in phrasemodel.projected_neighbours(v, v, "word", "vec", 20).collect():
        got.setdefault(r.word, []).append((r["rank"], r.near, r.sim))
    assert len(got) == 400 and all(sorted(g)[0][2] == 1.0 for g in got.values())
    assert np.mean([len({int(n[1:]) for _, n, _ in got[f"w{i}"]} & set(np.argsort(-s[i])[:3])) / 3 for i in range(400)]) > 0.9


def test_keywords_and_tags(spark):
    t = spark.createDataFrame([(1, 0, "go", "V"), (1, 1, "park", "N"), (1, 2, "park", "N"), (2, 0, "x", "V")], "tid int, pos int, token string, tag string")
    e = spark.createDataFrame([(1, 5, "big park"), (3, 0, "alone")], "tid int, pos int, entity string")
    assert {r.tid: r.words for r in phrasemodel.keywords(t, ["N"], e).collect()} == {1: ["park", "big park"], 3: ["alone"]}


def test_penalty_and_scores(spark):
    rec = spark.createDataFrame([(["a", "b"],)] * 5, "w array<string>")
    ph = spark.createDataFrame([("a", 1, 50), ("b", 1, 50), ("a b", 2, 10)], "phrase string, n bigint, cnt bigint")
    good = spark.createDataFrame([("a b",)], "phrase string")
    p = quality.find_penalty(rec, "w", ph, good, steps=12)
    assert 3.5 < p < 4.05  # 1 / (0.5 * 0.5)
    with pytest.raises(ValueError):
        quality.find_penalty(rec, "w", ph, good, most=1)
    z = quality.zscore(spark.createDataFrame([(1.0,), (3.0,)], "v double"), ["v"]).orderBy("v").collect()
    assert [round(r.z_v, 6) for r in z] == [-0.707107, 0.707107]
    # bigrams never cross records
    b = phrases.bigram_scores(spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), ([],), (None,)], "w array<string>"), "w", 1)
    assert {(r.a, r.b): (r.cnt_a, r.cnt_b, r.cnt_ab) for r in b.collect()} == {("a", "b"): (2, 2, 2), ("b", "c"): (2, 1, 1)}


# evaluation


def test_repeated_classifier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 5 == 0), float(rng.standard_normal() + 3 * (i % 5 == 0)), float(rng.standard_normal())) for i in range(400)] + [(900, 1, float("nan"), 0.0), (901, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    r = evaluate.repeated_classifier(df, ["a", "b"], "y", "k", repeats=6, keep=1)
    got = r.collect()
    assert sorted(x["repeat"] for x in got) == list(range(6)) and all(x.f1 > 0.8 for x in got)
    m = evaluate.mean_metrics(r, "m").first()
    assert m.method == "m" and m.precision == pytest.approx(sum(x.precision for x in got) / 6)
    assert evaluate.repeated_classifier(df.limit(0), ["a"], "y", "k", repeats=2).where("f1 is null").count() == 2
    with pytest.raises(ValueError):
        evaluate.repeated_classifier(df, ["a"], "y", "k", most=10)
    top = evaluate.forest_importance(df.where("not isnan(a)"), ["b", "a"], "y", trees=5, depth=4).orderBy("rank").first()
    assert top.feature == "a" and top["rank"] == 1
    b = evaluate.balanced(df.where("y is not null"), "y", "k")
    assert b.where("y = 0").count() == b.where("y = 1").count() == 81
    a = evaluate.agreement_counts(spark.createDataFrame([(1, "x", "x"), (1, "x", None), (6, "y", "x")], "s int, t string, said string"), "s", "t", "said")
    assert {r.section: (r.asked, r.answered, r.right) for r in a.collect()} == {"1": (2, 1, 1), "6": (1, 1, 0), "semantic": (2, 1, 1), "syntactic": (1, 1, 0), "all": (3, 2, 1)}


def test_repeated_classifier_of_many_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 4 == 0), *(float(rng.standard_normal() + (i % 4 == 0) * m) for m in (0.2, 1.0, 0.5))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double, c double").repartition(3)
    near, far = (sorted(evaluate.repeated_classifier(df, ["a", "b", "c"], "y", "k", repeats=5, keep=2, local=n).collect()) for n in (300, 299))
    assert len(near) == 5 and all(a == pytest.approx(b) for a, b in zip(near, far))
    none = evaluate.repeated_classifier(df.where("y = 0"), ["a"], "y", "k", repeats=2, local=1).collect()
    assert len(none) == 2 and all(r.f1 is None for r in none)
    bare = spark.range(50_001).selectExpr("id as k", "if(id < 60, 1, 0) as y", "double(id % 7) as a")
    assert evaluate.repeated_classifier(bare, ["a"], "y", "k", repeats=2).count() == 2


def test_word_vector_queries(spark):
    v = spark.createDataFrame([("man", [1.0, 0.0]), ("king", [1.0, 1.0]), ("woman", [0.0, 0.1]), ("queen", [0.0, 1.0]), ("x", [-1.0, 0.0])], "word string, vec array<double>")
    q = spark.createDataFrame([(1, "man", "king", "woman", "queen"), (1, "man", "king", "nobody", "queen")], "section int, a string, b string, c string, d string")
    assert {r.c: r.said for r in wordvectors.analogy_answers(v, q).collect()} == {"woman": "queen", "nobody": None}
    assert wordvectors.similar(v, ["man"], 1).first().word == "king"
    tok = spark.createDataFrame([(i, 0, "hot") for i in range(2000)] + [(i, 1, "cold") for i in range(5)], "tid int, pos int, word string")
    kept = {r.word: r["count"] for r in wordvectors.subsample(tok, tok.groupBy("word").agg(F.count("*").alias("cnt")), 0.01).groupBy("word").count().collect()}
    assert kept["cold"] == 5 and 150 < kept["hot"] < 300  # (sqrt(c / sN) + 1) sN / c = 0.11


def test_continuous_bag_of_words(spark):
    rng = random.Random(0)
    rec = [[rng.choice(["sun", "sea", "sand"] if i % 2 else ["rain", "coat", "mud"]) for _ in range(6)] for i in range(600)] + [[], ["sun"], ["seldom", "sun"]]
    df = spark.createDataFrame([(r, 1) for r in rec] + [(None, 1)], "w array<string>, vec int")
    v = {r.word: np.array(r.vec) for r in wordvectors.cbow(df, "w", 8, 3, 5, rounds=6, alpha=0.3, part_records=200).collect()}
    assert set(v) == {"sun", "sea", "sand", "rain", "coat", "mud"}
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert min(cos("sun", "sea"), cos("rain", "mud")) > max(cos("sun", "rain"), cos("sea", "mud"))
    assert wordvectors.cbow(df.limit(0), "w", 8).isEmpty()


# layouts and settings


def test_lines_round_trip(spark, tmp_path):
    d = spark.createDataFrame([([1.5, -2.0], 0.25, 3.0)], "vec array<double>, lat double, lng double")
    assert tuple(L.parse_window(L.window_lines(d), 2).first()) == ([1.5, -2.0], 0.25, 3.0) and L.parse_window(L.window_lines(d, False), 2, False).first().vec == [1.5, -2.0]
    s = spark.createDataFrame([([0.5, 0.25], 7)], "scores array<double>, cluster_id int")
    assert L.membership_lines(s).first().value == "0.5,0.25,7"
    assert L.parse_membership(L.membership_lines(s).withColumn("line_no", F.lit(0))).first().cluster_id == 7
    m = L.manifest_lines(spark.createDataFrame([(0, 5), (1, 2)], "bin_id bigint, n bigint"), 48).orderBy("line_no").collect()
    assert [r.value for r in m] == ["2", "48", "0 5", "1 2"]
    assert spark.createDataFrame([("1.5, 2",), ("x,2",), ("1,2,3",), (None,)], "v string").select(L.location("v").alias("a")).collect()[0].a == (1.5, 2.0)
    assert [r.a for r in spark.createDataFrame([("x,2",), ("1,2,3",), (None,)], "v string").select(L.location("v").alias("a")).collect()] == [None] * 3
    assert {r.word for r in L.parse_stopwords(spark.createDataFrame([("The ",), ("",), ("the",)], "value string")).collect()} == {"the"}
    assert L.metric_lines(spark.createDataFrame([("m", 0.5, 0.25, 1.0)], "method string, precision double, recall double, f1 double")).first().value == "m\t0.5000\t0.2500\t1.0000"
    top = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "candidate_id bigint, tid bigint, rank bigint")
    said = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (1, 7, "z")], "candidate_id bigint, tid bigint, message string")
    one = L.description_lines(top, said)
    assert one.first().value == '{"candidate_id":1,"size":3,"posts":["x","y"]}'
    (tmp_path / "d.json").write_text("[" + one.first().value + "]")
    assert tuple(L.read_descriptions(spark, str(tmp_path / "d.json")).first()) == (1, 3, ["x", "y"])
    at = "file://" + str(tmp_path / "model")
    assert L.load_model(spark, at, "a") is None
    L.save_model(at, a=top)
    assert L.load_model(spark, at, "a")["a"].count() == 2
    R.save(top, str(tmp_path / "t"), "csv", sep="\t")
    assert spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 2


def test_feature_file_keeps_the_sign_of_zero(spark, tmp_path):
    from geoloom.plans.layouts import a30_feature_file

    st = [(1, -0.0), (1, -0.0), (2, 0.0), (3, math.nan), (3, math.nan), (4, None), (4, None), (5, -0.0), (5, 0.0), (None, 1.0)]
    df = spark.createDataFrame([(i, *[x if c == "st_unusualness" else 0.5 for c in L.FEATURES]) for i, x in st], "candidate_id bigint, " + ", ".join(f"{c} double" for c in L.FEATURES))
    df.write.parquet(str(tmp_path / "candidate_features.parquet"))
    got = a30_feature_file(spark, str(tmp_path))
    assert got.columns == ["candidate_id", *L.FEATURES]
    rows = sorted((r.candidate_id, str(r.st_unusualness)) for r in got.collect())
    assert rows[:4] == [(1, "-0.0"), (2, "0.0"), (3, "nan"), (4, "None")]
    assert len(rows) == 5 and rows[4][1] in ("0.0", "-0.0")  # equal values are one row, whichever sign


def test_settings():
    assert settings.settings("la")["dim"] == 100 and settings.settings("toy", "dim: 7 # x\nroot: &r /data\nfile: !join [*root, /posts.txt]\non: true", epochs=3) | {"sampler": 0} == {
        "dim": 7, "epochs": 3, "negative": 1, "queries": 2, "reference": 4, "bins": 6, "sampler": 0, "root": "/data", "file": "/data/posts.txt", "on": True,
    }
    with pytest.raises(ValueError):
        settings.settings("x")
    a = settings.command_line(["d1_word_counts", "in", "out", "--format", "json"])
    assert (a.query, a.tables, a.out, a.format) == ("d1_word_counts", "in", "out", "json")
    assert settings.tool_present("python") and not settings.tool_present("no-such-tool-at-all")


def test_small_functions(spark):
    df = spark.createDataFrame([(1e-9, {0: 2.0, 2: 3.0}), (-2.0, {})], "x double, m map<int, double>")
    assert [tuple(r) for r in df.select(S.sign(F.col("x")), S.to_dense(F.col("m"), 3)).collect()] == [(0, [2.0, 0.0, 3.0]), (-1, [0.0, 0.0, 0.0])]
    t = spark.createDataFrame([([("go", "V"), ("park", "N")],)], "t array<struct<token:string,tag:string>>")
    assert [x.token for x in t.select(T.filter_by_tag("t", ["N"])).first()[0]] == ["park"]
    b = spark.createDataFrame([(i, 40_000 + i) for i in range(20)], "bin_id bigint, ts bigint")
    w = B.query_windows(b, 2, 6)
    drawn = B.sample_windows(w, 30, 4).collect()
    assert len(drawn) == 30 and all(r.bins == list(range(r.start_bin, r.start_bin + 6)) for r in drawn) and len({r.start_bin for r in drawn}) > 5
    q = L.bins_of_queries(b.withColumnRenamed("ts", "tid"), spark.createDataFrame([(1, [3, 4]), (2, [4])], "query_id int, bins array<int>")).collect()
    assert sorted((r.query_id, r.nth, r.bin_id) for r in q) == [(1, 0, 3), (1, 1, 4), (2, 0, 4)]
    s = C.place_statistics(spark.createDataFrame([("k", 1.0, 2.0)], "k string, lat double, lng double"), "k").first()
    assert [round(x, 6) for x in s[1:]] == [1, 0.666667, 1.333333, 0.343333, 0.666667, 1.343333]


def test_streams_with_watermarks(spark, tmp_path):
    from geoloom.streaming.bins import stream_sliding_statistics, stream_window_counts

    data = [("k", b, float(b), 1.0, 1_000_000 + 1800 * b + i) for b in range(8) for i in range(b + 1)]
    df = spark.createDataFrame(data, "uid string, bin_id bigint, lat double, lng double, ts bigint").withColumn("at", F.timestamp_seconds("ts"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_sliding_statistics(s, "uid", 3).writeStream.outputMode("append").format("memory").queryName("slide_out").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.bin_id: (r.n, round(r.lat, 6)) for r in spark.table("slide_out").collect()}
    for b in range(8):
        held = [x for x in data if b - 2 <= x[1] <= b]
        assert got[b] == (len(held), round(sum(x[2] for x in held) / len(held), 6))
    q = stream_window_counts(s).writeStream.outputMode("append").format("memory").queryName("count_out").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    n = {r.window.start.timestamp(): r.n for r in spark.table("count_out").collect()}
    want = Counter(x[4] // 1800 * 1800 for x in data)
    assert n and all(want[int(k)] == v for k, v in n.items())


def test_stream_mixture(spark, tmp_path):
    from geoloom.streaming.mixture import stream_mixture

    rows = [("s", b, b * 10_000 + t, y, x, v) for b in range(4) for q, t, y, x, v in groups(6)]
    df = spark.createDataFrame(rows, "stream string, bin_id bigint, tid bigint, lat double, lng double, vec array<double>")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_mixture(s, "stream", 2, mixture.Params(clusters=6, sweeps=12)).writeStream.outputMode("append").format("memory").queryName("mix_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("mix_out").collect()
    assert Counter(r.bin_id for r in got) == {1: 36, 2: 36}  # the last bin is still open
    of: dict = {}
    for r in got:
        if r.bin_id == 2:
            of.setdefault(r.tid % 10_000 // 1000, set()).add(r.cluster_id)
    assert all(len(v) == 1 for v in of.values()) and len(set.union(*of.values())) == 3
