import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import clusters, encode, lookalike, neighbours, ngrams, packing, pairs, sentences, top_n
from geoloom.llm.hnsw import Graph


# 2 pairs


def expected_pairs(baskets):
    one, two = Counter(), Counter()
    for b in baskets:
        s = sorted({x for x in b or [] if x is not None})
        one.update(s)
        two.update(combinations(s, 2))
    return one, two


def test_pairs_follow_changes(spark):
    rng = random.Random(3)
    now = {i: [rng.choice("abcdeé日") for _ in range(rng.randint(0, 6))] + [None] for i in range(60)}
    kind = "before array<string>, after array<string>, a string, n int"
    t = pairs.PairTable(spark, buckets=3)
    t.apply(spark.createDataFrame([(None, b, "x", 1) for b in now.values()], kind))
    for _ in range(2):
        changes = []
        for i in list(now)[:20]:
            new = rng.choice([None, [], [rng.choice("abf") for _ in range(3)]])
            changes.append((now[i], new, "x", 1))
            now.pop(i)
            if new is not None:
                now[f"{i}'"] = new
        t.apply(spark.createDataFrame(changes, kind))
        one, two = expected_pairs(now.values())
        assert {r.item: r.n for r in t.items().collect()} == +one and {(r.a, r.b): r.n for r in t.pairs().collect()} == +two and t.total == len(now)
    s = {(r.a, r.b): r.lift for r in t.scores().collect()}
    for (a, b), n in two.items():
        assert s[a, b] == pytest.approx(n * len(now) / one[a] / one[b])
    part = t.scores(1, spark.createDataFrame([("a",)], "item string")).collect()
    assert {(r.a, r.b) for r in part} == {p for p in two if "a" in p}
    t.drop()


def test_pairs_survive_failures_and_reopening(spark, tmp_path):
    kind = "before array<string>, after array<string>"
    at = "file://" + str(tmp_path / "pairs")
    t = pairs.PairTable(spark, at, buckets=4, min_both=2)
    t.apply(spark.createDataFrame([(None, ["a", "b", "c"]), (None, ["a", "b"]), (None, ["x"])], kind))
    bad = spark.createDataFrame([(None, ["a", "z"])], kind).withColumn("after", F.transform("after", lambda x: F.when(x == "z", F.raise_error(F.lit("lost")).cast("string")).otherwise(x)))
    with pytest.raises(Exception):
        t.apply(bad)
    again = pairs.PairTable(spark, at)
    assert (again.version, again.total, again.buckets, again.min_both) == (1, 3, 4, 2)
    again.apply(spark.createDataFrame([(["x"], ["x"])], kind), scores=False)
    with pytest.raises(ValueError):
        pairs.PairTable(spark, at).scores()
    again.apply(spark.createDataFrame([(["a", "b", "c"], None), (["a", "b"], ["a", "b", "d"]), (None, ["b", "a"])], kind))
    third = pairs.PairTable(spark, at)
    assert {(r.a, r.b): r.n for r in third.pairs().collect()} == {("a", "b"): 2, ("a", "d"): 1, ("b", "d"): 1} and third.total == 3
    assert [tuple(r) for r in third.scores().collect()] == [("a", "b", 2, 2, 2, 1.5)]
    with pytest.raises(ValueError):
        third.scores(1)
    third.vacuum()
    assert {r.item: r.n for r in pairs.PairTable(spark, at).items().collect()} == {"a": 2, "b": 2, "d": 1, "x": 1}


def test_pairs_of_a_long_basket(spark):
    t = pairs.PairTable(spark)
    t.apply(spark.createDataFrame([(None, [f"w{i:04}" for i in range(1200)])], "before array<string>, after array<string>"))
    assert t.pairs().count() == 1200 * 1199 // 2


def test_pairs_of_nothing(spark):
    t = pairs.PairTable(spark)
    t.apply(spark.createDataFrame([], "before array<string>, after array<string>"))
    assert t.pairs().isEmpty() and t.scores().isEmpty()
    t.apply(spark.createDataFrame([(None, ["a"])], "before array<string>, after array<string>"))
    assert t.pairs().isEmpty() and t.items().count() == 1


# 3 clusters


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("centre,spread,n", [((41.0, -8.0), 400, 150), ((-17.2, 180.0), 300, 120), ((89.9995, 0.0), 150, 80), ((10.0, 10.0), 60, 300)])
def test_clusters_agree_with_brute_force(spark, centre, spread, n):
    rng = random.Random(n)
    pts = []
    for i in range(n):
        y, x = rng.uniform(-spread, spread) / 111_000, rng.uniform(-spread, spread) / 111_000
        pts.append((i, min(90.0, centre[0] + y), centre[1] + x / max(0.001, math.cos(math.radians(centre[0]))) + rng.choice([0.0, 360.0]), rng.randint(0, 4000), "x", 1))
    pts += [(pts[0][0], *pts[0][1:]), (None, 1.0, 1.0, 1, "x", 1), (n + 1, None, 1.0, 1, "x", 1), (n + 2, 1.0, 1.0, None, "x", 1)]
    df = spark.createDataFrame(pts, "tid bigint, lat double, lng double, ts bigint, id string, box int")

    def close(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return abs(p[3] - q[3]) <= 600 and 2 * 6_373_000 * math.asin(math.sqrt(min(1, h))) <= 80

    c = components(n, [(i, j) for i in range(n) for j in range(i) if close(pts[i], pts[j])])
    size = Counter(c)
    want = {(c[i], i) for i in range(n) if size[c[i]] >= 3}
    got = {(r.cluster, r.id) for r in clusters.close_clusters(df, "tid", "lat", "lng", "ts", 80.0, 600, 3).collect()}
    assert got == want


def test_dense_boxes_are_cut_until_settled(spark):
    # two dense lines 80 m apart but for one pair: only cutting the boxes again finds the link
    m = math.degrees(1 / 6_373_000)
    rng = random.Random(0)
    left = [(i, 0.1 + rng.uniform(0, 50) * m, 0.1 + rng.uniform(0, 10) * m, 0) for i in range(120)]
    right = [(200 + i, 0.1 + rng.uniform(0, 50) * m, 0.1 + (90.5 + rng.uniform(0, 10)) * m, 0) for i in range(120)]
    base = {(0, r.id) for r in clusters.close_clusters(spark.createDataFrame(left + right, "tid bigint, lat double, lng double, ts bigint"), "tid", "lat", "lng", "ts", 80.0, 600).collect() if r.cluster == 0}
    assert base == {(0, i) for i in range(120)} or len(base) == 240
    link = [(500, 0.1 + 25 * m, 0.1 + 12 * m, 300)]
    got = {r.cluster for r in clusters.close_clusters(spark.createDataFrame(left + right + link, "tid bigint, lat double, lng double, ts bigint"), "tid", "lat", "lng", "ts", 80.0, 600).collect()}
    assert got == {0}


def test_clusters_of_nothing(spark):
    e = spark.createDataFrame([], "tid bigint, lat double, lng double, ts bigint")
    c = clusters.close_clusters(e, "tid", "lat", "lng", "ts", 80.0, 600, 5)
    assert c.isEmpty() and clusters.typical_members(c, e, "tid", "lat", "lng", "ts", 80.0, 600).isEmpty()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    c = components(200, links)
    got = {r.node: r.component for r in clusters.connected_components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {i: c[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_minhash_groups(spark):
    rng = random.Random(4)
    m = math.degrees(1 / 6_373_000)
    pts = []
    for i in range(250):
        y, x = rng.uniform(-900, 900) * m, rng.uniform(-900, 900) * m
        pts.append((i, 40.0 + y, 180.0 + x / math.cos(math.radians(40)), rng.randint(0, 3000)))
    pts += [(1000, *pts[0][1:]), pts[1], (None, 1.0, 1.0, 1), (1001, None, 1.0, 1), (1002, 1.0, 1.0, None)]
    df = spark.createDataFrame(pts, "tid bigint, lat double, lng double, ts bigint").withColumn("node", F.lit("x"))
    links, members = clusters.minhash_links(df, "tid", "lat", "lng", "ts", 80.0, 600, 0.3, 64)
    node = {r.id: r.node for r in members.collect()}
    assert set(node) == {*range(250), 1000} and node[1000] == node[0]
    place = {t: (y, x - 360 * math.floor((x + 180) / 360), s) for t, y, x, s in pts if t in node}
    side = math.degrees(80 / 6_373_000)

    def cells(t):
        y, x, s = place[t]
        r = math.floor((y + 90) / side)
        out = set()
        for k in range(r - 4, r + 5):
            n = max(1, math.floor(math.cos(math.radians(min(abs(k * side - 90), abs((k + 1) * side - 90)))) * (360 / side)))
            c = math.floor((x + 180) / 360 * n)
            out |= {(k, j % n, q) for j in range(c - 4, c + 5) for q in range(s // 600 - 3, s // 600 + 4)}
        return out

    nodes = sorted(set(node.values()))
    sets = {n: cells(n) for n in nodes}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(nodes, 2)}
    want = {k: v for k, v in want.items() if v >= 0.3}
    got = {(r.a, r.b): r.jaccard for r in links.collect()}
    assert set(got) <= set(want) and len(got) > 0.99 * len(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    near: dict = {n: {} for n in nodes}
    for (a, b), j in got.items():
        near[a][b] = near[b][a] = j
    medoids: set = set()
    for n in sorted(nodes, key=lambda n: (-len(near[n]), n)):
        if not medoids & set(near[n]):
            medoids.add(n)
    mine = {n: n if n in medoids else min(medoids & set(near[n]), key=lambda k: (-near[n][k], k)) for n in nodes}
    out = clusters.minhash_groups(df, "tid", "lat", "lng", "ts", 80.0, 600, 1, 0.3, 64).collect()
    assert {r.id: r.medoid for r in out} == {t: mine[n] for t, n in node.items()}
    size = Counter(r.medoid for r in out)
    assert all(r.size == size[r.medoid] for r in out) and len({r.component for r in out}) <= len(medoids)
    assert clusters.minhash_groups(df.limit(0), "tid", "lat", "lng", "ts", 80.0, 600).isEmpty()


# 4 neighbours


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 24)).astype("f4") + 3 * rng.standard_normal((20, 24)).astype("f4")[rng.integers(0, 20, 4000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    node, sim = Graph(x, 10, 20).search(x, 6, own=np.arange(4000))
    s = x @ x.T
    best = np.argsort(-s, 1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(node, best)]) > 0.9
    assert np.allclose(sim[:, 0], 1, atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 30, 500, 1000, 3000])
def test_graph_gives_as_many_as_asked(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 16)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    node, _ = Graph(x, 10, 20).search(x[:200], 21)
    assert ((node >= 0).sum(1) == min(21, n)).all() and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in node)
    if n <= 1000:
        best = np.argsort(-(x[:200] @ x.T), 1)[:, :21]
        assert all(set(a[a >= 0]) == set(b) for a, b in zip(node, best))


def test_neighbours_with_copies_and_dirt(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 8)).round(3)
    vecs = {i: [float(v) for v in base[i]] for i in range(300)}
    for i in range(300, 340):
        vecs[i] = vecs[0]  # 41 copies
    nan = float("nan")
    dirty = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [nan] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (None, vecs[1]), (1, vecs[1])]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in [*vecs.items(), *dirty]], "tid bigint, v array<float>, sim double, near string")
    got: dict = {}
    for r in neighbours.nearest(df, "tid", "v", 4, dim=8, shard_rows=100, probes=8).collect():
        got.setdefault(r.id, []).append((r["rank"], r.near))
    x = np.array([vecs[i] for i in range(340)], dtype="f4").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(7)
    hit = 0
    for i in range(340):
        want = [j for j in sorted(range(340), key=lambda j: (-s[i, j], j)) if j != i][:4]
        mine = [n for _, n in sorted(got[i])]
        assert len(mine) == 4
        hit += len(set(want) & set(mine))
    assert hit / (4 * 340) > 0.9 and set(got) == set(range(340))
    assert sorted(got[339]) == [(1, 0), (2, 300), (3, 301), (4, 302)]
    assert neighbours.nearest(df.limit(0), "tid", "v", 4, dim=8).isEmpty()
    assert {r.id for r in neighbours.nearest(df, "tid", "v", 2, dim=8, queries=F.col("id") % 20 == 0).collect()} == set(range(0, 340, 20))


def test_neighbours_with_more_pivots_than_topics(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 24)) + 3 * rng.standard_normal((8, 24))[rng.integers(0, 8, 4000)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "tid bigint, v array<float>")
    got: dict = {}
    for r in neighbours.nearest(df, "tid", "v", 5, dim=24, shard_rows=50, queries=F.col("id") % 20 == 0).collect():
        got.setdefault(r.id, set()).add(r.near)
    x = x.astype("f4").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert set(got) == set(range(0, 4000, 20))
    assert np.mean([len(got[i] & set(np.argsort(-s[i])[:5])) / 5 for i in got]) > 0.95


def test_neighbours_of_a_hot_topic(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.standard_normal((900, 12)) * 0.3 + 2, rng.standard_normal((300, 12))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "tid bigint, v array<float>")
    plain = {(r.id, r.near, r["rank"]) for r in neighbours.nearest(df, "tid", "v", 3, dim=12, shard_rows=100, probes=3).collect()}
    parted = {(r.id, r.near, r["rank"]) for r in neighbours.nearest(df, "tid", "v", 3, dim=12, shard_rows=100, probes=3, visit_rows=150).collect()}
    assert parted == plain and len({i for i, *_ in plain}) == 1200


# 5 top n


def test_top_n(spark):
    rng = random.Random(0)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([0.0, -0.0, 1.5, -2.5, float("nan"), float("inf"), None, rng.gauss(0, 100)]), i, "x") for i in range(3000)]
    data += data[:500] + [(4, 5.0, None, "x"), (5, 1.0, 9, "x")]
    df = spark.createDataFrame(data, "g int, s double, t bigint, rank string")
    for down in (False, True):
        got: dict = {}
        for r in top_n.top_n(df, "g", "s", "t", 7, descending=down, small=20).collect():
            got.setdefault(r.g, []).append((r["rank"], r.t))
        for g in (1, 2, 3, 5):
            ok = sorted({((-s if down else s) + 0.0, t) for x, s, t, _ in data if x == g and s is not None and s == s and t is not None})[:7]
            assert [t for _, t in sorted(got[g])] == [t for _, t in ok]
        assert set(got) == {1, 2, 3, 5}
    salted = top_n.top_n(df, "g", "s", "t", 7, small=20, broadcast_rows=0, salts=3)
    assert {tuple(r) for r in salted.collect()} == {tuple(r) for r in top_n.top_n(df, "g", "s", "t", 7, small=20).collect()}
    assert top_n.top_n(df.limit(0), "g", "s", "t", 7).isEmpty()
    once = df.distinct()
    assert {tuple(r) for r in top_n.top_n(once, "g", "s", "t", 7, small=20, unique=True).collect()} == {tuple(r) for r in top_n.top_n(once, "g", "s", "t", 7, small=20).collect()}


# 6 look-alikes


def test_shown_forms(spark):
    w = [("café", 1), ("copy", 2), ("coast", 3), ("музыка", 4), ("バス", 5), ("cafe", 6), ("đêm", 7)]
    seen = ["café", "сору", "coaﬆ", "ｃｏａｓｔ", "co​py", "ﾊﾞｽ", "мyзыкa", "Copy", "𝖼𝗈𝗉𝗒", "cafè", "​", "", None, "đem", "copy", "copy", "zebra"]
    df = spark.createDataFrame([(s, "x", 1) for s in seen], "value string, word string, word_id int")
    got = {r.value: (r.canonical, r.word_id) for r in lookalike.canonical_forms(df.select("value"), spark.createDataFrame(w, "word string, word_id bigint")).collect()}
    assert got["café"] == ("café", 1) and got["ﾊﾞｽ"] == ("バス", 5) and got["coaﬆ"] == got["ｃｏａｓｔ"] == ("coast", 3)
    assert all(got[v] == ("copy", 2) for v in ("сору", "co​py", "𝖼𝗈𝗉𝗒", "copy"))
    assert got["Copy"] == ("Copy", None) and got["cafè"] == ("cafè", None) and got["đem"][1] is None and got["zebra"] == ("zebra", None)
    assert "" not in got and "​" not in got and None not in got
    wide = lookalike.look_alikes(spark)
    assert lookalike.shown("Ꭺꓮⲟ", wide) == "AAo" and lookalike.shown("σοφός", wide)[0] == "σ" and 100 < len(wide) < 2000
    assert lookalike.shown("мyзыкa", wide) == lookalike.shown("музыка", wide) and lookalike.shown("ø", wide) == "ø"
    assert lookalike.shown("мyзыкa") == lookalike.shown("музыка") and lookalike.shown("x" * 100_000 + "​") == "x" * 100_000
    v = spark.createDataFrame([("a b　 c​d",), (None,), ("",)], "t string").select(lookalike.visual_words("t")).collect()
    assert [r[0] for r in v] == [["a", "b", "c​d"], None, []]


# 7 n-grams


def test_ngrams(spark):
    rng = random.Random(0)
    recs = [[rng.choice(["a", "b", "ab", "é", "\t", "日", None]) for _ in range(rng.randint(0, 12))] for _ in range(80)] + [None, [], ["x"] * 3000]
    df = spark.createDataFrame([(r, "s", 1) for r in recs], "terms array<string>, ngram string, cf int")
    for n in (1, 3):
        cf, docs = Counter(), Counter()
        for r in recs:
            r = [t for t in r or [] if t is not None]
            g = [" ".join(r[i : i + k]) for k in range(1, n + 1) for i in range(len(r) - k + 1)]
            cf.update(g)
            docs.update(set(g))
        got = {r.ngram.replace("\x1f", " "): (r.cf, r.df, r.n) for r in ngrams.ngram_counts(df, max_n=n).collect()}
        assert got == {g: (cf[g], docs[g], g.count(" ") + 1) for g in cf}
    m = {r.ngram: r.mark for r in ngrams.marked(ngrams.ngram_counts(df), 10, 2, 0.5).collect()}
    assert m["x"] == "rare" and m["a"] == "common"
    assert ngrams.ngram_counts(df.limit(0)).isEmpty()


# 8 encoding


@pytest.fixture(scope="module")
def exact():
    import base64

    import tiktoken

    with open(encode.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_encoding_is_exact(spark, exact):
    rng = random.Random(0)
    e = encode.Encoder()
    texts = ["", "<|endoftext|>", "a" * 20_000, " " * 3000 + "x", "\r\n\r\n", "🏳️‍🌈é日本", "12345" * 400]
    texts += ["".join(rng.choice("ab cté日.\n1'😂​") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    for t in texts:
        assert e.ids(t) == exact(t)
    df = spark.createDataFrame([("", "x"), (None, "x"), ("hi there", "x")], "text string, ids string")
    assert [r.i for r in df.select(encode.encoded("text").alias("i")).collect()] == [[], [], exact("hi there")]
    assert [r[0] for r in df.select(encode.token_count("text")).collect()] == [0, 0, 2]


# 9 packing


def test_packing(spark):
    rng = random.Random(0)
    for n, part in ((400, 60), (30, 1000), (0, 10)):
        items = [(i, rng.choice([0, 1, 5, 100, 101, 250, rng.randint(1, 100), None]), "x") for i in range(n)]
        df = spark.createDataFrame([*items, *items[:5], (None, 7, "x")], "id bigint, n int, fill string")
        got = packing.pack(df, "id", "n", 100, part).collect()
        size, start = Counter(), {}
        for r in got:
            size[r.container] += r.size
            start.setdefault(r.doc_id, []).append((r.piece, r.start, r.size))
        assert all(v <= 100 for v in size.values()) and all(size[r.container] == r.fill for r in got)
        assert {d: sum(x[2] for x in p) for d, p in start.items()} == {i: s for i, s, _ in items if s}
        for d, p in start.items():
            assert [x[1] for x in sorted(p)] == [100 * k for k in range(len(p))] and all(x[2] == 100 for x in sorted(p)[:-1])
        s = packing.summary(packing.pack(df, "id", "n", 100, part), 100).first()
        assert s.containers == len(size) and (not n or s.lower_bound <= s.containers <= s.lower_bound * 1.06 + 1)


def test_bounds_hold():
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3 and packing.lower_bound(np.array([34, 34, 34, 34]), 100) == 2 and packing.lower_bound(np.array([]), 100) == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        c = packing.best_fit_decreasing(s, 100)
        assert np.bincount(c, weights=s).max() <= 100 and packing.lower_bound(s, 100) <= c.max() + 1


# 10 sentences

CASES = [
    ["the feed went quiet after 6:30.", " J. K. Raror booked it.", " Near x it rained."],
    ['Fentor wrote: "It is over."', " Dr. Zen will\ntalk.", " “It is over.”", " That was it.", " 'Nobody expected it.'", " Mt. Tasai is 7 km."],
    ["He lives on Kutren St.", " As so often, it went.", " The bus leaves St. Norkrist Sq. at 8:45 sharp.", "Near Vans it rained. 🚒", " iPier is gone."],
    ["At 3 a.m. Wednesday it came.", " It closes at 7 p.m.", " Most left.", ' He said "Closed. Go home." and nobody read it. 🔥', " The end"],
    ["Tickets (see p. 31.) are gone.", " (Nobody said why.)", " They (yes, all 55!) came.", " No. 1,200 is here.", " It was loud... then it stopped.", " We waited...", " Nobody came."],
    ["Really?!", " Wahoo! style banners hung over it.", " Was it x?", " the feed stopped!!!"],
    ["Der 41. Lauf war lang.", " Dr. Samai spricht am 3. März.", " Bänke usw.", " Die Band zog.", " „Ist das offen?“, fragte Gemen.", " Es gibt, z. B. für x, viel."],
    ["Viven en EE. UU. desde 73.", " ¿Sigue abierto?", " ¡Qué noche!"],
    ["«Où est la fête ? » demanda Kiste.", " C’est fini… ou presque, dit Krevi.", "Qui a vu ?"],
    ["«Έκλεισε;» ρώτησε ο Mortul.", " Τι ώρα;", " Ο κ. Stas, π.χ. εδώ."],
    ["Т. е. праздник на 10 мая.", " «Всё закрыто», — сказал Kanmi.", " А. Б. Krol открыл."],
    ["«أين الميناء؟» سأل Stele.", " قال د. Sten إن المعرض.", " هل السوق مفتوح؟"],
    ['"सब बंद है।" उसने कहा।', " तापमान 3.72 था।"],
    ["행사는 10. 10. 에 열린다.", ' "문을 닫았어요." 하고 Navor 씨가 말했다.', "\n어제 갔다."],
    ["彼は「行こう！」と叫んだ。", "「満員だ。」と彼は言った。", "しおかぜ。の新曲だ。", "えっ、本当…？！", "公園。"],
    ["他说：“结束了。”", "昨晚太美了！", "“开放吗？”她问。", "（详情见第9页。）", "等了很久……最后走了。"],
    ["ร้านเปิดตอน 2 โมงเช้า", " คอนเสิร์ตเริ่มกี่โมง", "\nสะพานปิด"],
    ["ዶ/ር Tup ነገ።", " ሙቀቱ 90.43 ነበር።", " መቼ?"],
    ["Bring these:", "\n- a warm coat", "\n- two shoes", "\n  1. left", "\n  2. right", "\n- a hat.", " And more."],
    ["Der Rest kommt am\n3. März wieder.", " Er ist alt -", "\n\n- und schwer."],
    ["Items:", "\n(a) one", "\n(b) two", "\n• x", "\n1) y"],
    ['He said "' + "it rains. " * 200 + 'Enough." and left.', " Then it stopped."],
    ["A heading", "\n \nText without a mark", "\r\n\r\nLast."],
]


@pytest.mark.parametrize("parts", CASES)
def test_sentences(parts):
    text, ends = "".join(parts), []
    for i in range(len(parts)):
        ends.append(len("".join(parts[: i + 1])))
    assert sentences.sentence_ends(text) == ends


def test_sentence_edges(spark):
    assert [sentences.sentence_ends(t) for t in (None, "", " \n\t​ ", "a", "  a  ", "...", "🏟️")] == [[], [], [], [1], [3], [3], [2]]
    assert sentences.sentence_ends("1.5;2.5. 3\n\n4", "record") == [13]
    long = "This is one. " * 20_000
    assert len(sentences.sentence_ends(long)) == 20_000
    for c in "\"“('«.":
        assert sentences.sentence_ends(c * 3000)[-1] == 3000
    df = spark.createDataFrame([(1, "A bee. See it.", "post", 1), (2, None, None, 1), (2, "", "post", 1), (3, "x. Y.", "record", 1)], "doc_id bigint, text string, doc_kind string, end_pos int")
    got = sorted(tuple(r) for r in sentences.sentences(df, "doc_id", "text", "doc_kind").collect())
    assert got == [(1, 0, 0, 6), (1, 1, 6, 14), (3, 0, 0, 5)]
    assert sentences.sentences(df.limit(0), "doc_id", "text", "doc_kind").isEmpty()


def test_llm_queries_have_names():
    from geoloom.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and {f"p{n}_found" for n in (2, 3, 4, 5, 6, 7, 10)} | {"p8_ids"} <= set(QUERIES)
