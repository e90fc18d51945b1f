"""Mixtures of directions and places: a cluster is a von Mises-Fisher direction of the text vector times, where asked for, a
Gaussian of the coordinates, sampled by collapsed Gibbs sweeps.

``Mixture`` holds the state of one sampler: it can take rows in, sweep over some of them and give rows back, so that a
window slides over bins without a new fit.  What runs it:

``cluster_windows``   independent windows, one task each; a window of more than ``split_rows`` rows is swept in shards that
                      exchange their statistics after every sweep, so no window is bound to one task;
``slide_windows``     bins in order, a first fit on ``width`` bins, then for every bin: the oldest leaves, the new one comes in;
``batch_mixture``     text only, all rows of a group, with the likelihood after every sweep;
``em_mixture``        text only, deterministic, over the whole table: every round is one pass that adds up statistics.

Inside a group a sweep is sequential by definition; each step is vectorised over the clusters.  The posterior of a Gaussian
uses nu0 + n + 4 and the density adds the cross term.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import native
from geoloom.storage import cut, release


@dataclass(frozen=True)
class Params:
    clusters: int = 200
    sweeps: int = 50
    kappa_steps: int = 10
    alpha: float = 1.0
    r0: float = 0.01
    c0: float = 0.01
    step: float = 3.0
    log_walk: bool = False
    virtual: int = 3000
    lambda0: float = 0.5
    nu0: float = 2.0
    delta0: float = 0.01
    kappa_low: float = 2.0
    kappa_high: float = 708.989
    places: bool = True


#: The presets of the sampler; 'text' and 'batch' have no places.
PRESETS = {
    "toy": Params(clusters=200, sweeps=50, kappa_steps=10),
    "la": Params(clusters=600, sweeps=50, kappa_steps=50),
    "ny": Params(clusters=600, sweeps=50, kappa_steps=50),
    "text": Params(places=False, kappa_low=0.5),
    "batch": Params(places=False, kappa_low=0.5, sweeps=30, kappa_steps=2000, log_walk=True, step=0.1),
}


def log_bessel(order: float, x: np.ndarray) -> np.ndarray:
    """ln I_order(x), x > 0: the uniform expansion for large orders, accurate to 1e-6 from order 5 on; the series below."""
    x = np.asarray(x, dtype=float)
    if order >= 5:
        z = x / order
        root = np.sqrt(1 + z * z)
        eta = root + np.log(z / (1 + root))
        t = 1 / root
        u1 = (3 * t - 5 * t**3) / 24
        u2 = (81 * t**2 - 462 * t**4 + 385 * t**6) / 1152
        u3 = (30375 * t**3 - 369603 * t**5 + 765765 * t**7 - 425425 * t**9) / 414720
        return order * eta - 0.5 * np.log(2 * np.pi * order) - 0.5 * np.log(root) + np.log1p(u1 / order + u2 / order**2 + u3 / order**3)
    k = np.arange(0, 800)
    lg = np.array([math.lgamma(i + 1) + math.lgamma(i + order + 1) for i in k])
    near = np.minimum(x, 300.0)
    terms = (2 * k + order) * np.log(near[..., None] / 2) - lg
    top = terms.max(-1, keepdims=True)
    series = (top + np.log(np.exp(terms - top).sum(-1, keepdims=True)))[..., 0]
    m, far = 4 * order * order, 8 * np.maximum(x, 300.0)
    large = 1 - (m - 1) / far + (m - 1) * (m - 9) / (2 * far**2) - (m - 1) * (m - 9) * (m - 25) / (6 * far**3)
    return np.where(x <= 300.0, series, x - 0.5 * np.log(2 * np.pi * x) + np.log(large))


@cache
def _bessel_table(dim: int) -> np.ndarray:
    """ln I_nu(x) - x + ln(x) / 2 between the points of a grid of ln x, four coefficients each of a cubic: smooth, so that is
    accurate to 1e-6, and small enough to stay in a core's own cache."""
    x = np.exp(np.linspace(_LOW, _TOP, _POINTS))
    g = np.concatenate([log_bessel(dim / 2 - 1, part) - part + 0.5 * np.log(part) for part in np.array_split(x, 8)])
    slope = np.gradient(g, edge_order=2)
    slope[2:-2] = (8 * (g[3:-1] - g[1:-3]) - (g[4:] - g[:-4])) / 12
    up = np.diff(g)
    return np.stack([g[:-1], slope[:-1], 3 * up - 2 * slope[:-1] - slope[1:], slope[:-1] + slope[1:] - 2 * up], 1)


_LOW, _TOP, _POINTS = math.log(1e-8), math.log(1e10), 4097


def _grid(dim: int) -> list[float]:
    """The table's start and points a unit of ln x, and what of the norm is fixed, for the compiled loops."""
    return [_LOW, (_POINTS - 1) / (_TOP - _LOW), dim / 2 * math.log(2 * math.pi)]


def log_norm_by_table(kappa: np.ndarray, dim: int) -> np.ndarray:
    """``log_norm`` from a table made once a process; what a sampler calls for every row."""
    lk = np.log(np.maximum(kappa, 1e-8))
    at = (lk - _LOW) * ((_POINTS - 1) / (_TOP - _LOW))
    i = at.astype(np.int64)
    c, t = _bessel_table(dim)[i].T, at - i
    return (dim / 2 - 0.5) * lk - kappa - (c[0] + t * (c[1] + t * (c[2] + t * c[3]))) - dim / 2 * math.log(2 * math.pi)


def log_norm(kappa: np.ndarray, dim: int) -> np.ndarray:
    """ln C(kappa) of a von Mises-Fisher density in ``dim`` dimensions."""
    nu = dim / 2 - 1
    kappa = np.maximum(np.asarray(kappa, dtype=float), 1e-10)
    return nu * np.log(kappa) - dim / 2 * math.log(2 * math.pi) - log_bessel(nu, kappa)


def kappa_log_posterior(kappa: np.ndarray, n: np.ndarray, length: np.ndarray, dim: int, c0: float = 0.01) -> np.ndarray:
    """(c0 + n) ln C(kappa) - ln C(kappa |s|), up to a constant, for a cluster of n rows with |s| = ``length``."""
    return (c0 + n) * log_norm_by_table(kappa, dim) - log_norm_by_table(kappa * length, dim)


def empty_weight(p: Params, nonempty: int) -> float:
    """Each empty cluster stands for its share of the virtual ones."""
    return math.log((p.virtual - nonempty + 0.01) / (p.clusters - nonempty + 0.01))


def add_point(p: Params, n, mean, scatter, d, sign: int = 1):
    """Running mean and scatter of a cluster after adding (sign 1) or removing (sign -1) a point; one undoes the other."""
    if sign > 0:
        w = (p.lambda0 + n) / (p.lambda0 + n + 1)
        diff = d - mean
        return n + 1, mean + diff / (p.lambda0 + n + 1), scatter + w * np.outer(diff, diff)
    back = (mean * (p.lambda0 + n) - d) / (p.lambda0 + n - 1)
    w = (p.lambda0 + n - 1) / (p.lambda0 + n)
    diff = d - back
    return n - 1, back, scatter - w * np.outer(diff, diff)


def scatter_of_sums(p: Params, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, scatter) of clusters from plain sums: n, the sum of the points, the sums of xx, xy and yy.  The same numbers
    that adding the points one by one gives."""
    mean = total / (p.lambda0 + n)[:, None]
    s = np.tile(np.eye(2) * p.delta0, (len(n), 1, 1))
    s[:, 0, 0] += squares[:, 0]
    s[:, 1, 1] += squares[:, 2]
    s[:, 0, 1] += squares[:, 1]
    s[:, 1, 0] += squares[:, 1]
    return mean, s - (p.lambda0 + n)[:, None, None] * mean[:, :, None] * mean[:, None, :]


class Mixture:
    """State of one sampler: per cluster the number of rows, the sum of their vectors (prior included), mean and scatter of
    their places, kappa; and what a draw needs of them, kept up to date for the one cluster that a row enters or leaves."""

    def __init__(self, p: Params, dim: int, seed: int):
        self.p, self.dim, self.rng = p, dim, np.random.default_rng(seed)
        self.prior = np.full(dim, 1 / math.sqrt(dim)) * p.r0
        self.s = np.tile(self.prior, (p.clusters, 1))
        self.kappa = np.clip(np.exp(0.01 * self.rng.standard_normal(p.clusters) + math.log(100)), p.kappa_low, p.kappa_high)
        self.count = np.zeros(p.clusters)
        self.place = np.tile([[0.0], [0.0], [p.delta0], [0.0], [p.delta0]], (1, p.clusters))  # mean (2), scatter xx, xy, yy
        self.refresh()

    def refresh(self) -> None:
        self.length2 = np.einsum("ij,ij->i", self.s, self.s)
        self.own, self.weight, self.nonempty = np.zeros(self.p.clusters), np.ones(self.p.clusters), int((self.count >= 0.01).sum())
        for k in range(self.p.clusters):
            self._keep(k)

    def _keep(self, k: int) -> None:
        p, n = self.p, float(self.count[k])
        own = math.log(p.alpha + n)
        if p.places:
            xx, xy, yy = self.place[2:, k].tolist()
            m = p.nu0 + n
            own += math.log((n + p.lambda0) / (n + 1 + p.lambda0)) + m / 2 * math.log(max(xx * yy - xy * xy, 1e-300)) + math.log((m - 1) / 2)
            self.weight[k] = (p.lambda0 + n) / (p.lambda0 + n + 1)
        self.own[k] = own

    @property
    def scatter(self) -> np.ndarray:
        return np.stack([self.place[2], self.place[3], self.place[3], self.place[4]], 1).reshape(-1, 2, 2)

    def put(self, x: np.ndarray, d: np.ndarray, k: int, sign: int = 1) -> None:
        """A row enters (sign 1) or leaves (sign -1) a cluster; one undoes the other (see ``add_point``).  A cluster that is
        left empty has the prior's statistics again, without what rounding leaves behind."""
        s, n = self.s[k], float(self.count[k])
        gone = n + sign < 0.01
        if gone:
            s[:] = self.prior
            self.place[:, k] = (0.0, 0.0, self.p.delta0, 0.0, self.p.delta0)
        else:
            s += sign * x
        self.length2[k] = s @ s
        if self.p.places and not gone:
            y, z, xx, xy, yy = self.place[:, k].tolist()
            a, b = float(d[0]), float(d[1])
            held = self.p.lambda0 + n
            if sign < 0:
                y, z = (y * held - a) / (held - 1), (z * held - b) / (held - 1)
                w = -(held - 1) / held
            else:
                w = held / (held + 1)
            p, q = a - y, b - z
            if sign > 0:
                y, z = y + p / (held + 1), z + q / (held + 1)
            self.place[:, k] = (y, z, xx + w * p * p, xy + w * p * q, yy + w * q * q)
        self.nonempty += (n + sign >= 0.01) - (n >= 0.01)
        self.count[k] = n + sign
        self._keep(k)

    def draw(self, x: np.ndarray, d: np.ndarray, log_c: np.ndarray) -> int:
        """A cluster for a row that is in none."""
        p, h = self.p, self.p.clusters
        longer = np.maximum(self.length2 + 2 * (self.s @ x) + float(x @ x), 0)
        norm = log_norm_by_table(np.concatenate([self.kappa, self.kappa]) * np.sqrt(np.concatenate([self.length2, longer])), self.dim)
        lp = self.own + log_c + norm[:h] - norm[h:]
        if p.places:
            y, z, xx, xy, yy = self.place
            u, v = d[0] - y, d[1] - z
            wu = self.weight * u
            a, b, c = xx + wu * u, yy + self.weight * v * v, xy + wu * v
            lp -= (p.nu0 + 1 + self.count) / 2 * np.log(np.maximum(a * b - c * c, 1e-300))
        lp[self.count < 0.01] += empty_weight(p, self.nonempty)
        q = np.cumsum(np.exp(lp - lp.max()))
        return min(int(np.searchsorted(q, self.rng.random() * q[-1])), h - 1)

    def _native(self, mode: int, x: np.ndarray, d: np.ndarray, z: np.ndarray, sweeps: int = 1, walk: bool = False) -> bool:
        """The compiled loops: rows out, drawn and in (mode 0), drawn and in (1), in (2) or out (3), ``sweeps`` times, every
        time with ``move_kappa`` if ``walk``.  False, and nothing done, where they don't run."""
        if not native.running():
            return False
        p = self.p
        native.use_table(self.dim, _grid(self.dim), _bessel_table(self.dim))
        low, high = (math.log(p.kappa_low), math.log(p.kappa_high)) if p.log_walk else (p.kappa_low, p.kappa_high)
        steps = p.kappa_steps if walk else 0
        native.send(
            np.array([1, p.clusters, self.dim, len(x), mode, p.places, sweeps, steps, p.log_walk, p.alpha, p.lambda0, p.nu0, p.virtual, p.delta0, p.c0, p.step, low, high, 0, 0], dtype=float),
            self.prior, self.s, self.length2, self.kappa, self.count, self.place, self.own, self.weight, x, d if p.places else np.zeros(0), z,
        )
        for _ in range(sweeps):
            if mode < 2:
                native.send(self.rng.random(len(x)))
            if steps:
                native.send(self.rng.standard_normal((steps, p.clusters)), self.rng.standard_exponential((steps, p.clusters)))
        h = p.clusters
        s, self.length2, self.kappa, self.count, place, self.own, self.weight, drawn = native.receive(h * self.dim, h, h, h, 5 * h, h, h, len(x))
        self.s, self.place, self.nonempty = s.reshape(h, self.dim), place.reshape(5, h), int((self.count >= 0.01).sum())
        z[:] = drawn
        return True

    def sweep(self, x: np.ndarray, d: np.ndarray, z: np.ndarray, first: bool = False) -> None:
        """One pass over rows in clusters z (changed in place); with ``first`` the rows are in no cluster yet."""
        if self._native(int(first), x, d, z):
            return
        log_c = log_norm_by_table(self.kappa, self.dim)
        for i in range(len(x)):
            if not first:
                self.put(x[i], d[i], z[i], -1)
            z[i] = self.draw(x[i], d[i], log_c)
            self.put(x[i], d[i], z[i])

    def move_kappa(self) -> None:
        p, length = self.p, np.sqrt(self.length2)
        low, high = (math.log(p.kappa_low), math.log(p.kappa_high)) if p.log_walk else (p.kappa_low, p.kappa_high)
        # a step is taken if ln of a uniform number, which is minus an exponential one, is below the gain
        steps, bars = self.rng.standard_normal((p.kappa_steps, p.clusters)), self.rng.standard_exponential((p.kappa_steps, p.clusters))
        now, value = np.log(self.kappa) if p.log_walk else self.kappa, kappa_log_posterior(self.kappa, self.count, length, self.dim, p.c0)
        for normal, bar in zip(steps, bars):
            new = now + p.step * normal
            new = np.clip(np.where(new < low, 2 * low - new, np.where(new > high, 2 * high - new, new)), low, high)
            kappa = np.exp(new) if p.log_walk else new
            worth = kappa_log_posterior(kappa, self.count, length, self.dim, p.c0)
            yes = -bar < worth - value
            now, value, self.kappa = np.where(yes, new, now), np.where(yes, worth, value), np.where(yes, kappa, self.kappa)

    def sweep_all(self, x: np.ndarray, d: np.ndarray, z: np.ndarray, sweeps: int) -> None:
        """Sweeps over rows in clusters z, kappa moving after each."""
        if not self._native(0, x, d, z, sweeps, walk=True):
            for _ in range(sweeps):
                self.sweep(x, d, z)
                self.move_kappa()

    def put_batch(self, x: np.ndarray, d: np.ndarray, z: np.ndarray) -> None:
        if not self._native(2, x, d, z):
            for i in range(len(x)):
                self.put(x[i], d[i], z[i])

    def first_fit(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Random start, then all sweeps."""
        z = self.rng.integers(0, self.p.clusters, len(x))
        self.put_batch(x, d, z)
        self.sweep_all(x, d, z, self.p.sweeps)
        return z

    def add_batch(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """New rows: each is drawn in turn, then the sweeps go over them only."""
        z = np.zeros(len(x), dtype=np.int64)
        self.sweep(x, d, z, first=True)
        self.sweep_all(x, d, z, self.p.sweeps)
        return z

    def remove_batch(self, x: np.ndarray, d: np.ndarray, z: np.ndarray) -> None:
        if not self._native(3, x, d, z):
            for i in range(len(x)):
                self.put(x[i], d[i], z[i], -1)

    def directions(self) -> np.ndarray:
        return self.s / np.linalg.norm(self.s, axis=1, keepdims=True)

    def scores(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Log weight plus log densities of every row and cluster, by the most likely parameters."""
        p = self.p
        out = np.log((p.alpha + self.count) / (p.alpha * p.clusters + self.count.sum())) + log_norm(self.kappa, self.dim) + self.kappa * (x @ self.directions().T)
        if p.places:
            cov = self.scatter / (p.nu0 + self.count + 4)[:, None, None]
            det = cov[:, 0, 0] * cov[:, 1, 1] - cov[:, 0, 1] ** 2
            diff = d[:, None, :] - self.place[:2].T[None]
            quad = (cov[:, 1, 1] * diff[..., 0] ** 2 + cov[:, 0, 0] * diff[..., 1] ** 2 - 2 * cov[:, 0, 1] * diff[..., 0] * diff[..., 1]) / det
            out = out - math.log(2 * math.pi) - 0.5 * np.log(det) - 0.5 * quad
        return out

    def log_likelihood(self, x: np.ndarray, d: np.ndarray) -> float:
        total = 0.0
        for i in range(0, len(x), 4096):  # rows * clusters numbers at a time
            s = self.scores(x[i : i + 4096], d[i : i + 4096])
            top = s.max(1, keepdims=True)
            total += float((top[:, 0] + np.log(np.exp(s - top).sum(1))).sum())
        return total


def hard(scores: np.ndarray) -> np.ndarray:
    """The cluster with the greatest score, the last one of equals."""
    return scores.shape[1] - 1 - scores[:, ::-1].argmax(1)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _zscored(pdf: pd.DataFrame) -> np.ndarray:
    d = pdf[["lat", "lng"]].to_numpy(dtype=float)
    sd = d.std(0, ddof=1) if len(d) > 1 else np.ones(2)
    return (d - d.mean(0)) / np.where(sd > 0, sd, 1)


def seed_of(key, seed: int) -> int:
    """The same number for a window's name in every process."""
    number = int(key) if isinstance(key, (int, np.integer)) else zlib.crc32(str(key).encode())
    return (number * 1_000_003 + seed) % (1 << 62)


def cluster_windows(df: DataFrame, window: str, clusters: int = 200, sweeps: int = 50, seed: int = 0, scores: bool = False, split_rows: int = 4000, params: Params | None = None) -> DataFrame:
    """(window, tid, cluster_id[, scores]): every row of every window with its most likely cluster, the last one of equals.

    Rows: window, tid, lat, lng, vec (not zero).  Coordinates are z-scored within the window.  A window of at most
    ``split_rows`` rows is one task; larger ones are swept in shards of that size (``_shared_sweeps``).  Without a null in
    window; an empty table gives an empty result.
    """
    p = replace(params or Params(), clusters=clusters, sweeps=sweeps)
    kind = dict(df.dtypes)[window]
    schema = f"{window} {kind}, tid bigint, cluster_id int" + (", scores array<double>" if scores else "")

    code = native.compiled(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        native.ready(code)
        pdf = pdf.sort_values("tid", ignore_index=True)
        x, d = _unit(pdf["vec"]), _zscored(pdf)
        m = Mixture(p, x.shape[1], seed_of(pdf[window].iloc[0], seed))
        m.first_fit(x, d)
        s = m.scores(x, d)
        out = pd.DataFrame({window: pdf[window], "tid": pdf["tid"], "cluster_id": hard(s).astype("int32")})
        return out.assign(scores=list(s)) if scores else out

    rows, at = cut(df.select(window, "tid", "lat", "lng", "vec"), "windows")
    size = rows.groupBy(window).agg(F.count("*").alias("_n"))
    large = size.where(F.col("_n") > split_rows).select(window)
    small = rows.join(large, window, "left_anti").groupBy(window).applyInPandas(run, schema)
    if large.isEmpty():
        return small
    return small.unionByName(_shared_sweeps(rows.join(large, window, "left_semi"), window, kind, p, seed, scores, split_rows, schema))


def _statistics(rows: DataFrame, window: str, dim: int) -> DataFrame:
    """(window, z, n, s): plain sums of every cluster: the vectors, the points and the points' products."""
    each = [F.sum(F.col("x")[i]) for i in range(dim)]
    a, b = F.col("d")[0], F.col("d")[1]
    each += [F.sum(a), F.sum(b), F.sum(a * a), F.sum(a * b), F.sum(b * b)]
    return rows.groupBy(window, "z").agg(F.count("*").alias("n"), F.array(*each).alias("s"))


def _shared_sweeps(rows: DataFrame, window: str, kind: str, p: Params, seed: int, scores: bool, shard_rows: int, schema: str) -> DataFrame:
    """Sweeps of large windows in shards.  In a sweep every shard starts from the statistics of the whole window and moves its
    own rows one by one; the statistics are added up again after the sweep, and kappa moves with the window's own seed, so
    it is the same in all its shards.  Every sweep is a written table."""
    spark = rows.sparkSession
    dim = len(rows.select("vec").first()[0])
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
    about = rows.groupBy(window).agg(F.count("*").alias("_n"), *(f(c).alias(f"_{k}{c}") for c in ("lat", "lng") for f, k in ((F.avg, "m"), (F.stddev_samp, "s"))))
    z = [(F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 0, F.col(f"_s{c}")).otherwise(1.0) for c in ("lat", "lng")]
    now = rows.join(F.broadcast(about), window).select(  # one row a window that is too large for a task
        window, "tid", F.transform("vec", lambda v: v.cast("double") / norm).alias("x"), F.array(*z).alias("d"),
        F.pmod(F.xxhash64("tid", F.lit(seed)), F.ceil(F.col("_n") / shard_rows)).cast("int").alias("shard"), F.pmod(F.xxhash64("tid", F.lit(seed + 1)), F.lit(p.clusters)).cast("int").alias("z"),
    )
    now, at = cut(now, "sweep")
    kappa: dict = {}

    def state(stats: pd.DataFrame, key, turn: int, shard: int, last: dict) -> Mixture:
        m = Mixture(p, dim, seed_of(key, seed) + 7919 * turn + shard + 1)
        if key in last:
            m.kappa = last[key].copy()
        else:
            m.kappa = np.clip(np.exp(0.01 * np.random.default_rng(seed_of(key, seed)).standard_normal(p.clusters) + math.log(100)), p.kappa_low, p.kappa_high)
        k, s = stats["z"].to_numpy(), np.array(stats["s"].tolist(), dtype=float).reshape(-1, dim + 5)
        m.count[k] = stats["n"]
        m.s[k] += s[:, :dim]
        if p.places:
            total, squares = np.zeros((p.clusters, 2)), np.zeros((p.clusters, 3))
            total[k], squares[k] = s[:, dim : dim + 2], s[:, dim + 2 :]
            mean, scatter = scatter_of_sums(p, m.count, total, squares)
            m.place = np.stack([mean[:, 0], mean[:, 1], scatter[:, 0, 0], scatter[:, 0, 1], scatter[:, 1, 1]])
        m.refresh()
        return m

    code = native.compiled(spark)
    stats = _statistics(now, window, dim).toPandas()  # bounded: clusters rows for each window that is too large for a task

    def sweep_of(by: dict, before: dict, turn: int):
        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            native.ready(code)
            pdf = pdf.sort_values("tid", ignore_index=True)
            key = pdf[window].iloc[0]
            m = state(by[key], key, turn, int(pdf["shard"].iloc[0]), before)
            c = pdf["z"].to_numpy(dtype=np.int64).copy()
            m.sweep(np.array(pdf["x"].tolist()), np.array(pdf["d"].tolist()), c)
            return pdf.assign(z=c.astype("int32"))

        return step

    for turn in range(p.sweeps):
        before = dict(kappa)
        step = sweep_of({key: g for key, g in stats.groupby(window)}, before, turn)
        nxt, nxt_at = cut(now.groupBy(window, "shard").applyInPandas(step, now.schema), "sweep")
        release(spark, at)
        now, at = nxt, nxt_at
        stats = _statistics(now, window, dim).toPandas()  # bounded as above
        for key, g in stats.groupby(window):
            m = state(g, key, turn, -1, before)
            m.move_kappa()
            kappa[key] = m.kappa
    by = {key: g for key, g in stats.groupby(window)}

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[window].iloc[0]
        s = state(by[key], key, p.sweeps, -1, kappa).scores(np.array(pdf["x"].tolist()), np.array(pdf["d"].tolist()))
        out = pd.DataFrame({window: pdf[window], "tid": pdf["tid"], "cluster_id": hard(s).astype("int32")})
        return out.assign(scores=list(s)) if scores else out

    return now.groupBy(window, "shard").applyInPandas(end, schema)


class Sliding:
    """A window of ``width`` bins that moves over a stream: the first fit waits for ``width`` bins, then every bin is one step."""

    def __init__(self, p: Params, dim: int, width: int, seed: int):
        self.model, self.width, self.held, self.fitted = Mixture(p, dim, seed), width, [], False

    def step(self, bin_id: int, tid: np.ndarray, x: np.ndarray, d: np.ndarray) -> pd.DataFrame | None:
        """Takes the next bin; the rows of the window with their clusters once it is full."""
        if not self.fitted:
            self.held.append([bin_id, tid, x, d, None])
            if len(self.held) < self.width:
                return None
            z = self.model.first_fit(np.concatenate([h[2] for h in self.held]), np.concatenate([h[3] for h in self.held]))
            for h, part in zip(self.held, np.split(z, np.cumsum([len(h[1]) for h in self.held])[:-1])):
                h[4] = part
            self.fitted = True
        else:
            _, _, old_x, old_d, old_z = self.held.pop(0)
            self.model.remove_batch(old_x, old_d, old_z)
            self.held.append([bin_id, tid, x, d, self.model.add_batch(x, d)])
        x, d = np.concatenate([h[2] for h in self.held]), np.concatenate([h[3] for h in self.held])
        return pd.DataFrame({"bin_id": bin_id, "tid": np.concatenate([h[1] for h in self.held]), "cluster_id": hard(self.model.scores(x, d)).astype("int32")})


def slide_windows(df: DataFrame, stream: str, width: int = 6, params: Params = Params(), seed: int = 0) -> DataFrame:
    """(stream, bin_id, tid, cluster_id): for every bin from the ``width``-th on, the rows of the last ``width`` bins.

    Rows: stream, bin_id, tid, vec (not zero) and lat, lng, z-scored already (bins come one by one, so nothing is scaled
    here).  A row with a null vec only says that there is such a bin, which has a window even if it has no rows itself.
    A stream is a chain: one task reads its rows in order of bin and holds ``width`` bins at a time.
    """
    kind = dict(df.dtypes)[stream]
    code = native.compiled(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        native.ready(code)
        at, held, window, before = None, [], None, []

        def close() -> Iterator[pd.DataFrame]:
            nonlocal window, before
            rows = pd.concat(held, ignore_index=True)
            rows = rows[rows["vec"].notna()]
            if window is None and not len(rows):  # the vectors' length isn't known yet
                before.append(int(at[1]))
                return
            x = _unit(rows["vec"]) if len(rows) else np.zeros((0, window.model.dim))
            if window is None:
                window = Sliding(params, x.shape[1], width, seed_of(at[0], seed))
                for b in before[-width:]:  # more bins without rows would change nothing
                    window.step(b, np.zeros(0, np.int64), x[:0], np.zeros((0, 2)))
                before = []
            got = window.step(int(at[1]), rows["tid"].to_numpy(dtype=np.int64), x, rows[["lat", "lng"]].to_numpy(dtype=float))
            if got is not None:
                yield got.assign(**{stream: at[0]})[[stream, "bin_id", "tid", "cluster_id"]]

        for batch in batches:
            for key, part in batch.groupby([stream, "bin_id"], sort=True):
                if at is not None and key != at:
                    yield from close()
                    held = []
                    if key[0] != at[0]:
                        window, before = None, []
                at = key
                held.append(part)
        if held:
            yield from close()

    rows = df.select(stream, "bin_id", "tid", "lat", "lng", "vec").repartitionByRange(stream).sortWithinPartitions(stream, "bin_id", "tid")
    return rows.mapInPandas(run, f"{stream} {kind}, bin_id bigint, tid bigint, cluster_id int")


def batch_mixture(df: DataFrame, group: str, params: Params = PRESETS["batch"], seed: int = 0) -> DataFrame:
    """(group, sweep, log_likelihood, clusters): the trace of a text-only fit of every group (group, tid, vec), one task each."""
    kind = dict(df.dtypes)[group]

    code = native.compiled(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        native.ready(code)
        x = _unit(pdf.sort_values("tid")["vec"])
        d, m = np.zeros((len(x), 2)), Mixture(replace(params, places=False), x.shape[1], seed_of(pdf[group].iloc[0], seed))
        z = m.rng.integers(0, params.clusters, len(x))
        m.put_batch(x, d, z)
        trace = []
        for sweep in range(params.sweeps):
            m.sweep_all(x, d, z, 1)
            trace.append((pdf[group].iloc[0], sweep, m.log_likelihood(x, d), int((m.count > 0).sum())))
        return pd.DataFrame(trace, columns=[group, "sweep", "log_likelihood", "clusters"])

    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, sweep int, log_likelihood double, clusters int")


def em_mixture(df: DataFrame, vec: str, dim: int, clusters: int, rounds: int = 20, seed: int = 0, kappa_low: float = 0.08) -> tuple[DataFrame, list[float]]:
    """((df's columns, cluster_id, score), log likelihood of every round): soft assignment over the whole table.

    ``vec`` must be complete and not zero.  Starts from rows chosen by a seeded hash of the vector.  A round is one pass:
    every batch adds up its responsibilities, vectors and likelihood, and only those sums (clusters * (dim + 2) numbers a
    batch) leave it, so the work grows with the rows and the driver's part doesn't.  kappa = (r dim - r^3) / (1 - r^2).
    """
    first = df.select(vec).distinct().orderBy(F.xxhash64(vec, F.lit(seed)), F.col(vec)).limit(clusters).toPandas()[vec]  # ``clusters`` rows
    mu = _unit(first) if len(first) else np.zeros((0, dim))
    k = len(mu)
    kappa, weight, trace = np.full(k, 10.0), np.full(k, 1 / max(1, k)), []

    def logs(x: np.ndarray, mu, kappa, weight) -> np.ndarray:
        return np.log(np.maximum(weight, 1e-300)) + log_norm(kappa, dim) + kappa * (x @ mu.T)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        x = np.asarray(batch[vec].flatten(), dtype=float).reshape(-1, dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    for _ in range(rounds if k else 0):

        def add(batches: Iterator[pa.RecordBatch], mu=mu, kappa=kappa, weight=weight) -> Iterator[pa.RecordBatch]:
            total, like = np.zeros((k, dim + 1)), 0.0
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch)
                    s = logs(x, mu, kappa, weight)
                    top = s.max(1, keepdims=True)
                    r = np.exp(s - top)
                    norm = r.sum(1, keepdims=True)
                    like += float((top + np.log(norm)).sum())
                    r /= norm
                    total += np.c_[r.T @ x, r.sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(k), -1]), pa.array([*total.tolist(), [like] + [0.0] * dim], pa.list_(pa.float64()))], ["c", "s"])

        sums = df.select(vec).mapInArrow(add, "c bigint, s array<double>").groupBy("c").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(dim + 1))).alias("s"))
        got = {r.c: np.array(r.s) for r in sums.collect()}  # clusters + 1 rows
        trace.append(float(got[-1][0]))
        total = np.array([got[i] for i in range(k)])
        n, length = total[:, dim], np.linalg.norm(total[:, :dim], axis=1)
        mu = np.where(length[:, None] > 0, total[:, :dim] / np.maximum(length, 1e-300)[:, None], mu)
        r = np.clip(length / np.maximum(n, 1e-300), 0, 1 - 1e-9)
        kappa, weight = np.clip((r * dim - r**3) / (1 - r**2), kappa_low, 708.989), n / n.sum()

    names = df.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = logs(matrix(batch), mu, kappa, weight)
                z = hard(s)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z.astype(np.int32)), pa.array(np.take_along_axis(s, z[:, None], 1)[:, 0])], [*names, "cluster_id", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(assign, f"{kinds}, cluster_id int, score double"), trace
