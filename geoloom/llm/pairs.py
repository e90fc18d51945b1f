"""Items that appear together: an incremental table of pair counts.

A basket is a record with a set of items.  The table keeps, in one folder, how many baskets hold each item (marginals), how
many hold each pair, how many baskets there are, and the association scores of the pairs.  A change is a basket with its
items before and after; it becomes signed deltas (+1 for what it gains, -1 for what it loses), and only deltas are
shuffled.  Counts are stored in hash buckets: merging rewrites only the buckets that a delta falls into.  What a score
needs of a pair (its count and the marginals of both items) is stored beside it and written again for the buckets in which
a pair or one of its items moved; the number of baskets, which moves every score alike, is applied when scores are read.

A version becomes visible as a whole: items, pairs and scores are written first, then a manifest (version, number of
baskets, the version that holds each bucket) is renamed into place.  What a failed change wrote is never read, and the next
change removes it.  A table on a path of its own can be opened again, by another application too.

Deltas are summed on the map side before the shuffle, so an item held by a third of all baskets costs one row a task.  Pairs
are made inside a basket only, one at a time: no list of a basket's pairs is ever held.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.storage import cut, file_system, new_path, release

_SCHEMA = {
    "items": "item string, n bigint",
    "pairs": "a string, b string, n bigint",
    "scores": "a string, b string, n_a bigint, n_b bigint, n_ab bigint",
}
_KEYS = {"items": ["item"], "pairs": ["a", "b"], "scores": ["a", "b"]}


def _items(baskets: DataFrame, column: str, sign: int) -> DataFrame:
    return baskets.select(F.explode(column).alias("item"), F.lit(sign).cast("bigint").alias("n"))


def _pairs(baskets: DataFrame, column: str, sign: int) -> DataFrame:
    """(a, b, n): all pairs a < b (by code point) of a sorted array without repeats, an item against the slice behind it."""
    one = baskets.where(F.size(column) > 1).select(column, F.posexplode(column).alias("_i", "a"))
    behind = F.slice(column, F.col("_i") + 2, F.size(column))
    return one.select("a", F.explode(behind).alias("b"), F.lit(sign).cast("bigint").alias("n"))


class PairTable:
    """Persistent counts of items and pairs over baskets.

    ``apply`` takes rows (before array<string>, after array<string>), one for each changed basket: null before is a new
    basket, null after a deleted one; repeated and null items in a basket count once and not at all.  Baskets without
    items count in the total.  An empty change gives a version with the same counts.

    ``path``: a table of its own, opened if it is there already (its own ``buckets`` and ``min_both`` then hold); without,
    the table goes with the application.  ``min_both``: scores are kept of pairs in at least so many baskets.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, min_both: int = 1):
        self.spark, self.path = spark, path or new_path(spark, "pairs")
        self.buckets, self.min_both = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), min_both
        self.version, self.total = 0, 0
        self.where: dict[str, dict[int, int]] = {kind: {} for kind in _SCHEMA}  # bucket -> version that holds it; as many entries as buckets
        self.stale: set[int] = set()  # buckets whose scores are behind their counts
        at, files = file_system(spark, f"{self.path}/manifest")
        if files.exists(at):
            known = [s.getPath().getName() for s in files.listStatus(at)]
            done = sorted(n for n in known if n.endswith(".json") and not n.startswith("."))
            if done:
                m = json.loads(spark.read.text(f"{self.path}/manifest/{done[-1]}", wholetext=True).first()[0])
                self.version, self.total, self.buckets, self.min_both = m["version"], m["total"], m["buckets"], m["min_both"]
                self.where, self.stale = {kind: {int(b): v for b, v in held.items()} for kind, held in m["where"].items()}, set(m["stale"])

    def _read(self, kind: str, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/v={v}/bucket={b}" for b, v in sorted(self.where[kind].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(_SCHEMA[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA[kind])

    def _bucket(self, kind: str) -> Column:
        return F.pmod(F.hash(*_KEYS[kind]), F.lit(self.buckets))

    def _write(self, kind: str, rows: DataFrame, touched: set[int] | None) -> None:
        """Writes the new content of the touched buckets (of all if None) as files of the next version."""
        out = f"{self.path}/{kind}/v={self.version + 1}"
        release(self.spark, out)  # of a change that failed
        rows.withColumn("bucket", self._bucket(kind)).write.partitionBy("bucket").parquet(out)
        at, files = file_system(self.spark, out)
        written = {int(s.getPath().getName().split("=")[1]) for s in files.listStatus(at) if s.getPath().getName().startswith("bucket=")}
        kept = {} if touched is None else {b: v for b, v in self.where[kind].items() if b not in touched}
        self.where[kind] = {**kept, **dict.fromkeys(written, self.version + 1)}

    def _merge(self, kind: str, deltas: DataFrame, at: str | None = None) -> set[int] | None:
        """Adds deltas to the stored counts; the buckets that were written, None for all.  ``at``: where the deltas are written
        already, summed."""
        keys, touched = _KEYS[kind], None
        summed = deltas if at else deltas.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
        if not self.where[kind]:
            self._write(kind, summed, None)
            return None
        if not at:
            summed, at = cut(summed, "deltas")
        touched = {r[0] for r in summed.select(self._bucket(kind)).distinct().collect()}  # at most one row a bucket
        stored = self._read(kind, touched)
        self._write(kind, summed.unionByName(stored).groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0), touched)
        if kind == "pairs":
            release(self.spark, at)
        return touched

    def _score(self, touched: set[int] | None, changed: DataFrame | None) -> None:
        if touched is not None:
            touched = touched | self.stale
        if touched is not None and len(touched) < self.buckets and changed is not None:
            pair = self._read("pairs").where(F.col("n") >= self.min_both)
            hit = changed.select("item").distinct()
            moved = pair.join(hit.withColumnRenamed("item", "a"), "a", "left_semi").unionByName(pair.join(hit.withColumnRenamed("item", "b"), "b", "left_semi").select("a", "b", "n"))
            touched = touched | {r[0] for r in moved.select(self._bucket("pairs")).distinct().collect()}  # at most one row a bucket
        # exact pruning: an item of a pair in n baskets is itself in n baskets at least
        item = self._read("items").where(F.col("n") >= self.min_both)
        pair = self._read("pairs", touched).where(F.col("n") >= self.min_both).withColumnRenamed("n", "n_ab")
        a = item.select(F.col("item").alias("a"), F.col("n").alias("n_a"))
        b = item.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
        self._write("scores", pair.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "n_ab"), touched)
        self.stale = set()

    def apply(self, changes: DataFrame, scores: bool = True) -> None:
        """Merges a change.  Without ``scores`` their recomputation is left to a later change that has it; until then
        ``scores()`` raises."""

        def clean(c: str) -> Column:
            return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))

        ch = changes.select(F.col("before").isNull().alias("_born"), F.col("after").isNull().alias("_dead"), clean("before").alias("_o"), clean("after").alias("_n"))
        held, behind = dict(self.where), set(self.stale)
        first = not self.version
        grown = ch.agg(F.sum(F.col("_born").cast("int") - F.col("_dead").cast("int"))).first()[0] or 0
        try:
            # a basket that keeps an item moves neither its count nor, with another one kept, their pair's
            item = _items(ch, "_n", 1) if first else _items(ch, "_n", 1).unionByName(_items(ch, "_o", -1))
            pair = _pairs(ch, "_n", 1) if first else _pairs(ch, "_n", 1).unionByName(_pairs(ch, "_o", -1))
            moved = None
            if not first:
                moved, at = cut(item.groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") != 0), "moved")
                item = moved
            self._merge("items", item, None if first else at)
            touched = self._merge("pairs", pair)
            if scores:
                self._score(touched, moved)
            else:  # the marginals of any pair may have moved
                self.stale = set(range(self.buckets))
            self._commit(self.total + int(grown))
            if not first:
                release(self.spark, at)
        except BaseException:
            self.where, self.stale = held, behind
            raise

    def _commit(self, total: int) -> None:
        done = {"version": self.version + 1, "total": total, "buckets": self.buckets, "min_both": self.min_both, "where": self.where, "stale": sorted(self.stale)}
        tmp, files = file_system(self.spark, f"{self.path}/manifest/.{self.version + 1:08d}.tmp")
        out = files.create(tmp, True)
        out.write(bytearray(json.dumps(done).encode()))
        out.close()
        if not files.rename(tmp, file_system(self.spark, f"{self.path}/manifest/{self.version + 1:08d}.json")[0]):
            raise RuntimeError(f"version {self.version + 1} of {self.path} is there already: another writer")
        self.version, self.total = self.version + 1, total

    def items(self) -> DataFrame:
        """(item, n): the number of baskets that hold each item."""
        return self._read("items")

    def pairs(self) -> DataFrame:
        """(a, b, n): the number of baskets that hold both items, a < b."""
        return self._read("pairs")

    def scores(self, min_both: int | None = None, changed: DataFrame | None = None) -> DataFrame:
        """(a, b, n_a, n_b, n_ab, lift) as stored: lift is the ratio of n_ab to the number expected by chance.

        ``min_both``: at least the table's own.  ``changed`` (item): only pairs with one of these items; the lift of every
        other pair moved only by the number of baskets.
        """
        if min_both is not None and min_both < self.min_both:
            raise ValueError(f"this table keeps scores of pairs in at least {self.min_both} baskets")
        if self.stale:
            raise ValueError("scores are behind the counts: apply a change with scores")
        pair = self._read("scores").where(F.col("n_ab") >= (min_both or self.min_both))
        if changed is not None:
            hit = changed.select("item").distinct()
            pair = pair.join(hit.withColumnRenamed("item", "a"), "a", "left_semi").unionByName(
                pair.join(hit.withColumnRenamed("item", "b"), "b", "left_semi").join(hit.withColumnRenamed("item", "a"), "a", "left_anti")
            )
        lift = F.col("n_ab").cast("double") * self.total / (F.col("n_a").cast("double") * F.col("n_b"))
        return pair.select("a", "b", "n_a", "n_b", "n_ab", lift.alias("lift"))

    def vacuum(self) -> None:
        """Removes buckets and manifests that the current version does not use; readers of older versions lose them."""
        for kind, held in self.where.items():
            at, files = file_system(self.spark, f"{self.path}/{kind}")
            for v in files.listStatus(at) if files.exists(at) else []:
                for b in files.listStatus(v.getPath()):
                    name = b.getPath().getName()
                    if name.startswith("bucket=") and held.get(int(name.split("=")[1])) != int(v.getPath().getName().split("=")[1]):
                        files.delete(b.getPath(), True)
        at, files = file_system(self.spark, f"{self.path}/manifest")
        for m in files.listStatus(at) if files.exists(at) else []:
            if m.getPath().getName() != f"{self.version:08d}.json":
                files.delete(m.getPath(), False)

    def drop(self) -> None:
        release(self.spark, self.path)


def post_words(posts: DataFrame) -> DataFrame:
    """(tid, words): one row for each tid; repeated rows collapse, of different texts the least is kept."""
    return posts.where(F.col("tid").isNotNull()).groupBy("tid").agg(F.min("words").alias("words"))
