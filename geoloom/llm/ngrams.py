"""Frequency of every distinct term or n-gram: suffix sorting.

Every position of a record emits the suffix that starts there, cut to ``max_n`` terms.  Suffixes are routed by their
first term, sorted in reverse lexicographic order, and one pass with a stack counts all their prefixes: a prefix stays on
the stack exactly as long as sorted suffixes share it.

Record sets.  A record emits its own suffixes in one place, so it knows for each suffix which of its prefixes it starts
for the first time; that number of first starts travels as a bit mask.  The set of records that hold a prefix is then the
disjoint union of the first starts, and its size is a sum: equal (suffix, mask) rows are merged before the shuffle, and a
hot first term can be spread over ``salts`` routes (by its second term) whose partial counts are added in the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "\x1f"  # between the terms of an n-gram; sorts below every visible character
_EMPTY = pd.DataFrame({"suffix": pd.Series(dtype=str), "mask": pd.Series(dtype="int64"), "cf": pd.Series(dtype="int64")})


def _emit(max_n: int, keep: int = 200_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for terms in batch["terms"]:
                if terms is None:
                    continue
                terms = [t for t in terms if t is not None]
                started = set()
                for i in range(len(terms)):
                    mask, part = 0, None
                    for n in range(1, min(max_n, len(terms) - i) + 1):
                        part = terms[i] if n == 1 else part + SEP + terms[i + n - 1]
                        if part not in started:
                            started.add(part)
                            mask |= 1 << (n - 1)
                    seen[part, mask] += 1
                if len(seen) > keep:
                    yield _rows(seen)
                    seen.clear()
        if seen:
            yield _rows(seen)

    return run


def _rows(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"suffix": [s for s, _ in seen], "mask": [m for _, m in seen], "cf": list(seen.values())})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted suffixes in, counts of all prefixes out; the stack holds [term, occurrences, records]."""
    stack: list[list] = []
    out: list[tuple[str, int, int]] = []

    def pop(depth: int) -> None:
        while len(stack) > depth:
            out.append((SEP.join(x[0] for x in stack), stack[-1][1], stack[-1][2]))
            stack.pop()

    for batch in batches:
        for suffix, mask, cf in zip(batch["suffix"], batch["mask"], batch["cf"]):
            terms = suffix.split(SEP)
            same = 0
            while same < min(len(stack), len(terms)) and stack[same][0] == terms[same]:
                same += 1
            pop(same)
            for t in terms[same:]:
                stack.append([t, 0, 0])
            for n in range(len(terms)):
                stack[n][1] += cf
                stack[n][2] += cf if mask >> n & 1 else 0
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["ngram", "cf", "df"])
            out.clear()
    pop(0)
    if out:
        yield pd.DataFrame(out, columns=["ngram", "cf", "df"])


def ngram_counts(records: DataFrame, terms: str = "terms", max_n: int = 1, salts: int = 8) -> DataFrame:
    """(ngram, n, cf, df): occurrences of every n-gram up to ``max_n`` terms and the number of records that hold it.

    One row of ``records`` is one record; terms are compared exactly as stored.  Null and empty arrays count nothing,
    null terms are skipped (their neighbours become adjacent).  Terms must not hold U+001F.  The terms of an n-gram are
    joined by U+001F.
    """
    suffix = records.select(F.col(terms).alias("terms")).where(F.size("terms") > 0).mapInPandas(_emit(max_n), "suffix string, mask long, cf long")
    parts = F.split("suffix", SEP)
    route = F.pmod(F.xxhash64(parts[0], *([F.pmod(F.xxhash64(F.get(parts, F.lit(1))), F.lit(salts))] if max_n > 1 else [])), F.lit(1 << 30))
    routed = suffix.withColumn("_r", route)
    routed = routed.repartition("_r").sortWithinPartitions(F.desc("suffix")).select("suffix", "mask", "cf")
    counted = routed.mapInPandas(_count, "ngram string, cf long, df long")
    if max_n > 1:  # the routes of one first term each counted a part
        counted = counted.groupBy("ngram").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    return counted.select("ngram", F.size(F.split("ngram", SEP)).cast("bigint").alias("n"), "cf", "df")


def marked(counts: DataFrame, records: int, rare_below: int, common_above: float) -> DataFrame:
    """Adds mark: 'rare' if fewer than ``rare_below`` records hold the term, 'common' if more than that share do, else null."""
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > F.lit(common_above) * records, "common")
    return counts.withColumn("mark", mark)
