"""Streams of posts: anchored bins, window counts and sliding sums of places with state; see ``mixture`` for the clusterer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_anchored_bins(posts: DataFrame, key: str, limit: int = 1800, event_time: str = "at", late: str = "1 hour") -> DataFrame:
    """(key, tid, ts, bin_id, bin_start) for a stream (key, tid, ts, event time): each key keeps the start and number of its
    open bin as state.

    Rows are taken in order of ts inside a micro-batch; a row older than the open bin stays in it.  Rows behind the watermark
    (``late``) are dropped before they reach the state.
    """
    kind = dict(posts.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "tid"], ignore_index=True)
        start, number = state.get if state.exists else (None, -1)
        ids, starts = [], []
        for t in rows["ts"]:
            if start is None or t - start > limit:
                start, number = int(t), number + 1
            ids.append(number)
            starts.append(start)
        state.update((start, number))
        yield pd.DataFrame({key: k[0], "tid": rows["tid"], "ts": rows["ts"], "bin_id": ids, "bin_start": starts})

    s = posts.where("ts is not null").withWatermark(event_time, late).select(key, "tid", "ts", event_time)
    return s.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, tid bigint, ts bigint, bin_id bigint, bin_start bigint", "start bigint, number bigint", "append", "NoTimeout")


def stream_window_counts(posts: DataFrame, event_time: str = "at", size: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(window, n): tumbling windows on the clock with a watermark; not the same as anchored bins."""
    return posts.withWatermark(event_time, late).groupBy(F.window(event_time, size)).agg(F.count("*").alias("n"))


def stream_sliding_statistics(binned: DataFrame, key: str, width: int = 6) -> DataFrame:
    """(key, bin_id, n, lat, lng): count and mean place of the last ``width`` bins, emitted whenever a new bin opens.

    State per key: the sums of the bins in the window, oldest first; a new bin adds its sums and evicts the oldest, so the
    statistics never need the posts again.
    """
    kind = dict(binned.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("bin_id", ignore_index=True)
        ids, n, y, x = (list(v) for v in state.get) if state.exists else ([], [], [], [])
        out = []
        for b, g in rows.groupby("bin_id"):
            add = (len(g), float(g["lat"].sum()), float(g["lng"].sum()))
            if ids and b <= ids[-1]:
                if b in ids:
                    i = ids.index(b)
                    n[i], y[i], x[i] = n[i] + add[0], y[i] + add[1], x[i] + add[2]
            else:
                ids.append(int(b)), n.append(add[0]), y.append(add[1]), x.append(add[2])
                while ids[0] <= b - width:
                    ids.pop(0), n.pop(0), y.pop(0), x.pop(0)
            out.append((k[0], int(b), sum(n), sum(y) / sum(n), sum(x) / sum(n)))
        state.update((ids, n, y, x))
        yield pd.DataFrame(out, columns=[key, "bin_id", "n", "lat", "lng"])

    return binned.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, bin_id bigint, n bigint, lat double, lng double", "ids array<bigint>, n array<bigint>, y array<double>, x array<double>", "append", "NoTimeout")
