"""The sliding mixture as a stateful stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from geoloom.operators import native
from geoloom.operators.mixture import Params, Sliding, _unit, seed_of


def stream_mixture(binned: DataFrame, stream: str, width: int = 6, params: Params = Params(), seed: int = 0) -> DataFrame:
    """(stream, bin_id, tid, cluster_id): ``slide_windows`` over a stream (stream, bin_id, tid, lat, lng, vec), coordinates
    scaled already.

    A bin is taken in when the first row of a later one arrives; rows of bins taken in already are left out, so give the rows
    behind a watermark.  State per stream: the sampler (its statistics), the rows of its ``width`` bins and of the open bin.
    """
    kind = dict(binned.dtypes)[stream]
    code = native.compiled(binned.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        native.ready(code)
        window, open_bin, held, last = pickle.loads(bytes(state.get[0])) if state.exists else (None, None, [], None)
        rows = pd.concat(list(batches))
        for bin_id, part in rows.groupby("bin_id", sort=True):
            if last is not None and bin_id <= last or open_bin is not None and bin_id < open_bin:
                continue
            if open_bin is not None and bin_id > open_bin:
                full = pd.concat(held, ignore_index=True).sort_values("tid", ignore_index=True)
                x = _unit(full["vec"])
                if window is None:
                    window = Sliding(params, x.shape[1], width, seed_of(key[0], seed))
                got = window.step(int(open_bin), full["tid"].to_numpy(), x, full[["lat", "lng"]].to_numpy(dtype=float))
                last, held = open_bin, []
                if got is not None:
                    yield got.assign(**{stream: key[0]})[[stream, "bin_id", "tid", "cluster_id"]]
            open_bin = int(bin_id)
            held.append(part)
        state.update((pickle.dumps((window, open_bin, held, last)),))

    rows = binned.select(stream, "bin_id", "tid", "lat", "lng", "vec")
    return rows.groupBy(stream).applyInPandasWithState(step, f"{stream} {kind}, bin_id bigint, tid bigint, cluster_id int", "held binary", "append", "NoTimeout")
