"""Streaming forms: sliding-baseline dF/F with carried context, and tumbling statistics of chunks of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def online_dff(stream: DataFrame, window: int, lateness: int = 1024) -> DataFrame:
    """(roi, i, v, f0, dff) of a stream (roi, i, v): trailing minimum over `window` samples, without filter.

    State is the last window - 1 samples of a trace and at most `lateness` not yet in order: a sample is emitted once all
    samples before it have come, so rows may arrive in any order and batch boundaries do not matter. A sample that is
    still missing when one `lateness` further on has come is given up: it has no row and windows go without it.
    Samples before the one last emitted or given up are late and dropped. The start is mirrored as in the batch operator.
    """
    if window < 1 or lateness < window:
        raise ValueError("lateness must be at least window, and window at least 1")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, tail, wait = state.get if state.exists else (0, [], [])
        pending = {int(w[0]): float(w[1]) for w in (x.split(":") for x in wait)}
        for t in batches:
            pending.update({int(i): v for i, v in zip(t["i"], t["v"]) if i >= done})
        tail, rows, top = [None if x is None or x != x else x for x in tail], [], max(pending, default=-1)
        if done == 0:
            if not all(k in pending for k in range(window)) and top < window + lateness:
                state.update((0, [], [f"{k}:{v!r}" for k, v in pending.items()]))
                return
            tail = [pending.get(k) for k in range(window - 1, 0, -1)]
        while done in pending or top - done > lateness:
            v = pending.pop(done, None)
            seen = [*tail, v]
            if v is not None:
                f0 = min(x for x in seen if x is not None)
                rows.append((key[0], done, v, f0, (v - f0) / f0 if f0 else None))
            tail = seen[1:] if window > 1 else []
            done += 1
        state.update((done, [float("nan") if x is None else x for x in tail], [f"{k}:{float(v)!r}" for k, v in pending.items()]))
        if rows:
            yield pd.DataFrame(rows, columns=["roi", "i", "v", "f0", "dff"])

    kind = dict(stream.dtypes)["roi"]
    return stream.groupBy("roi").applyInPandasWithState(step, f"roi {kind}, i long, v double, f0 double, dff double", "done long, tail array<double>, wait array<string>", "append", GroupStateTimeout.NoTimeout)


def chunk_statistics(stream: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """(start, roi, n, mean, low, high) of tumbling windows of a stream with event times."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, "roi").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")).select(F.col("window.start").alias("start"), "roi", "n", "mean", "low", "high")
