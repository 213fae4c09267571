"""Bars, moving means and events over streams of ticks: an addition, checked against the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.market import bars


def streaming_bars(ticks: DataFrame, interval: str = "1 hour", lateness: str = "10 minutes", time: str = "ts", **options) -> DataFrame:
    """Bars that are final once the watermark passes them; ticks later than that are dropped."""
    return bars(ticks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness), interval, time=time, **options)


def streaming_cusum(ticks: DataFrame, threshold: float, key: str = "symbol", time: str = "ts", price: str = "price") -> DataFrame:
    """(key, ts, direction) of cumulative sum events; the state of each key is its last price and two sums."""
    import math

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, up, down = state.get if state.exists else (0.0, 0.0, 0.0)
        hits = []
        rows = pd.concat(list(frames)).sort_values(time)
        for t, p in zip(rows[time], rows[price]):
            if last > 0:
                d = math.log(p / last)
                up, down = max(0.0, up + d), min(0.0, down + d)
                if down < -threshold:
                    hits.append((k[0], t, -1))
                    down = 0.0
                elif up > threshold:
                    hits.append((k[0], t, 1))
                    up = 0.0
            last = p
        state.update((last, up, down))
        yield pd.DataFrame(hits, columns=[key, "ts", "direction"])

    rows = ticks.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), price)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, ts timestamp, direction int", "last double, up double, down double", "append", "NoTimeout")


def streaming_counts(events: DataFrame, interval: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(by, start, end, n) over tumbling or sliding windows."""
    w = F.window(time, interval, slide) if slide else F.window(time, interval)
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return rows.groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
