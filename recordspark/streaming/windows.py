"""Event-time windows, sessions, running accumulators over streams (and, for the same result, over tables)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay) if df.isStreaming else df


def windowed(df: DataFrame, time: str, size: str, aggregates: list[Column], by=(), slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows, or, with `slide`, sliding ones; rows later than `delay` are dropped from streams."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _late(df, time, delay).groupBy(w.alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, aggregates: list[Column], by=(), delay: str = "10 minutes") -> DataFrame:
    out = _late(df, time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def accumulate(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key of a stream: count and sum of all so far, after each batch. State lives in Spark's store."""

    def step(k, frames: Iterator[pd.DataFrame], state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def distinct_stream(df: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """First rows of keys, forgotten after `delay`."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
