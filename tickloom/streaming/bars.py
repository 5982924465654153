"""Streaming bars by watermarked windows, and recursive indicators with per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(records: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, tiebreak: Column, *, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) per window; records later than ``delay`` are dropped.

    State is one row per open window and key: open and close are kept as
    min_by/max_by aggregates, not as buffered records.
    """
    rows = records.select(symbol.alias("symbol"), ts.cast("timestamp").alias("_ts"), price.alias("_p"), volume.alias("_v"), tiebreak.alias("_k")).withWatermark("_ts", delay)
    window = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    key = F.struct("_ts", "_k")
    bars = rows.groupBy("symbol", window.alias("_w")).agg(
        F.min_by("_p", key).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", key).alias("close"), F.sum("_v").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def session_vwap(records: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, *, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(symbol, start, end, vwap) of sessions that end after ``gap`` without a record."""
    rows = records.select(symbol.alias("symbol"), ts.cast("timestamp").alias("_ts"), price.alias("_p"), volume.alias("_v")).withWatermark("_ts", delay)
    sums = rows.groupBy("symbol", F.session_window("_ts", gap).alias("_s")).agg(F.sum(F.col("_p") * F.col("_v")).alias("pv"), F.sum("_v").alias("v"))
    return sums.select("symbol", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.when(F.col("v") != 0, F.col("pv") / F.col("v")).alias("vwap"))


def stream_ema(bars: DataFrame, period: int = 20, *, alpha: float | None = None, value: str = "close") -> DataFrame:
    """(symbol, ts, ema): first-value seed, one double of state per symbol.

    Rows of a micro-batch are taken in time order; a row older than the last one
    seen for its symbol is dropped, since its place in the recursion has passed.
    """
    rate = 2 / (period + 1) if alpha is None else alpha

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, level = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, x in zip(rows["ts"], rows["value"]):
            if last is not None and ts <= last or x != x:
                continue
            level = x if level is None else rate * x + (1 - rate) * level
            last = ts
            out.append((key[0], ts, level))
        if last is not None:
            state.update((last, level))
        yield pd.DataFrame(out, columns=["symbol", "ts", "ema"])

    source = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return source.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, ema double", "ts timestamp, level double", "append", GroupStateTimeout.NoTimeout)
