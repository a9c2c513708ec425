"""Streaming forms of the resamplers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def clock_bars(ticks: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Last, first, highest, lowest price and total volume per symbol and clock window of a stream ``symbol, ts, price, volume``.

    Ticks later than the watermark are dropped; a window is given once the watermark has passed it.
    """
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = t.groupBy("symbol", F.window("ts", every).alias("w"))
    return g.agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"),
    ).select("symbol", F.col("w.start").alias("start_ts"), "open", "high", "low", "close", "volume", "ticks")


class _Threshold(StatefulProcessor):
    """Keeps the open bar of a symbol between micro-batches."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bar = handle.getValueState("bar", "start_ts timestamp, ticks long, volume double, high double, low double, open double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        pdf = pd.concat(list(rows)).sort_values("ts")
        s = list(self.bar.get()) if self.bar.exists() else None
        out = []
        for ts, price, volume in zip(pdf["ts"], pdf["price"], pdf["volume"]):
            if s is None:
                s = [ts, 0, 0.0, price, price, price]
            s[1], s[2], s[3], s[4] = s[1] + 1, s[2] + volume, max(s[3], price), min(s[4], price)
            if s[2] >= self.threshold:
                out.append((key[0], s[0], ts, int(s[1]), float(s[2]), float(s[3]), float(s[4]), float(s[5]), float(price)))
                s = None
        if s is None:
            self.bar.clear()
        else:
            self.bar.update((s[0], int(s[1]), float(s[2]), float(s[3]), float(s[4]), float(s[5])))
        yield pd.DataFrame(out, columns=["symbol", "start_ts", "end_ts", "ticks", "volume", "high", "low", "open", "close"])

    def close(self) -> None:
        pass


def volume_bars_stream(ticks: DataFrame, threshold: float) -> DataFrame:
    """Bars that close when the volume since the last close reaches ``threshold``, over a stream; needs the RocksDB state store."""
    return ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price", "volume").groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_Threshold(threshold), outputStructType="symbol string, start_ts timestamp, end_ts timestamp, ticks long, volume double, high double, low double, open double, close double",
        outputMode="append", timeMode="none",
    )
