"""Ticks into bars.

Bars by time and by a number of ticks close at places that a window expression finds, so
they are plain aggregations.  Bars by volume, value or imbalance restart their sum at every
close: that is a fold over the symbol's ticks, which runs over the sorted stream of a
partition in constant memory, whatever the length of the series.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.frames import numbered, rolling, running
from barwise.operators.indicators import signed_changes
from barwise.session import epoch_us, floor_div

METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "ticks": lambda p, v, s: F.lit(1.0),
    "volume_imbalance": lambda p, v, s: v,
    "dollar_value_imbalance": lambda p, v, s: p * v,
    "signal_imbalance": lambda p, v, s: s,
    "signal_volume_imbalance": lambda p, v, s: s * v,
    "signal_dollar_value_imbalance": lambda p, v, s: s * p * v,
}


def _summary(df: DataFrame, bar: str, *more: Column) -> DataFrame:
    """One row per (symbol, bar) with the statistics every kind of bar carries."""
    value, order = F.col("price") * F.col("volume"), F.struct("ts", "tie")
    side = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    up, down = F.col("sign") > 0, F.col("sign") < 0
    return df.groupBy("symbol", bar).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("ticks"),
        F.count_if(up).alias("long_ticks"), F.count_if(down).alias("short_ticks"),
        F.sum("volume").alias("volume"), side(up, F.col("volume")).alias("long_volume"), side(down, F.col("volume")).alias("short_volume"),
        F.sum(value).alias("dollar"), side(up, value).alias("long_dollar"), side(down, value).alias("short_dollar"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"), *more,
    )


def time_bars(df: DataFrame, seconds: int) -> DataFrame:
    """Bars that close with the first tick at or after each boundary of ``seconds``; that tick belongs to the closing bar.

    The unfinished last bar is not given.  A symbol whose ticks cross no boundary gives no bars.
    """
    q = floor_div(epoch_us("ts"), seconds * 1_000_000)
    d = signed_changes(df, lambda w: q > F.lag(q).over(w)).withColumn("bar", F.col("upto") - F.col("mark"))
    return _summary(d.filter("bar < marked"), "bar")


def tick_bars(df: DataFrame, n: int) -> DataFrame:
    """Bars of ``n`` ticks; the first tick never closes one, so that with ``n`` of 1 (or less) the first bar has two.  The unfinished last one is not given."""
    if n <= 1:
        d = signed_changes(df).withColumn("bar", F.greatest(F.col("rn") - 1, F.lit(0)))
        return _summary(d, "bar").filter((F.col("bar") > 0) | (F.col("ticks") == 2))
    return _summary(signed_changes(df).withColumn("bar", floor_div(F.col("rn"), n)), "bar").filter(F.col("ticks") == n)


Step = Callable[[dict, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _folded(d: DataFrame, imbalance: Column, step: Step) -> DataFrame:
    """Bars from a fold: ``step(state, imbalances, row numbers)`` gives each row's bar and whether it closes it.

    Rows stream through sorted by symbol and time with their bar added; between batches only the symbol's state is kept.
    """
    cols = ["symbol", "ts", "tie", "price", "high", "low", "volume", "sign"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            rn, x = b.column(len(cols)).to_numpy(), b.column(len(cols) + 1).to_numpy()
            bar, closes = np.empty(len(x), "int64"), np.zeros(len(x), bool)
            edges = np.unique(np.r_[0, np.flatnonzero(rn == 0), len(x)])
            for i, j in zip(edges, edges[1:]):
                if rn[i] == 0:
                    state = {"bar": 0}
                bar[i:j], closes[i:j] = step(state, x[i:j], rn[i:j])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(bar), pa.array(closes)], names=[*cols, "bar", "closes"])

    rows = d.select(*cols, "rn", imbalance.cast("double").alias("x")).repartition("symbol").sortWithinPartitions("symbol", "rn")
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in cols)
    made = rows.mapInArrow(run, f"{kinds}, bar long, closes boolean")
    return _summary(made, "bar", F.max("closes").alias("closed")).filter("closed").drop("closed")


def _ascending(threshold: float) -> Step:
    """Closes of a metric that is never negative: from one to the next by a search in the running sum."""

    def step(state: dict, x: np.ndarray, rn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run, closes, at, open_ = np.cumsum(x), np.zeros(len(x), bool), 0, state.get("sum", 0.0)
        while at < len(x):
            base = (run[at - 1] if at else 0.0) - open_
            # the search finds the place, the sum from the last close on decides at its edge
            k = max(at, int(np.searchsorted(run, base + threshold)) - 1)
            while k < len(x) and (run[k] - base < threshold or rn[k] == 0):
                k += 1
            if k == len(x):
                break
            closes[k] = True
            at, open_ = k + 1, 0.0
        state["sum"] = open_ + (float(run[-1]) - (float(run[at - 1]) if at else 0.0)) if at < len(x) else 0.0
        done = np.cumsum(closes)
        bar = state["bar"] + done - closes
        state["bar"] += int(done[-1])
        return bar, closes

    return step


def _two_sided(threshold: float) -> Step:
    """Closes of a metric of either sign, row by row."""

    def step(state: dict, x: np.ndarray, rn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bar, total, out, closed = state["bar"], state.get("sum", 0.0), [], []
        for v, i in zip(x.tolist(), rn.tolist()):
            total += v
            out.append(bar)
            done = total >= threshold and i > 0
            closed.append(done)
            if done:
                bar, total = bar + 1, 0.0
        state.update(bar=bar, sum=total)
        return np.array(out), np.array(closed)

    return step


def constant_bars(df: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Bars that close when the running sum of a metric since the last close reaches ``threshold`` (one-sided; what
    overshoots is not carried over); the first tick of a symbol never closes one, the unfinished last bar is not given."""
    step = _two_sided(threshold) if metric.startswith("signal") else _ascending(threshold)
    return _folded(signed_changes(df), METRICS[metric](F.col("price"), F.col("volume"), F.col("sign")), step)


def decaying(weight: float, size: int) -> list[float]:
    """``size`` weights for values from old to new: of what the newer ones leave of 1 each takes the share ``weight``; in all 1."""
    left, out = 1.0, []
    for _ in range(size):
        out.append(left * weight)
        left -= out[-1]
    return [w / (1.0 - left) for w in reversed(out)]


def ema_bars(df: DataFrame, metric: str, expected_ticks: float, expected_imbalance: float, weight: float = 0.8, size: int = 5) -> DataFrame:
    """Bars whose threshold follows the data: expected imbalance per tick times expected ticks per bar.

    After a close both expectations become means, weighted by :func:`decaying`, of the last ``size`` tick imbalances
    and bar lengths, once there are as many.  A bar's length is the distance between closing
    ticks, the first one counting from the first tick.
    """
    w = decaying(weight, size)

    def mean(values: deque, default: float) -> float:
        return sum(map(mul, w, values)) if len(values) == size else default

    def step(state: dict, x: np.ndarray, rn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, level, recent, lengths, last = state.get("fold") or (0.0, (float(expected_imbalance), float(expected_ticks)), deque(maxlen=size), deque(maxlen=size), 0)
        closed = []
        for v, i in zip(x.tolist(), rn.tolist()):
            total += v
            recent.append(v)
            closed.append(total >= level[0] * level[1])
            if closed[-1]:
                lengths.append(float(i - last))
                total, level, last = 0.0, (mean(recent, level[0]), mean(lengths, level[1])), i
        state["fold"] = (total, level, recent, lengths, last)
        closes = np.array(closed, bool)
        done = np.cumsum(closes)
        bar = state["bar"] + done - closes
        state["bar"] += int(done[-1])
        return bar, closes

    return _folded(signed_changes(df), METRICS[metric](F.col("price"), F.col("volume"), F.col("sign")), step)


def resample_last(df: DataFrame, seconds: int, columns: list[str]) -> DataFrame:
    """``symbol, bucket_ts`` and the last known value of each column per clock bucket; empty buckets between the first and last are null."""
    us = seconds * 1_000_000
    b = floor_div(epoch_us("ts"), us)
    order = F.struct("ts", "tie")
    got = df.groupBy("symbol", b.alias("_b")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])
    spine = got.groupBy("symbol").agg(F.min("_b").alias("_a"), F.max("_b").alias("_z")).select("symbol", F.explode(F.sequence("_a", "_z")).alias("_b"))
    at = F.timestamp_add("SECOND", F.col("_b") * seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return spine.join(got, ["symbol", "_b"], "left").select("symbol", at.alias("bucket_ts"), *columns)


def bars_at(df: DataFrame, ends: DataFrame) -> DataFrame:
    """Ticks grouped by given bar ends (``symbol, end_ts``): each tick to the first end at or after it, and the first tick
    after an end to that end's bar as well as its close.  Ticks after the last such tick are left out."""
    marks = ends.select("symbol", F.col("end_ts").alias("ts")).distinct()
    both = df.select("symbol", "ts", "tie", "price", "volume", F.lit(1).alias("_t")).unionByName(marks.withColumn("tie", F.lit(-(2**62)).cast(df.schema["tie"].dataType)), allowMissingColumns=True)
    d = numbered(both)
    mark = F.col("_t").isNull()
    # a tick belongs to the next close, and the closing tick is the first one after the mark
    d = rolling(d, lambda w: {"closer": F.coalesce(~mark & F.lag(mark).over(w), F.lit(False)).cast("long")}, back=1)
    d = running(d.withColumnRenamed("_t", "tick"), sums={"upto": F.col("closer")}, totals={"upto": "closed"})
    d = d.withColumn("bar", F.col("upto") - F.col("closer")).filter("tick = 1 and bar < closed")
    return d.groupBy("symbol", "bar").agg(F.count(F.lit(1)).alias("ticks"), F.sum("volume").alias("volume"), F.max("ts").alias("end_ts"), F.max_by("price", F.struct("ts", "tie")).alias("close"))
