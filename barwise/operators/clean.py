"""Cleaning and scaling of price series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barwise.functions.frames import rolling, running
from barwise.operators.quantiles import quantiles
from barwise.session import bounded, stored


def clip_quantile(df: DataFrame, value: str = "price", low: float = 0.01, high: float = 0.99, by: str = "symbol") -> DataFrame:
    """``df`` with ``clipped``: ``value`` kept between two exact quantiles of its group; nulls stay null."""
    q = quantiles(df, value, [by], [low, high]).select(by, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    x = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo")))
    return df.join(bounded(q), by).withColumn("clipped", x).drop("_lo", "_hi")


def clip_range(x: Column, low: float, high: float) -> Column:
    """``x`` kept between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def changes(df: DataFrame) -> DataFrame:
    """``df`` with ``diff``, ``log_price``, ``log_diff`` and ``pct`` against the row before; null at the start."""

    def make(w: WindowSpec) -> dict[str, Column]:
        prev = F.lag("price").over(w)
        return {"diff": F.col("price") - prev, "log_price": F.ln("price"), "log_diff": F.ln("price") - F.ln(prev), "pct": F.try_divide(F.col("price"), prev) - 1}

    return rolling(df, make, back=1)


def moments(df: DataFrame, value: str, by: list[str], sample: bool) -> DataFrame:
    """``by, _mean, _std`` of a column; the standard deviation with n - 1 if ``sample``, else n."""
    return df.groupBy(*by).agg(F.avg(value).alias("_mean"), (F.stddev_samp if sample else F.stddev_pop)(value).alias("_std"))


def zscore(df: DataFrame, value: str, name: str = "z", by: tuple[str, ...] = ("symbol",), sample: bool = False, absolute: bool = False) -> DataFrame:
    """``df`` with (value - mean) / std of its group; null where the group does not vary."""
    d = df.join(bounded(moments(df, value, list(by), sample)), list(by))
    c = F.col(value) - F.col("_mean")
    return d.withColumn(name, F.try_divide(F.abs(c) if absolute else c, F.col("_std"))).drop("_mean", "_std")


def align(df: DataFrame, value: str = "price") -> DataFrame:
    """``df`` with ``aligned``: ``value`` over the first value of its symbol."""
    first = df.groupBy("symbol").agg(F.min_by(value, F.struct("ts", "tie")).alias("_first"))
    return df.join(bounded(first), "symbol").withColumn("aligned", F.try_divide(F.col(value), F.col("_first"))).drop("_first")


def consistent_log_price(df: DataFrame, variance: float = 0.01) -> DataFrame:
    """``df`` with ``consist``: running sum of |z| of log changes times ``variance``, as the reference computes it from aligned prices."""
    z = zscore(changes(align(df).withColumn("price", F.col("aligned"))), "log_diff", "_z", absolute=True)
    return running(z, sums={"consist": F.coalesce(F.col("_z"), F.lit(0.0)) * variance})


def normalised_rates(df: DataFrame, target: float = 0.01) -> DataFrame:
    """``symbol, ts, rate, close, hour, weekday``: rates p / p_prev (first 1), winsorised at 1 % and 99 %, scaled to
    a population deviation of ``target``, compounded; hour and weekday (Monday 0) of ``ts``."""
    r = stored(changes(df).select("symbol", "ts", "tie", "rn", F.coalesce(F.col("pct") + 1, F.lit(1.0)).alias("rate")))
    r = clip_quantile(r, "rate").withColumn("_x", F.col("clipped") - 1)
    std = r.groupBy("symbol").agg(F.stddev_pop("_x").alias("_s"))
    r = r.join(bounded(std), "symbol").withColumn("_scaled", F.when(F.col("rn") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("_x") * target, F.col("_s"))))
    # compounding as a running sum of logarithms
    r = running(r.withColumn("scaled", F.col("_scaled")), sums={"log_close": F.ln(F.col("_scaled") + 1)})
    return r.select("symbol", "ts", "tie", F.col("scaled").alias("rate"), F.exp("log_close").alias("close"), "log_close", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))
