"""Technical indicators, micro-structure measures and features over rows of a symbol."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate, takewhile

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barwise.functions.frames import ewm, full, full_next, rolling, running


def macd(df: DataFrame) -> DataFrame:
    """``dif`` (EWM 12 minus EWM 26), ``dea`` (EWM 9 of it) and ``macd`` (twice their difference)."""
    q = lambda span: 1 - 2 / (span + 1)
    d = ewm(df, {"_f": ("price", q(12)), "_s": ("price", q(26))}).withColumn("dif", F.col("_f") - F.col("_s")).drop("_f", "_s")
    return ewm(d, {"dea": ("dif", q(9))}).withColumn("macd", 2 * (F.col("dif") - F.col("dea")))


def kdj(df: DataFrame, n: int = 9) -> DataFrame:
    """``kdj_k, kdj_d, kdj_j`` from the rolling extremes of the price itself; null until ``n`` rows, no weight where they are equal."""

    def rsv(w: WindowSpec) -> dict[str, Column]:
        lo, hi = full(F.min, "price", w, n), full(F.max, "price", w, n)
        return {"rsv": F.try_divide(F.col("price") - lo, hi - lo) * 100}

    d = ewm(rolling(df, rsv, back=n), {"kdj_k": ("rsv", 2 / 3)})
    return ewm(d, {"kdj_d": ("kdj_k", 2 / 3)}).withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d"))


def moving_averages(df: DataFrame, periods: Sequence[int] = (5, 10, 20, 40, 60, 120), value: str = "price") -> DataFrame:
    """``ma_{n}``: means of the last n values, null until there are n."""
    return rolling(df, lambda w: {f"ma_{n}": full(F.avg, value, w, n) for n in periods}, back=max(periods))


def signed_changes(df: DataFrame, marks: Callable[[WindowSpec], Column] | None = None) -> DataFrame:
    """``d`` change of price and ``sign`` of the last change that was not 0 (0 before any).

    With ``marks``, a condition over rows next to each other, also ``mark`` (1 where it holds), ``upto`` (marks so far) and ``marked`` (marks of the symbol), in the same pass.
    """
    more = (lambda w: {"mark": F.coalesce(marks(w), F.lit(False)).cast("long")}) if marks else (lambda w: {})
    d = rolling(df, lambda w: {"d": F.col("price") - F.lag("price").over(w), **more(w)}, back=1)
    d = running(d, latest={"sign": F.nullif(F.signum("d"), F.lit(0.0))}, sums={"upto": F.col("mark")} if marks else None, totals={"upto": "marked"} if marks else None)
    return d.withColumn("sign", F.coalesce("sign", F.lit(0.0)))


def kyle_bars(df: DataFrame, n: int = 20) -> DataFrame:
    """``kyle``: rolling mean of d / (volume * sign)."""
    d = signed_changes(df).withColumn("_x", F.try_divide(F.col("d"), F.col("volume") * F.col("sign")))
    return rolling(d, lambda w: {"kyle": full(F.avg, "_x", w, n)}, back=n).drop("_x")


def amihud_bars(df: DataFrame, n: int = 20) -> DataFrame:
    """``amihud``: rolling mean of |log return| over the square root of the dollar volume."""
    d = rolling(df, lambda w: {"_x": F.try_divide(F.abs(F.ln(F.try_divide(F.col("price"), F.lag("price").over(w)))), F.sqrt(F.col("price") * F.col("volume")))}, back=1)
    return rolling(d, lambda w: {"amihud": full(F.avg, "_x", w, n)}, back=n).drop("_x")


def through_origin(df: DataFrame, y: str, x: str) -> DataFrame:
    """``symbol, beta, t_value, n``: regression of y on x without intercept, in one aggregation; pairs with a null are dropped."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = d.groupBy("symbol").agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n"))
    beta = F.try_divide("xy", "xx")
    sse = F.col("yy") - beta * beta * F.col("xx")
    return s.select("symbol", beta.alias("beta"), F.try_divide(beta, F.sqrt(F.try_divide(F.try_divide(sse, F.col("n") - 1), "xx"))).alias("t_value"), "n")


def kyle_trades(df: DataFrame) -> DataFrame:
    """Price impact of signed volume."""
    return through_origin(signed_changes(df).withColumn("_x", F.col("volume") * F.col("sign")), "d", "_x")


def hasbrouck_trades(df: DataFrame) -> DataFrame:
    """|log return| on dollar volume (unsigned, no root)."""
    d = rolling(df, lambda w: {"_y": F.abs(F.ln(F.try_divide(F.col("price"), F.lag("price").over(w))))}, back=1)
    return through_origin(d.withColumn("_x", F.col("price") * F.col("volume")), "_y", "_x")


def frac_diff_weights(d: float, size: int, least: float = 1e-5) -> list[float]:
    """Coefficients of (1 - L)^d up to ``size`` of them, as running products of (k - 1 - d) / k; they end before the first below ``least``."""
    products = accumulate(((k - 1 - d) / k for k in range(1, size)), lambda w, r: w * r, initial=1.0)
    return list(takewhile(lambda w: abs(w) >= least, products))


def frac_diff(df: DataFrame, d: float = 0.4, size: int = 30) -> DataFrame:
    """``frac``: sum of w_k times the price k rows before, with partial sums at the start."""
    weights = frac_diff_weights(d, size)
    return rolling(df, lambda w: {"frac": weighted_past("price", weights, w)}, back=len(weights))


def weighted_past(value: str, weights: Sequence[float], w: WindowSpec) -> Column:
    """Sum of weight k times the value k rows before, with partial sums at the start."""
    return sum((F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * F.lit(c) for k, c in enumerate(weights[1:], 1)), F.col(value) * F.lit(weights[0]))


def lag_returns(df: DataFrame, lags: Sequence[int] = (5, 10, 20, 40)) -> DataFrame:
    """``ret_{k}``: price over the price k rows before, minus 1."""
    return rolling(df, lambda w: {f"ret_{k}": F.try_divide(F.col("price"), F.lag("price", k).over(w)) - 1 for k in lags}, back=max(lags))


def rate_lags(df: DataFrame, value: str = "rate", n: int = 19) -> DataFrame:
    """``lag_1 .. lag_n`` of a column."""
    return rolling(df, lambda w: {f"lag_{k}": F.lag(value, k).over(w) for k in range(1, n + 1)}, back=n)


def discounted_past(df: DataFrame, value: str = "rate", spans: Sequence[int] = (1, 3, 5, 10, 15, 20), beta: float = 0.9) -> DataFrame:
    """``reward_{n}``: sum over j < n of beta^j times the value j rows before; null until there are n values."""

    def make(w: WindowSpec) -> dict[str, Column]:
        lagged = [F.col(value), *[F.lag(value, j).over(w) for j in range(1, max(spans))]]
        return {f"reward_{n}": sum((lagged[j] * beta**j for j in range(1, n)), lagged[0]) for n in spans}

    return rolling(df, make, back=max(spans))


def discounted_future(df: DataFrame, value: str = "rate", spans: Sequence[int] = (1, 5, 10), beta: float = 0.9) -> DataFrame:
    """``rd_{k}`` = sum over j < k of beta^j times the value j + 1 rows on, with ``_dire`` and ``_scale`` its sign and size."""

    def make(w: WindowSpec) -> dict[str, Column]:
        lead = [F.lead(value, j + 1).over(w) for j in range(max(spans))]
        return {f"rd_{k}": sum((lead[j] * beta**j for j in range(1, k)), lead[0]) for k in spans}

    d = rolling(df, make, ahead=max(spans))
    for k in spans:
        d = d.withColumn(f"rd_{k}_dire", F.signum(f"rd_{k}")).withColumn(f"rd_{k}_scale", F.abs(f"rd_{k}"))
    return d


def future_extremes(df: DataFrame, spans: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """``up_{k}, down_{k}``: the largest and smallest of the next k prices over the present one, minus 1."""
    p = F.col("price")
    return rolling(df, lambda w: {f"{n}_{k}": F.try_divide(full_next(f, "price", w, k), p) - 1 for k in spans for n, f in (("up", F.max), ("down", F.min))}, ahead=max(spans))


def _slope(y: str, w: WindowSpec, lo: int, hi: int) -> Column:
    f, n = w.rowsBetween(lo, hi), hi - lo + 1
    return F.when(F.count(y).over(f) == n, F.regr_slope(F.col(y), F.col("rn").cast("double")).over(f))


def slopes(df: DataFrame, spans: Sequence[int] = (5, 10, 20), value: str = "price") -> DataFrame:
    """``slope_{n}, intercept_{n}`` of a line through the last n values over x = 0 .. n - 1."""

    def make(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for n in spans:
            s = _slope(value, w, -(n - 1), 0)
            out[f"slope_{n}"] = s
            out[f"intercept_{n}"] = F.avg(value).over(w.rowsBetween(-(n - 1), 0)) - s * (n - 1) / 2
        return out

    return rolling(df, make, back=max(spans))


def future_slopes(df: DataFrame, spans: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """``fut_slope_{k}`` of a line through the next k prices."""
    return rolling(df, lambda w: {f"fut_slope_{k}": _slope("price", w, 1, k) for k in spans}, ahead=max(spans))


def past_future_sums(df: DataFrame, value: str = "rate", spans: Sequence[int] = (1, 5, 9, 13, 17)) -> DataFrame:
    """``pre_{k}`` and ``fut_{k}``: sums of the last and of the next k values."""
    return rolling(df, lambda w: {f"{n}_{k}": f(F.sum, value, w, k) for k in spans for n, f in (("pre", full), ("fut", full_next))}, back=max(spans), ahead=max(spans))


def variance_by_length(df: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """``symbol, length, std``: population deviation of price over the price ``length`` rows before, minus 1."""
    d = rolling(df, lambda w: {f"_r{k}": F.try_divide(F.col("price"), F.lag("price", k).over(w)) - 1 for k in lengths}, back=max(lengths))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("length"), F.col(f"_r{k}").alias("r")) for k in lengths])).alias("x")
    return d.select("symbol", pairs).groupBy("symbol", "x.length").agg(F.stddev_pop("x.r").alias("std"))


def successive_pairs(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``next_value``: the value of the row after; rows without one are dropped."""
    return rolling(df, lambda w: {"next_value": F.lead(value).over(w)}, ahead=1).filter(F.col("next_value").isNotNull() & F.col(value).isNotNull())


def rolling_zscore(df: DataFrame, value: str, n: int = 30, threshold: float = 3.0) -> DataFrame:
    """``z`` of the value against the last ``n`` rows (from one row on), and ``is_break`` where z exceeds the threshold (one-sided)."""

    def make(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-(n - 1), 0)
        return {"z": F.try_divide(F.col(value) - F.avg(value).over(f), F.stddev_samp(value).over(f))}

    return rolling(df, make, back=n).withColumn("is_break", F.coalesce(F.col("z") > threshold, F.lit(False)))


