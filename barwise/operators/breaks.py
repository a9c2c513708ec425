"""Structural breaks and small regressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.frames import full, numbered, rolling, running
from barwise.functions.special import f_tail, normal
from barwise.operators.indicators import frac_diff_weights, weighted_past


def ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """``by, intercept, slope, se_intercept, se_slope``: y on a constant and x; null standard errors below three rows or without variation."""
    g = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("mx"), F.count(F.lit(1)).alias("n"))
    s2 = F.when(F.col("n") > 2, F.try_divide(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.col("n") - 2))
    return g.select(*by, "intercept", "slope", F.sqrt(s2 * (1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx")))).alias("se_intercept"), F.sqrt(F.try_divide(s2, "sxx")).alias("se_slope"))


def residuals(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """``df`` with ``residual`` of y on a constant and x within each group."""
    c = df.groupBy(*by).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    return df.join(c, by).withColumn("residual", F.col(y) - F.col("_i") - F.col("_s") * F.col(x)).drop("_s", "_i")


def chow(df: DataFrame, pooled: str, first: str, second: str, y: str, part: str, k: int, by: list[str]) -> DataFrame:
    """``by, f, p_value``: Chow's F of a pooled prediction against two parts' own predictions (``part`` 0 or 1), and P(F > f) for k and n - 2 k."""
    sq = lambda c: (F.col(y) - F.col(c)) * (F.col(y) - F.col(c))
    own = F.when(F.col(part) == 0, sq(first)).otherwise(sq(second))
    g = df.groupBy(*by).agg(F.sum(sq(pooled)).alias("c"), F.sum(own).alias("s"), F.count(F.lit(1)).alias("n"))
    g = g.select(*by, "n", F.try_divide((F.col("c") - F.col("s")) / k, F.try_divide(F.col("s"), F.col("n") - 2 * k)).alias("f"))
    return g.select(*by, "f", f_tail(F.greatest("f", F.lit(0.0)), F.lit(k), F.col("n") - 2 * k).alias("p_value"))


def mean_break(df: DataFrame, value: str, trim: float = 0.15, min_size: int = 15, k: int = 1) -> DataFrame:
    """``symbol, break_at, f, p_value``: the split in [trim, 1 - trim) of a series with the largest F for a change of mean.

    Every candidate's sums of squares come from running totals, so a series of n rows takes n
    steps; ties go to the earliest.  ``p_value`` is P(F > f) for 1 and n - 2, as the original takes it, not corrected for the search.
    """
    x = F.col(value)
    d = running(df.filter(x.isNotNull()), sums={"s": x, "q": x * x, "_n": F.lit(1)}, totals={"s": "st", "q": "qt", "_n": "n"})
    n1 = F.col("rn") + 1
    n2 = F.col("n") - n1
    c = d.filter((n1 >= F.floor(F.col("n") * trim)) & (n1 < F.col("n") - F.floor(F.col("n") * trim)) & (n1 >= min_size) & (n2 >= min_size))
    pooled = F.col("qt") - F.col("st") * F.col("st") / F.col("n")
    parts = (F.col("q") - F.col("s") * F.col("s") / n1) + (F.col("qt") - F.col("q") - (F.col("st") - F.col("s")) * (F.col("st") - F.col("s")) / n2)
    f = F.try_divide((pooled - parts) / k, parts / (F.col("n") - 2 * k))
    c = c.select("symbol", n1.alias("break_at"), f.alias("f"), (pooled - parts).alias("gain"), "n").filter("f is not null")
    best = c.groupBy("symbol").agg(F.max_by(F.struct("break_at", "f", "gain", "n"), F.struct("f", -F.col("break_at"))).alias("b")).select("symbol", "b.*")
    return best.withColumn("p_value", f_tail(F.greatest("f", F.lit(0.0)), F.lit(1), F.col("n") - 2)).drop("n")


def window_discrepancy(df: DataFrame, value: str, width: int) -> DataFrame:
    """``df`` with ``gain`` (fall of squared error when the ``width`` rows before and from a row on get their own means) and ``is_peak`` (largest within ``width`` rows)."""

    def gain(w):  # noqa: ANN001, ANN202
        a, b = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
        d = F.avg(value).over(a) - F.avg(value).over(b)
        return {"gain": F.when((F.count(value).over(a) == width) & (F.count(value).over(b) == width), d * d * width / 2)}

    d = rolling(df, gain, back=width, ahead=width)
    return rolling(d, lambda w: {"is_peak": F.coalesce((F.col("gain") == F.max("gain").over(w.rowsBetween(-width, width))) & (F.col("gain") > 0), F.lit(False))}, back=width, ahead=width)


def cusum(df: DataFrame, value: str, n: int = 30, threshold: float = 3.0, step: bool = True, mean_shift: bool = True) -> DataFrame:
    """``df`` with ``s_pos, s_neg, pos_break, neg_break``: one-sided sums of the deviation from the rolling mean over its rolling deviation.

    Without ``mean_shift`` the value itself takes the place of its deviation from the rolling mean.  The sums are 0 for the
    first ``n`` rows of a symbol; with ``step`` they are set back to 0 by a break, in its own row already.
    Rolling parts are windows; the recursion streams over sorted rows, keeping two numbers per symbol.
    """
    df = df.filter(F.col(value).isNotNull())
    mean = lambda w: F.avg(value).over(w.rowsBetween(-(n - 1), 0)) if mean_shift else F.lit(0.0)
    d = rolling(df, lambda w: {"eps": F.col(value) - mean(w)}, back=n)
    d = rolling(d, lambda w: {"sigma": F.stddev_samp("eps").over(w.rowsBetween(-(n - 1), 0))}, back=n)
    cols = d.columns
    at = [cols.index(c) for c in ("rn", "eps", "sigma")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = down = 0.0
        for b in batches:
            size = b.num_rows
            made = np.zeros((2, size))
            hits = np.zeros((2, size), bool)
            for k, (i, x, sd) in enumerate(zip(*[b.column(j).to_pylist() for j in at])):
                if i < n or not sd:
                    up, down = (0.0, 0.0) if i < n else (up, down)
                    continue
                up, down = max(0.0, up + x) / sd, min(0.0, down + x) / sd
                hits[:, k] = up > threshold, down < -threshold
                if step:
                    up, down = 0.0 if hits[0, k] else up, 0.0 if hits[1, k] else down
                made[:, k] = up, down
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c) for c in (*made, *hits)]], names=[*cols, "s_pos", "s_neg", "pos_break", "neg_break"])

    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in cols)
    return d.repartition("symbol").sortWithinPartitions("symbol", "rn").mapInArrow(run, f"{kinds}, s_pos double, s_neg double, pos_break boolean, neg_break boolean")


def long_short(df: DataFrame, value: str, long: int = 30, short: int = 5) -> DataFrame:
    """``df`` with ``signal``: long less short moving average."""
    return rolling(df, lambda w: {"signal": full(F.avg, value, w, long) - full(F.avg, value, w, short)}, back=long)


# ---------------------------------------------------------------- segmentation of one series at a time


def _cost(x: np.ndarray, kind: str):  # noqa: ANN202
    """Cost of segments [a, b) from prefix sums: ``l2`` squared error, ``normal`` Gaussian likelihood, ``l1`` via medians."""
    s, q = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]

    def l2(a, b):  # noqa: ANN001, ANN202
        n = b - a
        return np.maximum(q[b] - q[a] - (s[b] - s[a]) ** 2 / n, 0.0)

    if kind == "l2":
        return l2
    if kind == "normal":
        return lambda a, b: (b - a) * np.log(np.maximum(l2(a, b) / (b - a), 1e-12))
    if kind == "l1":
        return lambda a, b: np.array([np.abs(x[i:j] - np.median(x[i:j])).sum() for i, j in np.broadcast(a, b)]) if np.ndim(a) or np.ndim(b) else float(np.abs(x[a:b] - np.median(x[a:b])).sum())
    raise ValueError(kind)


def _pelt(x: np.ndarray, cost, penalty: float, least: int, jump: int) -> list[int]:  # noqa: ANN001
    n = len(x)
    ends = [*range(0, n, jump), n]
    best, last, live = {0: -penalty}, {}, [0]
    for e in ends[1:]:
        ok = np.array([a for a in live if e - a >= least and a in best])
        if not len(ok):
            continue
        v = np.array([best[a] for a in ok]) + cost(ok, np.full(len(ok), e)) + penalty
        i = int(v.argmin())
        best[e], last[e] = float(v[i]), int(ok[i])
        keep = set(ok[v - penalty <= best[e]].tolist())
        live = [a for a in live if a in keep or e - a < least] + [e]
    out, e = [], n
    while e in last and last[e] > 0:
        e = last[e]
        out.append(e)
    return out[::-1]


def _dynamic(x: np.ndarray, cost, breaks: int, least: int, jump: int) -> list[int]:  # noqa: ANN001
    n = len(x)
    ends = np.array([*range(jump, n, jump), n])
    v = np.where(ends >= least, cost(np.zeros(len(ends), int), ends), np.inf)
    back = []
    for _ in range(breaks):
        new, frm = np.full(len(ends), np.inf), np.full(len(ends), -1)
        for k, e in enumerate(ends):
            ok = np.flatnonzero((e - ends[:k] >= least) & np.isfinite(v[:k]))
            if len(ok):
                t = v[ok] + cost(ends[ok], np.full(len(ok), e))
                i = int(t.argmin())
                new[k], frm[k] = t[i], ok[i]
        back.append(frm)
        v = new
    out, k = [], len(ends) - 1
    if not np.isfinite(v[k]):
        return []
    for frm in reversed(back):
        k = frm[k]
        out.append(int(ends[k]))
    return out[::-1]


def _binary(x: np.ndarray, cost, breaks: int | None, penalty: float, least: int, jump: int) -> list[int]:  # noqa: ANN001
    cuts = [0, len(x)]
    while breaks is None or len(cuts) - 2 < breaks:
        best = (0.0, -1)
        for a, b in zip(cuts, cuts[1:]):
            at = np.array([c for c in range(a + least, b - least + 1) if c % jump == 0])
            if len(at):
                gain = cost(a, b) - cost(np.full(len(at), a), at) - cost(at, np.full(len(at), b))
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), int(at[i])), key=lambda t: (t[0], -t[1]))
        if best[1] < 0 or (breaks is None and best[0] <= penalty):
            break
        cuts = sorted([*cuts, best[1]])
    return cuts[1:-1]


def _bottom_up(x: np.ndarray, cost, breaks: int | None, penalty: float, least: int, jump: int) -> list[int]:  # noqa: ANN001
    step = max(least, jump)
    cuts = [*range(0, len(x) - step + 1, step), len(x)] if len(x) >= step else [0, len(x)]
    while len(cuts) > 2 and (breaks is None or len(cuts) - 2 > breaks):
        loss = [float(cost(cuts[i - 1], cuts[i + 1]) - cost(cuts[i - 1], cuts[i]) - cost(cuts[i], cuts[i + 1])) for i in range(1, len(cuts) - 1)]
        i = int(np.argmin(loss))
        if breaks is None and loss[i] > penalty:
            break
        cuts.pop(i + 1)
    return cuts[1:-1]


def _kernel(x: np.ndarray, breaks: int, least: int, gamma: float | None = None) -> list[int]:
    d = (x[:, None] - x[None, :]) ** 2
    g = gamma or 1.0 / max(float(np.median(d[d > 0])) if (d > 0).any() else 1.0, 1e-12)
    k = np.exp(-g * d)
    s = np.zeros((len(x) + 1, len(x) + 1))
    s[1:, 1:] = k.cumsum(0).cumsum(1)

    def cost(a, b):  # noqa: ANN001, ANN202
        return (b - a) - (s[b, b] - s[a, b] - s[b, a] + s[a, a]) / (b - a)

    return _dynamic(x, cost, breaks, least, 1)


MAX_SEGMENT_ROWS = 20_000


def segment(df: DataFrame, value: str, method: str = "pelt", cost: str = "l2", breaks: int | None = None, penalty: float | None = None, least: int = 5, jump: int = 5) -> DataFrame:
    """``symbol, break_at``: places at which a series falls into segments.

    Methods: ``pelt``, ``dynamic``, ``binary``, ``bottom_up``, ``kernel`` (radial).  The default
    penalty is ln(n) times the variance.  Search over a whole series is inherently sequential and
    one series is one group; series longer than ``MAX_SEGMENT_ROWS`` are refused (resample first).
    """
    rows = numbered(df.filter(F.col(value).isNotNull())).select("symbol", "rn", F.col(value).cast("double").alias("x"))
    long = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_SEGMENT_ROWS)
    if long.limit(1).count():
        raise ValueError(f"a series has more than {MAX_SEGMENT_ROWS} rows")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("rn")["x"].to_numpy()
        c = _cost(x, cost)
        p = penalty if penalty is not None else float(np.log(max(2, len(x))) * x.var())
        if method == "pelt":
            at = _pelt(x, c, p, least, jump)
        elif method == "dynamic":
            at = _dynamic(x, c, breaks or 1, least, jump)
        elif method == "binary":
            at = _binary(x, c, breaks, p, least, jump)
        elif method == "bottom_up":
            at = _bottom_up(x, c, breaks, p, least, jump)
        elif method == "kernel":
            at = _kernel(x, breaks or 1, least)
        else:
            raise ValueError(method)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "break_at": np.array(at, "int64")})

    return rows.groupBy("symbol").applyInPandas(one, "symbol string, break_at long")


def adf(df: DataFrame, value: str) -> DataFrame:
    """``symbol, statistic, n``: Dickey-Fuller t statistic with constant and one lag, from one aggregation of cross products."""
    d = rolling(df.filter(F.col(value).isNotNull()), lambda w: {"l1": F.lag(value).over(w), "l2": F.lag(value, 2).over(w)}, back=2).filter("l2 is not null")
    m = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), _products(value, "l1", "l2").alias("m"))
    return m.withColumn("statistic", _dickey_fuller("m", "n")).filter("statistic is not null").select("symbol", "statistic", "n")


def _products(value: str, l1: str, l2: str) -> Column:
    """Covariances of the change y of a value, its last level a and its last change b."""
    y, a, b = F.col(value) - F.col(l1), F.col(l1), F.col(l1) - F.col(l2)
    return F.struct(F.covar_pop(a, a).alias("aa"), F.covar_pop(b, b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(y, a).alias("ya"), F.covar_pop(y, b).alias("yb"), F.covar_pop(y, y).alias("yy"))


def _dickey_fuller(products: str, n: str) -> Column:
    """t of the last level; null up to three rows and where level and last change do not vary apart."""
    aa, bb, ab, ya, yb, yy = (F.col(f"{products}.{c}") for c in ("aa", "bb", "ab", "ya", "yb", "yy"))
    det = aa * bb - ab * ab
    on_level, on_change = F.try_divide(ya * bb - yb * ab, det), F.try_divide(yb * aa - ya * ab, det)
    s2 = F.try_divide((yy - on_level * ya - on_change * yb) * F.col(n), F.col(n) - 3)
    return F.when((det > 0) & (F.col(n) > 3), F.try_divide(on_level, F.sqrt(F.try_divide(s2 * bb, det * F.col(n)))))


def min_ffd(df: DataFrame, value: str, steps: int = 11, size: int = 30, least: float = 0.01) -> DataFrame:
    """``symbol, d, statistic, p_value, n, critical, corr`` for d = 0 .. 1: how stationary a series is when differenced by d, and how much of it is left.

    ``statistic`` is that of ``adf``, ``p_value`` its probability (MacKinnon 1994), ``critical`` its 5 % value for n rows (MacKinnon 2010), ``corr`` the correlation with
    the series itself; the smallest d with statistic below critical is the one to take.  Weights below ``least`` end the sum,
    as in the original.  All values of d go through one pass.
    """
    ds = [k / (steps - 1) for k in range(steps)]
    weights = [frac_diff_weights(d, size, least) for d in ds]
    made = rolling(df.filter(F.col(value).isNotNull()), lambda w: {f"_f{k}": weighted_past(value, c, w) for k, c in enumerate(weights)}, back=max(len(c) for c in weights))
    made = rolling(made, lambda w: {f"_l{j}_{k}": F.lag(f"_f{k}", j).over(w) for k in range(steps) for j in (1, 2)}, back=2)
    lagged = F.col("_l2_0").isNotNull()
    moments = [F.struct(F.lit(d).alias("d"), F.corr(value, f"_f{k}").alias("corr"), _products(f"_f{k}", f"_l1_{k}", f"_l2_{k}").alias("m")) for k, d in enumerate(ds)]
    # rows without both lags have neither, so that covariances leave them out
    cut = made.select("symbol", value, *[F.when(lagged, F.col(f"_l{j}_{k}")).alias(f"_l{j}_{k}") for k in range(steps) for j in (1, 2)], *[f"_f{k}" for k in range(steps)])
    cut = cut.groupBy("symbol").agg(F.count("_l2_0").alias("n"), F.array(*moments).alias("_m")).select("symbol", "n", F.explode("_m").alias("_m")).select("symbol", "n", "_m.*")
    n = F.col("n")
    critical = F.when(n > 0, F.lit(-2.86154) - F.try_divide(F.lit(2.8903), n) - F.try_divide(F.lit(4.234), n * n) - F.try_divide(F.lit(40.04), n * n * n))
    got = cut.select("symbol", "d", _dickey_fuller("m", "n").alias("statistic"), "n", critical.alias("critical"), "corr")
    return got.withColumn("p_value", unit_root_probability(F.col("statistic")))


def unit_root_probability(t: Column) -> Column:
    """Probability of a Dickey-Fuller statistic with constant if there is a unit root (MacKinnon 1994, one series)."""
    # The published polynomials for small and large statistics, where they meet and where they end.
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    meet, least, most = -1.61, -18.83, 2.74
    poly = lambda cs: sum((F.pow(t, F.lit(k)) * c for k, c in enumerate(cs[1:], 1)), F.lit(cs[0]))
    return F.when(t > most, 1.0).when(t < least, 0.0).when(t <= meet, normal(poly(small))).when(t > meet, normal(poly(large)))
