"""Labels of price events, event intervals and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions.frames import BLOCK, ewm, full, rolling, running
from barwise.session import epoch_us, floor_div


def asof_forward(left: DataFrame, right: DataFrame, at: str, stretch_s: int = 86_400 * 7) -> DataFrame:
    """``left`` with ``found_ts, found``: the first row of ``right`` (``symbol, ts, tie, price``) at or after ``at``; left rows without one are dropped.

    Both sides are cut into stretches of time; a stretch that ends without a later right row
    takes the first one of the following stretches, known from a summary per stretch.
    """
    us = stretch_s * 1_000_000
    r = right.select("symbol", epoch_us("ts").alias("_t"), F.struct("ts", "price").alias("_r")).withColumn("_b", floor_div(F.col("_t"), us))
    ident = F.struct(*left.columns)
    x = left.select("symbol", epoch_us(at).alias("_t"), ident.alias("_left")).filter("_t is not null").withColumn("_b", floor_div(F.col("_t"), us))
    both = x.unionByName(r.withColumn("_first", F.lit(1)), allowMissingColumns=True)
    # from late to early, so that frames only ever grow
    after = W.partitionBy("symbol", "_b").orderBy(F.col("_t").desc(), F.col("_first").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_n", F.last("_r", True).over(after)).filter("_left is not null")
    heads = r.groupBy("symbol", "_b").agg(F.min_by("_r", "_t").alias("_h")).unionByName(x.select("symbol", "_b").distinct(), allowMissingColumns=True)
    heads = heads.groupBy("symbol", "_b").agg(F.max("_h").alias("_h"))
    later = heads.withColumn("_next", F.last("_h", True).over(W.partitionBy("symbol").orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)))
    got = both.join(later.select("symbol", "_b", "_next"), ["symbol", "_b"]).withColumn("_n", F.coalesce("_n", "_next"))
    return got.filter("_n is not null").select("_left.*", F.col("_n.ts").alias("found_ts"), F.col("_n.price").alias("found"))


def vertical_barriers(events: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """``event_id, symbol, t0, t1``: t1 the first bar at or ``seconds`` after t0; events past the end are dropped."""
    e = events.select("event_id", "symbol", "t0", F.timestamp_add("SECOND", F.lit(seconds), F.col("t0")).alias("due"))
    return asof_forward(e, bars, "due").select("event_id", "symbol", "t0", F.col("found_ts").alias("t1"))


def event_prices(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``events`` with ``p0, p1``: the prices at exactly t0 and t1; events where either is missing are dropped."""
    p = bars.select("symbol", "ts", "price")
    d = events.join(p.withColumnsRenamed({"ts": "t0", "price": "p0"}), ["symbol", "t0"])
    return d.join(p.withColumnsRenamed({"ts": "t1", "price": "p1"}), ["symbol", "t1"])


def return_sign(events: DataFrame, bars: DataFrame, threshold: float = 0.0, window: int | None = None) -> DataFrame:
    """``ret`` (log) and ``bin``: 1 above the threshold, -1 below its negative, else 0.

    With ``window`` the return is standardised first: less the mean and over the deviation of the one-step-ahead log
    returns of the last ``window`` bars up to t0; events without them are dropped.
    """
    bars = bars.select("symbol", "ts", "tie", "price")
    d = event_prices(events, bars).withColumn("ret", F.ln(F.try_divide("p1", "p0")))
    if window:
        ahead = rolling(bars, lambda w: {"r": F.ln(F.try_divide(F.lead("price").over(w), F.col("price")))}, ahead=1)
        ahead = rolling(ahead, lambda w: {"m": full(F.avg, "r", w, window), "s": full(F.stddev_samp, "r", w, window)}, back=window)
        d = d.join(ahead.select("symbol", F.col("ts").alias("t0"), "m", "s"), ["symbol", "t0"])
        d = d.withColumn("ret", F.try_divide(F.col("ret") - F.col("m"), F.col("s"))).filter("ret is not null").drop("m", "s")
    return d.withColumn("bin", F.when(F.col("ret") > threshold, 1).when(F.col("ret") < -threshold, -1).otherwise(0))


def scale(events: DataFrame, bars: DataFrame, sign: Column | None = None) -> DataFrame:
    """``scale``: size of the log return, 0 where a given sign differs from its own."""
    d = event_prices(events, bars).withColumn("ret", F.ln(F.try_divide("p1", "p0")))
    size = F.abs("ret")
    return d.withColumn("scale", size if sign is None else F.when(F.signum("ret") == sign, size).otherwise(0.0))


def events_with_bars(events: DataFrame, bars: DataFrame, stretch_s: int = 86_400) -> DataFrame:
    """Each event with the bars in [t0, t1]: an equi-join on symbol and stretch of time, which an event is sent to each of that it touches.

    Work and rows grow with the bars the events hold, never with pairs that do not match.
    """
    us = stretch_s * 1_000_000
    e = events.withColumn("_b", F.explode(F.sequence(floor_div(epoch_us("t0"), us), floor_div(epoch_us("t1"), us))))
    b = bars.withColumn("_b", floor_div(epoch_us("ts"), us))
    return e.join(b, ["symbol", "_b"]).filter("ts >= t0 and ts <= t1").drop("_b")


def triple_barrier(events: DataFrame, bars: DataFrame, sl: float, pt: float) -> DataFrame:
    """``event_id, symbol, t0, sl_ts, pt_ts, t1, bin``: first bar whose return since t0 is below ``sl`` or above ``pt``;
    t1 the earliest of these and the given end; bin -1, 0, 1 for the one that came first (sl before end before pt on ties)."""
    p0 = bars.select("symbol", F.col("ts").alias("t0"), F.col("price").alias("p0"))
    d = events_with_bars(events.join(p0, ["symbol", "t0"]), bars.select("symbol", "ts", "price")).withColumn("r", F.try_divide("price", "p0") - 1)
    g = d.groupBy("event_id", "symbol", "t0", "t1").agg(F.min(F.when(F.col("r") < sl, F.col("ts"))).alias("sl_ts"), F.min(F.when(F.col("r") > pt, F.col("ts"))).alias("pt_ts"))
    first = F.least("sl_ts", "t1", "pt_ts")
    return g.select("event_id", "symbol", "t0", "sl_ts", "pt_ts", first.alias("t1"), F.when(F.col("sl_ts") == first, -1).when(F.col("t1") == first, 0).otherwise(1).alias("bin"))


def over_cross_section(panel: DataFrame, k: int = 1, median: bool = False, binary: bool = False) -> DataFrame:
    """``ts, asset, excess``: forward k-step return less the mean (or median) of all assets at that time; its sign if ``binary``."""
    d = rolling(panel.select(F.col("asset").alias("symbol"), "ts", F.lit(0).alias("tie"), "price"), lambda w: {"r": F.try_divide(F.lead("price", k).over(w), F.col("price")) - 1}, ahead=k)
    d = d.filter("r is not null")
    m = d.groupBy("ts").agg((F.median if median else F.avg)("r").alias("m"))
    x = F.col("r") - F.col("m")
    return d.join(m, "ts").select("ts", F.col("symbol").alias("asset"), (F.signum(x) if binary else x).alias("excess"))


def tail_sets(panel: DataFrame, q: int, vol_adj: str | None = None, window: int = 252) -> DataFrame:
    """``ts, asset, tail``: -1 for the lowest and 1 for the highest of ``q`` quantile bins of the log changes at a time, else 0.

    Times at which an asset has no change are dropped; ties are ranked by asset.  With ``vol_adj`` the changes are first
    divided by their volatility over ``window`` rows: ``stdev`` the rolling deviation, ``mean_abs_dev`` the exponentially
    weighted mean (span ``window``) of their size; times without it are dropped.
    """
    assets = panel.select("asset").distinct().count()
    w = W.partitionBy("ts")

    def complete(d: DataFrame) -> DataFrame:
        return d.filter("r is not null").withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") == assets)

    d = complete(rolling(panel.select(F.col("asset").alias("symbol"), "ts", F.lit(0).alias("tie"), "price"), lambda w: {"r": F.ln("price") - F.ln(F.lag("price").over(w))}, back=1))
    if vol_adj == "stdev":
        d = rolling(d.drop("rn"), lambda w: {"v": full(F.stddev_samp, "r", w, window)}, back=window)
    elif vol_adj == "mean_abs_dev":
        d = ewm(d.drop("rn").withColumn("a", F.abs("r")), {"v": ("a", 1 - 2 / (window + 1))}).withColumn("v", F.when(F.col("rn") >= window - 1, F.col("v")))
    elif vol_adj:
        raise ValueError(vol_adj)
    if vol_adj:
        d = complete(d.withColumn("r", F.try_divide("r", "v")).drop("n"))
    d = d.withColumn("k", F.row_number().over(w.orderBy("r", "symbol")))
    low, high = (F.col("k") - 1) * q <= F.col("n") - 1, (F.col("k") - 1) * q > (F.col("n") - 1) * (q - 1)
    return d.select("ts", F.col("symbol").alias("asset"), F.when(low, -1).when(high, 1).otherwise(0).alias("tail"))


def trend_scan(bars: DataFrame, window: int, least: int, step: int) -> DataFrame:
    """``symbol, ts, t1, t_value, ret, bin`` for every row with ``window`` rows from it on: of the lengths ``least, least + step, ...``
    below ``window`` the one whose line through the first prices has the largest |t|; the shortest on ties."""
    lengths = list(range(least, window, step))

    def make(w) -> dict[str, Column]:  # noqa: ANN001
        out: dict[str, Column] = {"_have": F.count("price").over(w.rowsBetween(0, window - 1))}
        # places counted from the block's start, so that products stay small however long the series
        x, y = (F.col("rn") - F.col("_blk") * BLOCK).cast("double"), F.col("price")
        for n in lengths:
            f = w.rowsBetween(0, n - 1)
            total = F.sum(y).over(f)
            sxx = n * (n * n - 1) / 12
            sxy = F.sum(x * y).over(f) - (x + (n - 1) / 2) * total
            syy = F.sum(y * y).over(f) - total * total / n
            b = sxy / sxx
            t = F.try_divide(b, F.sqrt(F.greatest(syy - b * sxy, F.lit(0.0)) / ((n - 2) * sxx)))
            out[f"_t{n}"] = F.struct(F.abs(t).alias("a"), F.lit(-n).alias("n"), t.alias("t"), F.last("ts").over(f).alias("t1"), F.last("price").over(f).alias("p1"))
        return out

    d = rolling(bars, make, ahead=window).filter(F.col("_have") == window)
    best = F.array_max(F.filter(F.array(*[F.col(f"_t{n}") for n in lengths]), lambda s: s["a"].isNotNull()))
    d = d.withColumn("_best", best).filter("_best is not null")
    return d.select("symbol", "ts", F.col("_best.t1").alias("t1"), F.col("_best.t").alias("t_value"), (F.try_divide(F.col("_best.p1"), F.col("price")) - 1).alias("ret"), F.signum("_best.t").alias("bin"))


def concurrency(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``symbol, ts, n``: events alive at each bar from the symbol's first t0 to its last t1, by a sweep over starts and ends."""
    turn = lambda ts, tie, up, down: F.struct(F.col(ts).alias("ts"), F.lit(tie).alias("tie"), F.lit(up).alias("up"), F.lit(down).alias("down"))
    turns = events.select("symbol", F.explode(F.array(turn("t0", -1, 1, 0), turn("t1", 1, 0, 1))).alias("e")).select("symbol", "e.*")
    at = bars.select("symbol", "ts").distinct().select("symbol", F.explode(F.array(turn("ts", 0, 0, 0))).alias("e")).select("symbol", "e.*")
    d = running(turns.unionByName(at), sums={"begun": F.col("up"), "ended": F.col("down")}, totals={"begun": "events"})
    return d.filter("tie = 0 and begun > 0 and ended < events").select("symbol", "ts", (F.col("begun") - F.col("ended")).alias("n"))


def average_uniqueness(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``event_id, symbol, weight``: mean of 1 / concurrency over an event's bars, scaled to sum to 1 per symbol; events without bars are dropped."""
    held = events_with_bars(events, concurrency(events, bars))
    u = held.groupBy("event_id", "symbol").agg(F.avg(1 / F.col("n")).alias("u"))
    total = u.groupBy("symbol").agg(F.sum("u").alias("s"))
    return u.join(total, "symbol").select("event_id", "symbol", F.try_divide("u", "s").alias("weight"))
