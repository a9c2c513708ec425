"""Frame helpers and operators against pandas and literal loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.functions import frames
from barwise.operators import bars as B
from barwise.operators import breaks as K
from barwise.operators import indicators as I

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 1500), ("b", 40), ("c", 1)):
        t = np.cumsum(rng.integers(0, 900, n))
        p = np.round(50 + np.cumsum(rng.normal(0, 0.3, n)), 1)
        rows += [(s, T0 + dt.timedelta(seconds=int(t[i])), i, float(p[i]), float(p[i]), float(p[i]), float(rng.integers(1, 50))) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, tie long, price double, high double, low double, volume double").repartition(5)
    return df, pd.DataFrame(rows, columns=["symbol", "ts", "tie", "price", "high", "low", "volume"])


def collect(df, *cols):
    return df.select("symbol", "tie", *cols).toPandas().sort_values(["symbol", "tie"]).reset_index(drop=True)


def test_numbered(ticks):
    got = collect(frames.numbered(ticks[0]), "rn")
    assert (got["rn"] == got["tie"]).all()


def test_rolling_is_independent_of_blocks(ticks):
    make = lambda w: {"m": frames.full(F.avg, "price", w, 7), "f": frames.full_next(F.max, "price", w, 3), "l": F.lag("price", 5).over(w)}
    got = [collect(frames.rolling(ticks[0], make, back=7, ahead=3, block=b), "m", "f", "l") for b in (8, 100, 100_000)]
    pd.testing.assert_frame_equal(got[0], got[2])
    pd.testing.assert_frame_equal(got[1], got[2])
    want = ticks[1].groupby("symbol")["price"].transform(lambda x: x.rolling(7).mean())
    assert np.allclose(got[0]["m"].fillna(-1), want.fillna(-1))


def test_running_is_independent_of_blocks(ticks):
    kw = {"sums": {"s": F.when(F.col("tie") % 3 == 0, F.col("price"))}, "maxima": {"x": F.col("price")}, "latest": {"l": F.when(F.col("tie") % 5 == 2, F.col("price"))}}
    got = [collect(frames.running(ticks[0], **kw, block=b), "s", "x", "l") for b in (7, 100_000)]
    pd.testing.assert_frame_equal(got[0], got[1])
    g = ticks[1].groupby("symbol")["price"]
    assert np.allclose(got[0]["x"], g.cummax())


@pytest.mark.parametrize("span", [3, 26])
def test_ewm(ticks, span):
    df = ticks[0].withColumn("x", F.when(F.col("tie") % 11 != 3, F.col("price")))
    got = collect(frames.ewm(df, {"e": ("x", 1 - 2 / (span + 1))}), "e")
    p = ticks[1].assign(x=ticks[1]["price"].where(ticks[1]["tie"] % 11 != 3))
    want = p.groupby("symbol")["x"].transform(lambda x: x.ewm(span=span).mean())
    assert np.allclose(got["e"].fillna(-1), want.fillna(-1), rtol=1e-9)


def literal_bars(rows, metric, threshold):
    """The rule spelled out: first tick has signal 0, equal prices keep the last signal, a bar closes when the sum reaches the threshold."""
    out, prev, sig, tot, cur = [], None, 0, 0.0, []
    for i, r in enumerate(rows):
        if prev is not None and r.price != prev:
            sig = 1 if r.price > prev else -1
        prev = r.price
        tot += {"volume_imbalance": r.volume, "signal_imbalance": sig, "dollar_value_imbalance": r.price * r.volume}[metric]
        cur.append(r)
        if tot >= threshold and i > 0:
            out.append((cur[0].symbol, cur[0].tie, cur[-1].tie, len(cur)))
            cur, tot = [], 0.0
    return out


@pytest.mark.parametrize(("metric", "threshold"), [("volume_imbalance", 200), ("signal_imbalance", 3), ("dollar_value_imbalance", 9000)])
def test_constant_bars(ticks, metric, threshold):
    made = B.constant_bars(ticks[0], metric, threshold).join(ticks[0].select("symbol", F.col("ts").alias("start_ts"), "tie"), ["symbol", "start_ts"]).groupBy("symbol", "end_ts").agg(F.min("tie").alias("a"), F.max("ticks").alias("n"))
    got = sorted((r["symbol"], r["n"]) for r in made.collect())
    want = [x for s in ("a", "b", "c") for x in literal_bars(list(ticks[1][ticks[1]["symbol"] == s].itertuples()), metric, threshold)]
    assert got == sorted((s, n) for s, _, _, n in want)


def test_ema_bars_against_literal_loop(ticks):
    got = sorted((r["symbol"], r["ticks"], round(r["volume"])) for r in B.ema_bars(ticks[0], "volume_imbalance", 10, 25.0).collect())
    w = np.array([0.8 * 0.2**i for i in range(5)])[::-1]
    w /= w.sum()
    want = []
    for s in ("a", "b", "c"):
        ei, et, tot, last, imb, lens, cur = 25.0, 10.0, 0.0, 0, [], [], []
        for i, r in enumerate(ticks[1][ticks[1]["symbol"] == s].itertuples()):
            tot += r.volume
            imb.append(r.volume)
            cur.append(r.volume)
            if tot >= ei * et:
                lens.append(i - last)
                last = i
                if len(imb) >= 5:
                    ei = float(np.dot(w, imb[-5:]))
                if len(lens) >= 5:
                    et = float(np.dot(w, lens[-5:]))
                want.append((s, len(cur), round(sum(cur))))
                tot, cur = 0.0, []
    assert got == sorted(want)


def test_empty_input(ticks):
    e = ticks[0].limit(0)
    for df in (I.macd(e), I.kdj(e), B.time_bars(e, 60), B.constant_bars(e, "ticks", 5), B.tick_bars(e, 2), I.frac_diff(e), K.cusum(e, "price"), B.resample_last(e, 60, ["price"])):
        assert df.count() == 0


def test_cusum_against_literal_loop(ticks):
    got = collect(K.cusum(ticks[0], "price", threshold=2.0), "s_pos", "s_neg", "pos_break")
    x = ticks[1][ticks[1]["symbol"] == "a"]["price"].reset_index(drop=True)
    eps = x - x.rolling(30, min_periods=1).mean()
    sd = eps.rolling(30, min_periods=1).std()
    up, want = 0.0, []
    for i in range(len(x)):
        if i < 30 or not sd[i] > 0:
            want.append(0.0)
            continue
        up = max(0.0, up + eps[i]) / sd[i]
        up = 0.0 if up > 2 else up  # a break sets its own row back
        want.append(up)
    assert np.allclose(got[got["symbol"] == "a"]["s_pos"], want, rtol=1e-6, atol=1e-9)


def test_segments_find_a_step(spark):
    x = np.r_[np.zeros(60), np.full(60, 9.0), np.full(60, -4.0)] + np.random.default_rng(0).normal(0, 0.3, 180)
    df = spark.createDataFrame([("s", T0 + dt.timedelta(days=i), i, float(v)) for i, v in enumerate(x)], "symbol string, ts timestamp_ntz, tie long, x double")
    for kw in ({"method": "pelt"}, {"method": "dynamic", "breaks": 2}, {"method": "binary", "breaks": 2}, {"method": "bottom_up", "breaks": 2}, {"method": "kernel", "breaks": 2}, {"method": "pelt", "cost": "normal", "penalty": 20.0}, {"method": "binary", "cost": "l1", "breaks": 2}):
        got = sorted(r["break_at"] for r in K.segment(df, "x", **kw).collect())
        assert got == [60, 120], kw


def test_adf_tells_walk_from_noise(spark):
    rng = np.random.default_rng(2)
    rows = [(s, T0 + dt.timedelta(days=i), i, float(v)) for s, xs in (("walk", np.cumsum(rng.normal(size=400))), ("noise", rng.normal(size=400))) for i, v in enumerate(xs)]
    got = {r["symbol"]: r["statistic"] for r in K.adf(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, tie long, x double"), "x").collect()}
    assert got["noise"] < -8 and got["walk"] > -4


def test_min_ffd_sweeps_d(ticks):
    """Every d from 0 to 1 against a literal regression: statistic and correlation with the series."""
    x = ticks[1][ticks[1]["symbol"] == "a"]["price"].to_numpy()
    got = {round(r["d"], 1): r for r in K.min_ffd(ticks[0], "price").collect() if r["symbol"] == "a"}
    assert sorted(got) == [round(k / 10, 1) for k in range(11)]
    for d, r in got.items():
        f = np.convolve(x, I.frac_diff_weights(r["d"], 30, 0.01))[: len(x)]
        y, level, change = np.diff(f)[1:], f[1:-1], np.diff(f)[:-1]
        m = np.column_stack([level, change, np.ones(len(y))])
        beta, rest = np.linalg.lstsq(m, y, rcond=None)[:2]
        want = beta[0] / np.sqrt(rest[0] / (len(y) - 3) * np.linalg.inv(m.T @ m)[0, 0])
        assert np.isclose(r["statistic"], want, rtol=1e-5) and np.isclose(r["corr"], np.corrcoef(x, f)[0, 1], rtol=1e-6) and r["n"] == len(y), d
        assert -2.95 < r["critical"] < -2.86


@pytest.mark.parametrize("name", ["sb_ruptures_dynamic", "sb_ruptures_bottom_up"])
def test_registered_breaks_keep_the_stride(spark, monkeypatch, name):
    """The registered searches look at every fifth place, as the operator does by itself."""
    from barwise.plans import reference

    x = np.repeat([0.0, 9.0, -4.0, 3.0], [65, 70, 80, 65]) + np.random.default_rng(0).normal(0, 0.1, 280)
    df = spark.createDataFrame([("s", T0 + dt.timedelta(days=i), i, float(v)) for i, v in enumerate(x)], "symbol string, ts timestamp_ntz, tie long, value double")
    monkeypatch.setattr(reference, "_daily", lambda *_: df)
    assert sorted(r["break_at"] for r in reference.QUERIES[name](spark, "").collect()) == [65, 135, 215]


def test_cusum_without_mean_shift(ticks):
    d = K.cusum(ticks[0].withColumn("price", F.col("price") - 50), "price", threshold=2.0, mean_shift=False, step=False)
    got = collect(d, "s_pos")
    x = ticks[1][ticks[1]["symbol"] == "a"]["price"].reset_index(drop=True) - 50
    sd, up, want = x.rolling(30, min_periods=1).std(), 0.0, []
    for i in range(len(x)):
        up = max(0.0, up + x[i]) / sd[i] if i >= 30 and sd[i] > 0 else 0.0
        want.append(up)
    assert np.allclose(got[got["symbol"] == "a"]["s_pos"], want, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("block", [3, 8192])
def test_affine_against_a_loop(ticks, block):
    a, b = F.when(F.col("tie") % 7 == 0, 0.0).otherwise(0.9), F.when(F.col("tie") % 11 != 3, F.col("price"))
    got = collect(frames.affine(ticks[0], "x", a, b, block=block), "x")
    want, last, x = [], None, 0.0
    for r in ticks[1].sort_values(["symbol", "tie"]).itertuples():
        x, last = (x if r.symbol == last else 0.0), r.symbol
        if r.tie % 11 != 3:
            x = (0.0 if r.tie % 7 == 0 else 0.9) * x + r.price
        want.append(x)
    assert np.allclose(got["x"], want)


def test_average_price_begins_anew_when_flat(spark):
    from barwise.operators.performance import average_prices

    ev = [(1, 1.0, 10.0), (2, -1.0, 99.0), (3, 1.0, 20.0), (4, 3.0, 24.0), (5, -2.0, 50.0), (6, 2.0, None), (7, 4.0, 31.0)]
    df = spark.createDataFrame([("s", T0 + dt.timedelta(days=i), i, "long", v, p) for i, v, p in ev] + [("s", T0, 0, "short", 5.0, 7.0)], "symbol string, ts timestamp_ntz, tie int, side string, volume double, price double")
    got = {(r["side"], r["tie"]): r["avg_price"] for r in average_prices(df).collect()}
    assert got["long", 2] is None
    assert [got["long", i] for i in (1, 3, 4, 5, 6, 7)] == pytest.approx([10.0, 20.0, 23.0, 23.0, 23.0, 27.0]) and got["short", 0] == 7.0


def test_tail_probabilities(spark):
    """Against tabled values of F, the normal and the unit-root distribution."""
    from barwise.functions.special import f_tail, normal

    d = spark.createDataFrame([(4.9646, 1.0, 10.0), (3.4928, 2.0, 20.0), (1.8409, 12.0, 100.0), (0.0, 1.0, 5.0), (None, 1.0, 5.0)], "f double, a double, b double")
    got = [r[0] for r in d.select(f_tail(F.col("f"), F.col("a"), F.col("b"))).collect()]
    assert got[:4] == pytest.approx([0.05, 0.05, 0.0512, 1.0], abs=4e-4) and got[4] is None
    z = spark.createDataFrame([(-1.959964,), (0.0,), (2.575829,)], "z double").select(normal(F.col("z"))).collect()
    assert [r[0] for r in z] == pytest.approx([0.025, 0.5, 0.995], abs=1e-6)
    t = spark.createDataFrame([(-2.8615,), (-3.4304,), (-1.0,), (-30.0,), (5.0,)], "t double").select(K.unit_root_probability(F.col("t"))).collect()
    assert [r[0] for r in t] == pytest.approx([0.05, 0.01, 0.75, 0.0, 1.0], abs=6e-3)


def test_tick_bars_of_one_tick(ticks):
    got = {(r["symbol"], r["ticks"]): r["count"] for r in B.tick_bars(ticks[0], 1).groupBy("symbol", "ticks").count().collect()}
    assert got == {("a", 2): 1, ("a", 1): 1498, ("b", 2): 1, ("b", 1): 38}


def test_close_values_spread_over_all_ranges(spark):
    """Values within 1 % of each other do not become one range, and quantiles of them are exact."""
    from barwise.operators.quantiles import quantiles

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(100_000).select(F.lit("a").alias("symbol"), (100 + F.col("id") / 100_000).alias("v"))
        sizes = [r["count"] for r in frames.ranged(df, "symbol", "v").groupBy("_p").count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)
        assert quantiles(df, "v", ["symbol"], [0.25, 0.5]).first()["_q"] == pytest.approx([100.2499975, 100.499995])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("name", ["perf_underwater", "norm_rate", "perf_pnl_position", "sw_avg_uniqueness", "bar_time", "bar_volume", "perf_position", "describe_stats"])
def test_plans_do_not_double(spark, name, monkeypatch):
    """Each written intermediate and the query itself read a source at most twice; steps of a chain do not multiply."""
    import re
    from collections import Counter
    from pathlib import Path

    import __spark_entry__ as entry
    from barwise import session
    from barwise.operators import clean

    base = "/root/testdata/sf0.001"
    if not Path(base).exists():
        pytest.skip("test tables not there")
    plans, write = [], session.stored

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def watched(df):
        plans.append(plan(df))
        return write(df)

    for module in (session, frames, clean):
        monkeypatch.setattr(module, "stored", watched)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plans.append(plan(entry.queries()[name](spark, base)))
    for p in plans:
        read = Counter(re.findall(r"Location: [^\[]*\[file:[^\]]*?/(\w+\.parquet|barwise-table)", p))
        assert sum(read.values()) and max([n for t, n in read.items() if t != "barwise-table"], default=0) <= 2, read
        assert read["barwise-table"] <= 8 and p.count("Exchange hashpartitioning") <= 21 and p.count("Window [") <= 10, p
