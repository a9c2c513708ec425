"""Queries over the time-series operators, each with the SQL it is checked against.

A query is registered with the columns that are compared exactly and those that are
rounded; both sides get the same treatment, so summation order does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions.frames import running
from barwise.operators import bars as B
from barwise.operators import breaks as K
from barwise.operators import clean as C
from barwise.operators import codependence as D
from barwise.operators import crosssection as X
from barwise.operators import indicators as I
from barwise.operators import labels as L
from barwise.operators import performance as P
from barwise.session import epoch_us, number, table
from barwise.sources import views as V
from barwise.sources.store import chunks, contains_any, last_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

T, PR, BA, PA, IV = V.TICKS_SQL, V.PRICES_SQL, V.BARS_SQL, V.PANEL_SQL, V.INTERVALS_SQL
WIN = "(partition by symbol order by ts, tie)"


def query(exact: str, rounded: str = "", sql: str | None = None, ctes: str = "", digits: int = 6, longs: str = "") -> Callable[[Query], Query]:
    """Register a query; ``exact``, ``rounded`` and ``longs`` are column names separated by blanks."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*exact.split(), *[F.round(F.col(c) + 1e-11, digits).alias(c) for c in rounded.split()], *[F.col(c).cast("long").alias(c) for c in longs.split()])

        QUERIES[fn.__name__] = run
        if sql:
            cols = [*exact.split(), *[f"round(({c})::double + 1e-11, {digits}) as {c}" for c in rounded.split()], *[f"{c}::bigint as {c}" for c in longs.split()]]
            ORACLES[fn.__name__] = (f"with {ctes}\n" if ctes else "") + f"select {', '.join(cols)} from ({sql}) q_"
        return run

    return wrap


# ------------------------------------------------------------------------------------ bars from ticks

_BAR = "ticks long_ticks short_ticks"
_BARV = "volume long_volume short_volume dollar long_dollar short_dollar high low open close"
_SIGNS = T + f""", s0 as (select *, row_number() over {WIN} - 1 as rn, price - lag(price) over {WIN} as d from t),
  s as (select *, coalesce(last_value(nullif(sign(d), 0) ignore nulls) over (partition by symbol order by ts, tie rows unbounded preceding), 0) as sg from s0)"""
_AGG = """min(ts) as start_ts, max(ts) as end_ts, count(*) as ticks, count(*) filter (where sg > 0) as long_ticks, count(*) filter (where sg < 0) as short_ticks,
  sum(volume) as volume, coalesce(sum(volume) filter (where sg > 0), 0) as long_volume, coalesce(sum(volume) filter (where sg < 0), 0) as short_volume,
  sum(price * volume) as dollar, coalesce(sum(price * volume) filter (where sg > 0), 0) as long_dollar, coalesce(sum(price * volume) filter (where sg < 0), 0) as short_dollar,
  max(high) as high, min(low) as low, arg_min(price, struct_pack(a := ts, b := tie)) as open, arg_max(price, struct_pack(a := ts, b := tie)) as close"""


@query("symbol start_ts end_ts", _BARV, f"""select symbol, {_AGG} from c where bar < closed group by symbol, bar""",
       _SIGNS + f""", q as (select *, epoch_us(ts) // 21600000000 as q from s), z as (select *, coalesce(q > lag(q) over {WIN}, false)::int as cl from q),
       c0 as (select *, sum(cl) over (partition by symbol order by ts, tie rows unbounded preceding) as upto from z),
       c as (select *, upto - cl as bar, max(upto) over (partition by symbol) as closed from c0)""", digits=4, longs=_BAR)  # fmt: skip
def bar_time(spark, sf):  # noqa: ANN001, ANN201
    return B.time_bars(V.ticks(spark, sf), 21_600)


@query("symbol start_ts end_ts", _BARV, f"select symbol, {_AGG} from s group by symbol, rn // 25 having count(*) = 25", _SIGNS, digits=4, longs=_BAR)
def bar_tick(spark, sf):  # noqa: ANN001, ANN201
    return B.tick_bars(V.ticks(spark, sf), 25)


def _fold_sql(metric: str, threshold: float) -> str:
    return (
        _SIGNS.replace("t as (", "recursive t as (", 1)
        + f""", m as (select *, ({metric})::double as x from s),
        r as (select symbol, rn, 0::bigint as bar, x as total, false as cl from m where rn = 0
              union all select m.symbol, m.rn, r.bar + r.cl::int, case when r.cl then 0.0 else r.total end + m.x,
                               (case when r.cl then 0.0 else r.total end + m.x) >= {threshold} from r join m on m.symbol = r.symbol and m.rn = r.rn + 1),
        b as (select m.*, r.bar, max(case when r.cl then 1 else 0 end) over (partition by r.symbol, r.bar) as done from m join r on r.symbol = m.symbol and r.rn = m.rn)"""
    )


def _fold_query(name: str, metric: str, sql: str, threshold: float) -> None:
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        return B.constant_bars(V.ticks(spark, sf), metric, threshold)

    fn.__name__ = name
    query("symbol start_ts end_ts", _BARV, f"select symbol, {_AGG} from b where done = 1 group by symbol, bar", _fold_sql(sql, threshold), digits=4, longs=_BAR)(fn)


for _n, _m, _s, _t in (
    ("bar_volume", "volume_imbalance", "volume", 1500), ("bar_dollar", "dollar_value_imbalance", "price * volume", 60_000), ("bar_tick_imb", "signal_imbalance", "sg", 3),
    ("bar_volume_imb", "signal_volume_imbalance", "sg * volume", 250), ("bar_dollar_imb", "signal_dollar_value_imbalance", "sg * price * volume", 20_000),
):
    _fold_query(_n, _m, _s, _t)


_EMA = _SIGNS.replace("t as (", "recursive t as (", 1) + f""", w as (select [0.8 * pow(0.2, 4), 0.8 * pow(0.2, 3), 0.8 * pow(0.2, 2), 0.8 * 0.2, 0.8] as v), ww as (select list_transform(v, lambda x: x / list_sum(v)) as w from w),
  r as (select symbol, rn, 0::bigint as bar, volume as total, [volume] as recent, []::double[] as lens, 0::bigint as last, 50.0::double as ei, 20.0::double as et, volume >= 1000 as cl from s where rn = 0
        union all select symbol, rn, bar, total, recent, lens, last, ei, et, total >= ei * et from
        (select s.symbol, s.rn, r.bar + r.cl::int as bar, case when r.cl then 0 else r.total end + s.volume as total, list_append(r.recent, s.volume)[-5:] as recent, l.lens, case when r.cl then r.rn else r.last end as last,
                case when r.cl and len(r.recent) >= 5 then list_dot_product(r.recent[-5:], ww.w) else r.ei end as ei, case when r.cl and len(l.lens) >= 5 then list_dot_product(l.lens, ww.w) else r.et end as et
         from r join s on s.symbol = r.symbol and s.rn = r.rn + 1, ww, lateral (select case when r.cl then list_append(r.lens, (r.rn - r.last)::double)[-5:] else r.lens end as lens) l)),
  b as (select s.*, r.bar, max(case when r.cl then 1 else 0 end) over (partition by r.symbol, r.bar) as done from s join r on r.symbol = s.symbol and r.rn = s.rn)"""


@query("symbol start_ts end_ts", _BARV, f"select symbol, {_AGG} from b where done = 1 group by symbol, bar", _EMA, digits=4, longs=_BAR)
def bar_ema_imb(spark, sf):  # noqa: ANN001, ANN201
    return B.ema_bars(V.ticks(spark, sf), "volume_imbalance", 20, 50.0)


@query("symbol bucket_ts", "price volume", """select g.symbol, make_timestamp(g.b * 21600000000) as bucket_ts, price, volume from
       (select symbol, unnest(range(min(epoch_us(ts) // 21600000000), max(epoch_us(ts) // 21600000000) + 1)) as b from t group by symbol) g
       left join (select symbol, epoch_us(ts) // 21600000000 as b, arg_max(price, struct_pack(a := ts, b := tie)) as price, arg_max(volume, struct_pack(a := ts, b := tie)) as volume from t group by all) l
       on l.symbol = g.symbol and l.b = g.b""", T)  # fmt: skip
def resample_last(spark, sf):  # noqa: ANN001, ANN201
    return B.resample_last(V.ticks(spark, sf), 21_600, ["price", "volume"])


@query("symbol end_ts", "volume close", """select symbol, max(ts) as end_ts, count(*) as ticks, sum(volume) as volume, arg_max(price, struct_pack(a := ts, b := tie)) as close from c
       group by symbol, bar having max(cl) = 1""",
       T + """, e as (select distinct symbol, time_bucket(interval 1 day, ts) + interval 1 day as ts from t),
       u as (select symbol, ts, tie, price, volume, 1 as k from t union all select symbol, ts, -1, null, null, 0 from e),
       z as (select *, (k = 1 and coalesce(lag(k) over (partition by symbol order by ts, tie), 1) = 0)::int as cl from u),
       c as (select *, sum(cl) over (partition by symbol order by ts, tie rows unbounded preceding) - cl as bar from z where true qualify k = 1 or k = 0), d as (select * from c)""".replace(", d as (select * from c)", "").replace(" where true qualify k = 1 or k = 0", ""), longs="ticks")  # fmt: skip
def join_bar_boundaries(spark, sf):  # noqa: ANN001, ANN201
    t = V.ticks(spark, sf)
    ends = t.select("symbol", F.timestamp_add("DAY", F.lit(1), F.date_trunc("day", "ts")).cast("timestamp_ntz").alias("end_ts")).distinct()
    return B.bars_at(t, ends)


ORACLES["join_bar_boundaries"] = ORACLES["join_bar_boundaries"].replace("arg_max(price, struct_pack(a := ts, b := tie)) as close from c\n", "arg_max(price, struct_pack(a := ts, b := tie)) as close from (select * from c where k = 1)\n")

# ------------------------------------------------------------------------------------ cleaning and scaling


def _p(spark: SparkSession, sf: str) -> DataFrame:
    return V.prices(spark, sf)


@query("symbol ts tie", "clipped", "select symbol, ts, tie, greatest(least(price, quantile_cont(price, 0.99) over (partition by symbol)), quantile_cont(price, 0.01) over (partition by symbol)) as clipped from p", PR)
def clean_clip_quantile(spark, sf):  # noqa: ANN001, ANN201
    return C.clip_quantile(_p(spark, sf))


@query("symbol ts tie", "clipped", "select symbol, ts, tie, greatest(least(price, 1000), 10) as clipped from p", PR)
def clean_clip_range(spark, sf):  # noqa: ANN001, ANN201
    return _p(spark, sf).withColumn("clipped", C.clip_range(F.col("price"), 10.0, 1000.0))


@query("symbol ts tie", "diff log_price log_diff pct", f"""select symbol, ts, tie, price - lag(price) over {WIN} as diff, ln(price) as log_price, ln(price) - ln(lag(price) over {WIN}) as log_diff,
       price / lag(price) over {WIN} - 1 as pct from p""", PR)  # fmt: skip
def pct_change(spark, sf):  # noqa: ANN001, ANN201
    return C.changes(_p(spark, sf))


_LD = PR + f", ld as (select symbol, ts, tie, ln(price) - ln(lag(price) over {WIN}) as x from p)"


@query("symbol ts tie", "z", "select symbol, ts, tie, abs(x - avg(x) over (partition by symbol)) / nullif(stddev_pop(x) over (partition by symbol), 0) as z from ld", _LD, digits=5)
def zscore_log_diff(spark, sf):  # noqa: ANN001, ANN201
    return C.zscore(C.changes(_p(spark, sf)), "log_diff", absolute=True)


@query("symbol ts tie", "z", "select symbol, ts, tie, (price - avg(price) over (partition by symbol)) / nullif(stddev_pop(price) over (partition by symbol), 0) as z from t", T)
def standardize(spark, sf):  # noqa: ANN001, ANN201
    return C.zscore(V.ticks(spark, sf), "price")


@query("symbol ts tie", "aligned", f"select symbol, ts, tie, price / first_value(price) over {WIN} as aligned from p", PR)
def align_price(spark, sf):  # noqa: ANN001, ANN201
    return C.align(_p(spark, sf))


@query("symbol ts tie", "consist", """select symbol, ts, tie, sum(coalesce(z, 0) * 0.01) over (partition by symbol order by ts, tie rows unbounded preceding) as consist
       from (select *, abs(x - avg(x) over (partition by symbol)) / nullif(stddev_pop(x) over (partition by symbol), 0) as z from ld)""", _LD, digits=5)  # fmt: skip
def consist_log_price(spark, sf):  # noqa: ANN001, ANN201
    return C.consistent_log_price(_p(spark, sf))


_NORM = T + f""", r0 as (select symbol, ts, tie, price, row_number() over {WIN} as rn, coalesce(price / lag(price) over {WIN}, 1.0) as rate from t),
  r1 as (select *, greatest(least(rate, quantile_cont(rate, 0.99) over (partition by symbol)), quantile_cont(rate, 0.01) over (partition by symbol)) - 1 as x from r0),
  r2 as (select *, case when rn = 1 then 0.0 else x * 0.01 / stddev_pop(x) over (partition by symbol) end as rate2 from r1)"""


@query("symbol ts tie", "rate close", """select symbol, ts, tie, rate2 as rate, exp(sum(ln(1 + rate2)) over (partition by symbol order by ts, tie rows unbounded preceding)) as close,
       hour(ts) as hour, isodow(ts) - 1 as weekday from r2""", _NORM, longs="hour weekday")  # fmt: skip
def norm_rate(spark, sf):  # noqa: ANN001, ANN201
    return C.normalised_rates(V.ticks(spark, sf))


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks with their simple rate (null at the start)."""
    return C.changes(V.ticks(spark, sf)).withColumn("rate", F.col("pct"))


_RATE = T + f", n as (select *, row_number() over {WIN} - 1 as rn, price / lag(price) over {WIN} - 1 as rate from t)"
_RATEP = T + f", n as (select *, row_number() over {WIN} - 1 as rn, price / lag(price) over {WIN} - 1 as rate from t)"


@query("symbol ts tie", "z", "select symbol, ts, tie, (rate - avg(rate) over h) / nullif(stddev_samp(rate) over h, 0) as z from n window h as (partition by symbol, hour(ts))", _RATE)
def group_zscore_hour(spark, sf):  # noqa: ANN001, ANN201
    return C.zscore(_rates(spark, sf).withColumn("hour", F.hour("ts")), "rate", by=("symbol", "hour"), sample=True)


@query("symbol ts tie", "z", "select symbol, ts, tie, (rate - avg(rate) over h) / nullif(stddev_samp(rate) over h, 0) as z from n window h as (partition by symbol, isodow(ts))", _RATE)
def group_zscore_weekday(spark, sf):  # noqa: ANN001, ANN201
    return C.zscore(_rates(spark, sf).withColumn("wd", F.weekday("ts")), "rate", by=("symbol", "wd"), sample=True)


@query("symbol ts tie", "scaled", """select symbol, ts, tie, 0.01 / nullif(case when count(rate) over f = 90 then stddev_samp(rate) over f end, 0) * rate as scaled
       from n window f as (partition by symbol order by ts, tie rows between 89 preceding and current row)""", _RATE)  # fmt: skip
def roll_std_scale(spark, sf):  # noqa: ANN001, ANN201
    from barwise.functions.frames import full, rolling

    d = rolling(_rates(spark, sf), lambda w: {"_s": full(F.stddev_samp, "rate", w, 90)}, back=90)
    return d.withColumn("scaled", F.try_divide(F.lit(0.01), F.col("_s")) * F.col("rate"))


@query("tie date_text parsed", sql="select tie, strftime(ts, '%Y-%m-%d %H:%M:%S') as date_text, date_trunc('second', ts) as parsed, hour(ts) as hour, isodow(ts) - 1 as weekday, day(ts) as day from t", ctes=T, longs="hour weekday day")
def dt_functions(spark, sf):  # noqa: ANN001, ANN201
    t = V.ticks(spark, sf).withColumn("date_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.withColumn("parsed", F.to_timestamp_ntz("date_text", F.lit("yyyy-MM-dd HH:mm:ss"))).withColumns({"hour": F.hour("ts"), "weekday": F.weekday("ts"), "day": F.dayofmonth("ts")})


@query("symbol ts tie", "u2 u1 ue", "select symbol, ts, tie, (power(1 + rate, -1.0) - 1) / -1.0 as u2, ln(1 + rate) as u1, exp(abs(rate) * 0.1) * rate as ue from n where rate is not null and 1 + rate > 0.01 and rate < 100", _RATE)
def utility_functions(spark, sf):  # noqa: ANN001, ANN201
    d = _rates(spark, sf).filter("rate is not null and 1 + rate > 0.01 and rate < 100")
    g = 1 + F.col("rate")
    return d.withColumns({"u2": P.isoelastic(g, 2.0), "u1": P.isoelastic(g, 1), "ue": P.exponential(F.col("rate"))})


# ------------------------------------------------------------------------------------ indicators and features


def _ewm_sql(src: str, col: str, out: str, q: float, reach: int) -> str:
    return f"""{out}_t as (select a.symbol, a.rn, sum(b.{col} * pow({q!r}, a.rn - b.rn)) / nullif(sum(case when b.{col} is not null then pow({q!r}, a.rn - b.rn) end), 0) as {out}
              from {src} a join {src} b on b.symbol = a.symbol and b.rn between a.rn - {reach} and a.rn group by all)"""


_N = T + f", n as (select *, row_number() over {WIN} - 1 as rn from t)"
_MACD = _N + ", " + _ewm_sql("n", "price", "f", 1 - 2 / 13, 480) + ", " + _ewm_sql("n", "price", "g", 1 - 2 / 27, 480)
_MACD += ", m as (select n.*, f - g as dif from n join f_t using (symbol, rn) join g_t using (symbol, rn)), " + _ewm_sql("m", "dif", "dea", 1 - 2 / 10, 480)


@query("symbol ts tie", "dif dea macd", "select symbol, ts, tie, dif, dea, 2 * (dif - dea) as macd from m join dea_t using (symbol, rn)", _MACD)
def ind_macd(spark, sf):  # noqa: ANN001, ANN201
    return I.macd(V.ticks(spark, sf))


_KDJ = _N + """, r as (select *, case when count(price) over f = 9 then (price - min(price) over f) / nullif(max(price) over f - min(price) over f, 0) * 100 end as rsv
  from n window f as (partition by symbol order by rn rows between 8 preceding and current row)), """ + _ewm_sql("r", "rsv", "k", 2 / 3, 120)
_KDJ += ", kk as (select r.*, k from r join k_t using (symbol, rn)), " + _ewm_sql("kk", "k", "d", 2 / 3, 120)


@query("symbol ts tie", "kdj_k kdj_d kdj_j", "select symbol, ts, tie, k as kdj_k, d as kdj_d, 3 * k - 2 * d as kdj_j from kk join d_t using (symbol, rn)", _KDJ)
def ind_kdj(spark, sf):  # noqa: ANN001, ANN201
    return I.kdj(V.ticks(spark, sf))


def _f(n: int) -> str:
    return f"(partition by symbol order by ts, tie rows between {n - 1} preceding and current row)"


@query("symbol ts tie", "ma_5 ma_20 ma_60", "select symbol, ts, tie, " + ", ".join(f"case when count(price) over {_f(n)} = {n} then avg(price) over {_f(n)} end as ma_{n}" for n in (5, 20, 60)) + " from p", PR)
def ind_ma(spark, sf):  # noqa: ANN001, ANN201
    return I.moving_averages(_p(spark, sf), (5, 20, 60))


@query("symbol ts tie", "kyle", f"select symbol, ts, tie, case when count(x) over {_f(20)} = 20 then avg(x) over {_f(20)} end as kyle from (select *, d / nullif(volume * sg, 0) as x from s)", _SIGNS)
def ms_kyle_bar(spark, sf):  # noqa: ANN001, ANN201
    return I.kyle_bars(V.ticks(spark, sf))


@query("symbol ts tie", "amihud", f"select symbol, ts, tie, case when count(x) over {_f(20)} = 20 then avg(x) over {_f(20)} end as amihud from (select *, abs(ln(price / lag(price) over {WIN})) / sqrt(price * volume) as x from t)", T, digits=7)
def ms_amihud_bar(spark, sf):  # noqa: ANN001, ANN201
    return I.amihud_bars(V.ticks(spark, sf))


_ORIGIN = """select symbol, b as beta, b / sqrt((yy - b * b * xx) / (n - 1) / xx) as t_value, n from
  (select symbol, sum(x * y) / sum(x * x) as b, sum(x * x) as xx, sum(y * y) as yy, count(*) as n from o where x is not null and y is not null group by symbol)"""


@query("symbol", "beta t_value", _ORIGIN, _SIGNS + ", o as (select symbol, volume * sg as x, d as y from s)", longs="n")
def ms_kyle_trade(spark, sf):  # noqa: ANN001, ANN201
    return I.kyle_trades(V.ticks(spark, sf))


@query("symbol", "beta t_value", _ORIGIN, T + f", o as (select symbol, price * volume as x, abs(ln(price / lag(price) over {WIN})) as y from t)", longs="n", digits=7)
def ms_hasbrouck_trade(spark, sf):  # noqa: ANN001, ANN201
    return I.hasbrouck_trades(V.ticks(spark, sf))


_FW = I.frac_diff_weights(0.4, 30)


@query("symbol ts tie", "frac", "select symbol, ts, tie, " + " + ".join(f"coalesce(lag(price, {k}) over {WIN}, 0) * ({c!r})" if k else f"price * {c!r}" for k, c in enumerate(_FW)) + " as frac from t", T)
def feat_fracdiff(spark, sf):  # noqa: ANN001, ANN201
    return I.frac_diff(V.ticks(spark, sf))


@query("k", "w", "select k, w from r", """recursive r as (select 0::bigint as k, 1.0::double as w union all select k + 1, -w * (0.4 - k) / (k + 1) from r where k < 29)""", digits=9)
def feat_fracdiff_weights(spark, sf):  # noqa: ANN001, ANN201
    return spark.createDataFrame(list(enumerate(I.frac_diff_weights(0.4, 30))), "k long, w double")


@query("symbol ts tie", "ret_5 ret_10 ret_20 ret_40", "select symbol, ts, tie, " + ", ".join(f"price / lag(price, {k}) over {WIN} - 1 as ret_{k}" for k in (5, 10, 20, 40)) + " from p", PR)
def feat_lag_return(spark, sf):  # noqa: ANN001, ANN201
    return I.lag_returns(_p(spark, sf))


@query("symbol ts tie", "ratio", f"select symbol, ts, tie, case when count(price) over {_f(5)} = 5 then avg(price) over {_f(5)} end / case when count(price) over {_f(20)} = 20 then avg(price) over {_f(20)} end - 1 as ratio from p", PR)
def feat_ma_ratio(spark, sf):  # noqa: ANN001, ANN201
    return I.moving_averages(_p(spark, sf), (5, 20)).withColumn("ratio", F.try_divide("ma_5", "ma_20") - 1)


@query("symbol ts tie", "lag_1 lag_7 lag_19", f"select symbol, ts, tie, lag(rate, 1) over {WIN} as lag_1, lag(rate, 7) over {WIN} as lag_7, lag(rate, 19) over {WIN} as lag_19 from n", _RATE)
def feat_rate_lags(spark, sf):  # noqa: ANN001, ANN201
    return I.rate_lags(_rates(spark, sf))


def _disc(fn: str, n: int, shift: int) -> str:
    return " + ".join(("rate" if j + shift == 0 else f"{fn}(rate, {j + shift}) over {WIN}") + f" * {0.9**j!r}" for j in range(n))


@query("symbol ts tie", "reward_1 reward_5 reward_20", "select symbol, ts, tie, " + ", ".join(f"{_disc('lag', n, 0)} as reward_{n}" for n in (1, 5, 20)) + " from n", _RATE)
def feat_discounted_past(spark, sf):  # noqa: ANN001, ANN201
    return I.discounted_past(_rates(spark, sf), spans=(1, 5, 20))


@query("symbol ts tie", "rd_1 rd_5 rd_10 rd_5_dire rd_5_scale", "select *, sign(rd_5) as rd_5_dire, abs(rd_5) as rd_5_scale from (select symbol, ts, tie, " + ", ".join(f"{_disc('lead', n, 1)} as rd_{n}" for n in (1, 5, 10)) + " from n)", _RATE)
def lab_discounted_future(spark, sf):  # noqa: ANN001, ANN201
    return I.discounted_future(_rates(spark, sf))


def _nf(n: int) -> str:
    return f"(partition by symbol order by ts, tie rows between 1 following and {n} following)"


@query("symbol ts tie", "up_5 down_5 up_10 down_10", "select symbol, ts, tie, " + ", ".join(f"case when count(price) over {_nf(k)} = {k} then {f}(price) over {_nf(k)} end / price - 1 as {n}_{k}" for k in (5, 10) for n, f in (("up", "max"), ("down", "min"))) + " from p", PR)
def lab_future_extreme(spark, sf):  # noqa: ANN001, ANN201
    return I.future_extremes(_p(spark, sf), (5, 10))


@query("symbol ts tie", "slope_5 intercept_5 slope_20 intercept_20", "select *, " + ", ".join(f"avg_{n} - slope_{n} * {(n - 1) / 2} as intercept_{n}" for n in (5, 20)) + " from (select symbol, ts, tie, " + ", ".join(f"case when count(price) over {_f(n)} = {n} then regr_slope(price, rn) over {_f(n)} end as slope_{n}, avg(price) over {_f(n)} as avg_{n}" for n in (5, 20)) + " from n)", _N)
def feat_slope_intercept(spark, sf):  # noqa: ANN001, ANN201
    return I.slopes(V.ticks(spark, sf), (5, 20))


@query("symbol ts tie", "fut_slope_5 fut_slope_20", "select symbol, ts, tie, " + ", ".join(f"case when count(price) over {_nf(n)} = {n} then regr_slope(price, rn) over {_nf(n)} end as fut_slope_{n}" for n in (5, 20)) + " from n", _N)
def lab_future_slope(spark, sf):  # noqa: ANN001, ANN201
    return I.future_slopes(V.ticks(spark, sf), (5, 20))


@query("symbol ts tie", "pre_5 fut_5 pre_17 fut_17", "select symbol, ts, tie, " + ", ".join(f"case when count(rate) over {_f(k)} = {k} then sum(rate) over {_f(k)} end as pre_{k}, case when count(rate) over {_nf(k)} = {k} then sum(rate) over {_nf(k)} end as fut_{k}" for k in (5, 17)) + " from n", _RATE)
def pre_fut_sums(spark, sf):  # noqa: ANN001, ANN201
    return I.past_future_sums(_rates(spark, sf), spans=(5, 17))


@query("symbol", "std", "select symbol, length, stddev_pop(r) as std from (" + " union all ".join(f"select symbol, {k} as length, price / lag(price, {k}) over {WIN} - 1 as r from t" for k in (1, 9, 99, 199)) + ") group by symbol, length", T, longs="length")
def var_by_length(spark, sf):  # noqa: ANN001, ANN201
    return I.variance_by_length(V.ticks(spark, sf), (1, 9, 99, 199))


@query("symbol ts tie", "z next_value", f"select * from (select symbol, ts, tie, z, lead(z) over {WIN} as next_value from (select *, (rate - avg(rate) over (partition by symbol)) / stddev_pop(rate) over (partition by symbol) as z from n)) where z is not null and next_value is not null", _RATE)
def autocorr_pairs(spark, sf):  # noqa: ANN001, ANN201
    return I.successive_pairs(C.zscore(_rates(spark, sf), "rate"), "z")


# ------------------------------------------------------------------------------------ filters, sorts, sets, searches


@query("symbol sec_name", sql="select symbol, sec_name from contracts where contains(sec_name, 'month') or contains(sec_name, 'contin')")
def filter_contains_any(spark, sf):  # noqa: ANN001, ANN201
    return contains_any(table(spark, sf, "contracts"), "sec_name", ["month", "contin"])


@query("symbol", sql="select symbol, count(*) as n from bars where symbol is not null group by symbol having count(*) >= 500", longs="n")
def filter_min_rows(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "bars").filter("symbol is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n >= 500")


@query("code venue", sql="select sec_id as code, exchange as venue from contracts")
def project_columns(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "contracts").select(F.col("sec_id").alias("code"), F.col("exchange").alias("venue"))


@query("bar_id", sql="select bar_id from bars where symbol is not null and open is not null and not isnan(open) and close is not null and not isnan(close) and volume is not null and amount is not null and position is not null and eob is not null")
def dropna_any(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "bars").dropna("any", subset=["symbol", "open", "close", "volume", "amount", "position", "eob"])


@query("bar_id", sql="select bar_id from bars where bob between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-20 12:00:00'")
def slice_loc_range(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "bars").filter("bob between timestamp_ntz'2024-01-10 00:00:00' and timestamp_ntz'2024-01-20 12:00:00'")


@query("symbol ts tie", sql=f"select symbol, ts, tie from (select *, row_number() over (partition by symbol order by ts, tie) as k from p where ts >= timestamp '2024-01-15 00:00:00') where k <= 10", ctes=PR)
def slice_iloc_head(spark, sf):  # noqa: ANN001, ANN201
    from barwise.functions.frames import numbered

    return numbered(_p(spark, sf).filter("ts >= timestamp_ntz'2024-01-15 00:00:00'")).filter("rn < 10")


@query("symbol ts tie", sql=f"select symbol, ts, tie, row_number() over {WIN} - 1 as rn from p", ctes=PR, longs="rn")
def sort_time(spark, sf):  # noqa: ANN001, ANN201
    from barwise.functions.frames import numbered

    return numbered(_p(spark, sf))


@query("symbol ts kind", sql="select symbol, bob as ts, 'bar' as kind from bars union all select symbol, created_at, 'tick' from ticks")
def union_frames(spark, sf):  # noqa: ANN001, ANN201
    b, t = table(spark, sf, "bars"), table(spark, sf, "ticks")
    return b.select("symbol", F.col("bob").alias("ts"), F.lit("bar").alias("kind")).unionByName(t.select("symbol", F.col("created_at").alias("ts"), F.lit("tick").alias("kind")))


@query("symbol bob close", sql="select distinct symbol, bob, case when isnan(close) then null else close end as close from bars")
def distinct_rows(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "bars").select("symbol", "bob", number("close").alias("close")).distinct()


@query("freq", sql="select distinct freq from bars")
def distinct_labels(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "bars").select("freq").distinct()


@query("symbol bar_id", "volume", sql="""select symbol, bar_id, volume from (select *, row_number() over (partition by symbol order by volume desc, bar_id) as k from bars
       where symbol is not null and volume is not null) where k = 1""")  # fmt: skip
def topk_argmax(spark, sf):  # noqa: ANN001, ANN201
    b = table(spark, sf, "bars").filter("symbol is not null and volume is not null")
    best = b.groupBy("symbol").agg(F.max(F.struct("volume", (-F.col("bar_id")).alias("n"))).alias("m"))
    return best.select("symbol", (-F.col("m.n")).alias("bar_id"), F.col("m.volume").alias("volume"))


@query("symbol ts tie", sql=f"select symbol, ts, tie from (select *, row_number() over (partition by symbol order by ts desc, tie desc) as k from p) where k <= 20", ctes=PR)
def src_history_n(spark, sf):  # noqa: ANN001, ANN201
    return last_rows(_p(spark, sf), 20)


@query("symbol ts tie", sql="select symbol, ts, tie from p where ts >= timestamp '2024-01-08 00:00:00' and ts < timestamp '2024-01-12 00:00:00'", ctes=PR)
def src_history_range(spark, sf):  # noqa: ANN001, ANN201
    return _p(spark, sf).filter("ts >= timestamp_ntz'2024-01-08 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'")


@query("symbol chunk_start chunk_end", sql="""select symbol, c as chunk_start, least(c + interval 5 day, z) as chunk_end from
       (select symbol, z, unnest(generate_series(a, z, interval 5 day)) as c from (select symbol, min(bob) as a, max(bob) as z from bars where symbol is not null group by symbol)) where c < z""")  # fmt: skip
def src_chunked_bars(spark, sf):  # noqa: ANN001, ANN201
    tasks = table(spark, sf, "bars").filter("symbol is not null").groupBy("symbol").agg(F.min("bob").alias("start_ts"), F.max("bob").alias("end_ts"))
    return chunks(tasks, 5 * 86_400)


@query("symbol sec_name", sql="select distinct b.symbol, c.sec_name from bars b join contracts c on c.symbol = b.symbol")
def join_contract_dim(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "contracts").select("symbol", "sec_name")
    return c.join(table(spark, sf, "bars").select("symbol"), "symbol", "left_semi")


@query("event_id place", sql="""select e.event_id, count(b.ts) filter (where b.ts < e.date_time)::bigint as place from (select event_id, symbol, date_time from event_df where symbol is not null and date_time is not null) e
       join (select distinct symbol from p) k on k.symbol = e.symbol left join p b on b.symbol = e.symbol and b.ts < e.date_time group by e.event_id""", ctes=PR)  # fmt: skip
def search_index(spark, sf):  # noqa: ANN001, ANN201
    """Insertion place (left) of each event time in its symbol's bars: a running count over both, block by block."""
    p = _p(spark, sf)
    e = table(spark, sf, "event_df").filter("symbol is not null and date_time is not null").join(p.select("symbol").distinct(), "symbol", "left_semi")
    both = e.select("symbol", F.col("date_time").alias("ts"), F.struct(F.lit(0).alias("a"), F.col("event_id").alias("b")).alias("tie"), F.lit(0).alias("k")).unionByName(
        p.select("symbol", "ts", F.struct(F.lit(1).alias("a"), F.col("tie").alias("b")).alias("tie"), F.lit(1).alias("k")))
    return running(both, sums={"place": F.col("k")}).filter("k = 0").select(F.col("tie.b").alias("event_id"), "place")


@query("event_id found_ts", "found", """select e.event_id, p.ts as found_ts, p.price as found from (select event_id, symbol, date_time from event_df where symbol is not null and date_time is not null) e
       asof join p on p.symbol = e.symbol and p.ts >= e.date_time""", PR)  # fmt: skip
def join_asof_forward(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "event_df").select("event_id", "symbol", "date_time").filter("symbol is not null and date_time is not null")
    return L.asof_forward(e, _p(spark, sf), "date_time")


@query("symbol ts aux_ts", "lag_s", """select symbol, ts, arg_max(aux_ts, aux_ts) as aux_ts, epoch(ts) - epoch(max(aux_ts)) as lag_s from
       (select a.symbol, a.ts as aux_ts, p.ts from a asof join p on p.symbol = a.symbol and p.ts >= a.ts) where epoch(ts) - epoch(aux_ts) >= 60 group by symbol, ts""",
       PR + ", a as (select symbol, created_at as ts from ticks where symbol is not null and created_at is not null)")
def join_asof_multi_period(spark, sf):  # noqa: ANN001, ANN201
    aux = table(spark, sf, "ticks").select("symbol", F.col("created_at").alias("aux_ts")).filter("symbol is not null and aux_ts is not null")
    d = L.asof_forward(aux, _p(spark, sf), "aux_ts").withColumn("_lag", (epoch_us("found_ts") - epoch_us("aux_ts")) / 1e6).filter("_lag >= 60")
    return d.groupBy("symbol", F.col("found_ts").alias("ts")).agg(F.max("aux_ts").alias("aux_ts"), F.min("_lag").alias("lag_s"))


# ------------------------------------------------------------------------------------ labels and weights

_EV = PR + """, ev as (select p.tie as event_id, p.symbol, p.ts as t0, q.ts as t1 from (select * from p) p asof join p q on q.symbol = p.symbol and q.ts >= p.ts + interval 7200 seconds)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar as an event that ends with the first bar two hours later."""
    p = _p(spark, sf)
    return L.vertical_barriers(p.select(F.col("tie").alias("event_id"), "symbol", F.col("ts").alias("t0")), p, 7_200)


@query("event_id symbol t0 t1", sql="select event_id, symbol, t0, t1 from ev", ctes=_EV)
def lab_vertical_barrier(spark, sf):  # noqa: ANN001, ANN201
    return _events(spark, sf)


_EP = _EV + ", ep as (select ev.*, a.price as p0, b.price as p1, ln(b.price / a.price) as ret from ev join p a on a.symbol = ev.symbol and a.ts = ev.t0 join p b on b.symbol = ev.symbol and b.ts = ev.t1)"


@query("event_id", "ret", "select event_id, ret, case when ret > 0.001 then 1 when ret < -0.001 then -1 else 0 end as bin from ep", _EP, longs="bin")
def lab_return_sign(spark, sf):  # noqa: ANN001, ANN201
    return L.return_sign(_events(spark, sf), _p(spark, sf), 0.001)


@query("event_id", "ret", """select event_id, z as ret, case when z > 0.5 then 1 when z < -0.5 then -1 else 0 end as bin from (select event_id, (ret - m) / nullif(s, 0) as z from ep join
       (select symbol, ts, case when count(r) over f = 20 then avg(r) over f end as m, case when count(r) over f = 20 then stddev_samp(r) over f end as s from (select symbol, ts, tie, ln(lead(price) over (partition by symbol order by ts, tie) / price) as r from p)
        window f as (partition by symbol order by ts, tie rows between 19 preceding and current row)) v on v.symbol = ep.symbol and v.ts = ep.t0) where z is not null""", _EP, longs="bin")  # fmt: skip
def lab_return_sign_standardised(spark, sf):  # noqa: ANN001, ANN201
    return L.return_sign(_events(spark, sf), _p(spark, sf), 0.5, window=20)


@query("event_id", "scale", "select event_id, case when sign(ret) = 1 then abs(ret) else 0 end as scale from ep", _EP)
def lab_scale(spark, sf):  # noqa: ANN001, ANN201
    return L.scale(_events(spark, sf), _p(spark, sf), F.lit(1.0))


@query("event_id symbol sl_ts pt_ts t1", sql="""select event_id, symbol, sl_ts, pt_ts, least(sl_ts, t1, pt_ts) as t1, case when sl_ts = least(sl_ts, t1, pt_ts) then -1 when t1 = least(sl_ts, t1, pt_ts) then 0 else 1 end as bin from
       (select ep.event_id, ep.symbol, ep.t1, min(b.ts) filter (where b.price / ep.p0 - 1 < -0.004) as sl_ts, min(b.ts) filter (where b.price / ep.p0 - 1 > 0.004) as pt_ts
        from ep join p b on b.symbol = ep.symbol and b.ts between ep.t0 and ep.t1 group by all)""", ctes=_EP, longs="bin")  # fmt: skip
def lab_triple_barrier(spark, sf):  # noqa: ANN001, ANN201
    return L.triple_barrier(_events(spark, sf), _p(spark, sf), -0.004, 0.004)


def _over(fn: str) -> str:
    return f"select ts, asset, r - {fn}(r) over (partition by ts) as excess from (select ts, asset, lead(price) over (partition by asset order by ts) / price - 1 as r from panel) where r is not null"


@query("ts asset", "excess", _over("avg"), PA)
def lab_over_mean(spark, sf):  # noqa: ANN001, ANN201
    return L.over_cross_section(V.panel(spark, sf))


@query("ts asset", "excess", _over("median"), PA)
def lab_over_median(spark, sf):  # noqa: ANN001, ANN201
    return L.over_cross_section(V.panel(spark, sf), median=True)


@query("ts asset", sql="""select ts, asset, case when (k - 1) * 3 <= n - 1 then -1 when (k - 1) * 3 > (n - 1) * 2 then 1 else 0 end as tail from
       (select *, row_number() over (partition by ts order by r, asset) as k, count(*) over (partition by ts) as n from
        (select ts, asset, ln(price) - ln(lag(price) over (partition by asset order by ts)) as r from panel) where r is not null) where n = (select count(distinct asset) from panel)""", ctes=PA, longs="tail")  # fmt: skip
def lab_tail_set(spark, sf):  # noqa: ANN001, ANN201
    return L.tail_sets(V.panel(spark, sf), 3)


_TAIL = PA + """, r0 as (select ts, asset, ln(price) - ln(lag(price) over (partition by asset order by ts)) as r from panel),
  r1 as (select * from (select *, count(*) over (partition by ts) as n from r0 where r is not null) where n = (select count(distinct asset) from panel)), k1 as (select *, row_number() over (partition by asset order by ts) as k from r1),
  v as (select ts, asset, r, case when count(*) over f = 5 then stddev_samp(r) over f end as stdev from r1 window f as (partition by asset order by ts rows between 4 preceding and current row)),
  m as (select a.ts, a.asset, any_value(a.r) as r, case when any_value(a.k) >= 5 then sum(abs(b.r) * pow(2 / 3.0, a.k - b.k)) / sum(pow(2 / 3.0, a.k - b.k)) end as mad from k1 a join k1 b on b.asset = a.asset and b.k <= a.k group by a.ts, a.asset)"""


def _tail_sql(src: str, vol: str) -> str:
    return f"""select ts, asset, case when (k - 1) * 3 <= n - 1 then -1 when (k - 1) * 3 > (n - 1) * 2 then 1 else 0 end as tail from
       (select *, row_number() over (partition by ts order by x, asset) as k from (select *, r / {vol} as x, count(r / {vol}) over (partition by ts) as n from {src}) where x is not null) where n = (select count(distinct asset) from panel)"""


@query("ts asset", sql=_tail_sql("v", "stdev"), ctes=_TAIL, longs="tail")
def lab_tail_set_stdev(spark, sf):  # noqa: ANN001, ANN201
    return L.tail_sets(V.panel(spark, sf), 3, "stdev", 5)


@query("ts asset", sql=_tail_sql("m", "mad"), ctes=_TAIL, longs="tail")
def lab_tail_set_mean_abs_dev(spark, sf):  # noqa: ANN001, ANN201
    return L.tail_sets(V.panel(spark, sf), 3, "mean_abs_dev", 5)


_TS = " union all ".join(f"""select symbol, ts, price, {n} as len, regr_sxy(price, rn) over f{n} as sxy, regr_sxx(price, rn) over f{n} as sxx, regr_syy(price, rn) over f{n} as syy,
  last_value(ts) over f{n} as t1, last_value(price) over f{n} as p1, count(*) over (partition by symbol order by rn rows between current row and 19 following) as have from n
  window f{n} as (partition by symbol order by rn rows between current row and {n - 1} following)""" for n in (5, 10, 15))  # fmt: skip


@query("symbol ts t1", "t_value ret bin", f"""select symbol, ts, t1, t as t_value, p1 / price - 1 as ret, sign(t) as bin from (select *, row_number() over (partition by symbol, ts order by round(abs(t), 9) desc, len) as k from
       (select *, (sxy / sxx) / sqrt(nullif(greatest(syy - sxy * sxy / sxx, 0), 0) / (len - 2) / sxx) as t from ({_TS}) where have = 20) where t is not null) where k = 1""", _N, digits=5)  # fmt: skip
def lab_trend_scan(spark, sf):  # noqa: ANN001, ANN201
    return L.trend_scan(V.ticks(spark, sf), 20, 5, 5)


@query("label", "share", "select bin as label, count(*) as n, count(*) / sum(count(*)) over () as share from (select case when ret > 0.001 then 1 when ret < -0.001 then -1 else 0 end as bin from ep) group by bin", _EP, longs="n")
def label_distribution(spark, sf):  # noqa: ANN001, ANN201
    d = L.return_sign(_events(spark, sf), _p(spark, sf), 0.001).groupBy(F.col("bin").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


_CONC = PR + ", " + IV + """, c as (select b.symbol, b.ts, count(i.event_id) as n from (select distinct p.symbol, p.ts from p join (select symbol, min(t0) as a, max(t1) as z from i group by symbol) s on s.symbol = p.symbol and p.ts between a and z) b
  left join i on i.symbol = b.symbol and b.ts between i.t0 and i.t1 group by all)"""


@query("symbol ts", sql="select symbol, ts, n from c", ctes=_CONC, longs="n")
def sw_concurrency(spark, sf):  # noqa: ANN001, ANN201
    return L.concurrency(V.intervals(spark, sf), _p(spark, sf))


@query("event_id symbol", "weight", "select event_id, symbol, u / sum(u) over (partition by symbol) as weight from (select i.event_id, i.symbol, avg(1.0 / n) as u from i join c on c.symbol = i.symbol and c.ts between i.t0 and i.t1 group by all)", _CONC)
def sw_avg_uniqueness(spark, sf):  # noqa: ANN001, ANN201
    return L.average_uniqueness(V.intervals(spark, sf), _p(spark, sf))


@query("event_id", sql="select i.event_id, count(*) as n from i join p on p.symbol = i.symbol and p.ts between i.t0 and i.t1 group by i.event_id", ctes=PR + ", " + IV, longs="n")
def join_interval_events(spark, sf):  # noqa: ANN001, ANN201
    return L.events_with_bars(V.intervals(spark, sf), _p(spark, sf)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("event_id", "p0 p1", "select event_id, p0, p1 from ep", _EP)
def join_equi_lookup(spark, sf):  # noqa: ANN001, ANN201
    return L.event_prices(_events(spark, sf), _p(spark, sf))


# ------------------------------------------------------------------------------------ entropy and codependence


@query("item_id", "entropy", "select item_id, -sum(p * log2(p)) as entropy from (select item_id, count(*) / sum(count(*)) over (partition by item_id) as p from (select item_id, unnest(string_split(text, '')) as c from eval_items) where c <> '' group by item_id, c) group by item_id")
def ent_shannon(spark, sf):  # noqa: ANN001, ANN201
    return D.shannon(table(spark, sf, "eval_items"), "item_id", "text")


@query("item_id", "entropy", "select item_id, -sum(p * log2(p)) as entropy from (select item_id, count(*) / any_value(len) as p from (select item_id, length(text) as len, substr(text, k::int, 3) as c from (select item_id, text, unnest(range(1, length(text) - 1)) as k from eval_items)) group by item_id, c) group by item_id")
def ent_word_shannon(spark, sf):  # noqa: ANN001, ANN201
    return D.word_shannon(table(spark, sf, "eval_items"), "item_id", "text", 3)


@query("doc_id", "entropy")
def ent_lempel_ziv(spark, sf):  # noqa: ANN001, ANN201
    return D.lempel_ziv(table(spark, sf, "documents"), "doc_id", "text")


def _xy(spark: SparkSession, sf: str) -> DataFrame:
    """Line items per return flag: x quantity, y price in thousands."""
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


_XY = "xy as (select l_returnflag as g, l_quantity::double as x, l_extendedprice / 1000 as y from lineitem)"


@query("g", "angular abs_angular sq_angular euclidean manhattan chebyshev cosine", """select g, sqrt((1 - r) / 2) as angular, sqrt((1 - abs(r)) / 2) as abs_angular, sqrt((1 - r * r) / 2) as sq_angular, l1 as manhattan, sqrt(l2) as euclidean, li as chebyshev, 1 - xy / (sqrt(xx) * sqrt(yy)) as cosine
       from (select g, corr(x, y) as r, sum(abs(x - y)) as l1, sum((x - y) * (x - y)) as l2, max(abs(x - y)) as li, sum(x * y) as xy, sum(x * x) as xx, sum(y * y) as yy from xy group by g)""", _XY, digits=5)  # fmt: skip
def dist_metrics(spark, sf):  # noqa: ANN001, ANN201
    return D.distances(_xy(spark, sf), ["g"])


@query("g", "spearman", """select g, (1 - corr(rx, ry)) / 2 as spearman from (select g, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2.0 as rx,
       rank() over (partition by g order by y) + (count(*) over (partition by g, y) - 1) / 2.0 as ry from xy) group by g""", _XY)  # fmt: skip
def codep_spearman(spark, sf):  # noqa: ANN001, ANN201
    return D.spearman(_xy(spark, sf), ["g"])


@query("g", "z_pearson", """select g, (1 - corr(zx, zy)) / 2 as z_pearson from (select g, (x - avg(x) over h) / stddev_pop(x) over h as zx, (y - avg(y) over h) / stddev_pop(y) over h as zy from xy window h as (partition by g)) group by g""", _XY)
def codep_z_pearson(spark, sf):  # noqa: ANN001, ANN201
    d = C.zscore(C.zscore(_xy(spark, sf), "x", "zx", ("g",)), "y", "zy", ("g",))
    return d.groupBy("g").agg(((1 - F.corr("zx", "zy")) / 2).alias("z_pearson"))


_HIST = """h as (select l_quantity::int as q, count(*) filter (where l_returnflag = 'R') / (select count(*) from lineitem where l_returnflag = 'R') as x,
  count(*) filter (where l_returnflag = 'N') / (select count(*) from lineitem where l_returnflag = 'N') as y from lineitem group by q)"""


@query("", "kl js", "select sum(x * ln(x / y)) as kl, (sum(x * ln(x / y)) + sum(y * ln(y / x))) / 2 as js from h where x > 0 and y > 0", _HIST)
def codep_kl_js(spark, sf):  # noqa: ANN001, ANN201
    li = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "N").alias("n"))
    total = W.partitionBy()
    return D.kl_js(li.select(F.lit(1).alias("k"), (F.col("r") / F.sum("r").over(total)).alias("x"), (F.col("n") / F.sum("n").over(total)).alias("y")), ["k"])


_MI = _XY + """, e as (select g, least(floor((x - min(x) over h) / (max(x) over h - min(x) over h) * 10), 9)::int as i, least(floor((y - min(y) over h) / (max(y) over h - min(y) over h) * 10), 9)::int as j from xy window h as (partition by g)),
  c as (select g, i, j, count(*) / sum(count(*)) over (partition by g) as p from e group by g, i, j), m as (select *, sum(p) over (partition by g, i) as px, sum(p) over (partition by g, j) as py from c),
  s as (select g, sum(p * ln(p / (px * py))) as mi from m group by g), hx as (select g, -sum(q * ln(q)) as hx from (select g, i, sum(p) as q from c group by all) group by g), hy as (select g, -sum(q * ln(q)) as hy from (select g, j, sum(p) as q from c group by all) group by g)"""


@query("g", "mutual variation", "select g, 1 - mi / least(hx, hy) as mutual, (hx + hy - 2 * mi) / (hx + hy - mi) as variation from s join hx using (g) join hy using (g)", _MI)
def codep_information(spark, sf):  # noqa: ANN001, ANN201
    return D.information(_xy(spark, sf), ["g"], 10)


@query("g", "js", """select g, (sum(x * ln(x / y)) + sum(y * ln(y / x))) / 2 as js from (select g, k, sum(case when s = 0 then 1 else 0 end) / any_value(n) / 5.0 as x, sum(case when s = 1 then 1 else 0 end) / any_value(n) / 5.0 as y from
       (select g, s, n, floor((v - lo) / 5.0) as k from (select g, n, lo, unnest([0, 1]) as s, unnest([x, y]) as v from (select *, count(*) over (partition by g) as n, least(min(x) over (partition by g), min(y) over (partition by g)) as lo from xy))) group by g, k) where x > 0 and y > 0 group by g""", _XY)  # fmt: skip
def codep_histogram(spark, sf):  # noqa: ANN001, ANN201
    return D.histogram_distance(_xy(spark, sf), ["g"], 5.0)


@query("g", sql="select g, case when k > 0 then k end as bins from (select g, trunc((log2(count(*)) + 1) * (1 - 2 * abs(corr(x, y))))::bigint as k from (select l_returnflag as g, l_quantity::double as x, l_tax as y from lineitem) group by g)", longs="bins")
def codep_optimal_bins(spark, sf):  # noqa: ANN001, ANN201
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("x"), F.col("l_tax").alias("y"))
    g = li.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    return g.select("g", D.optimal_bins(F.col("n"), F.col("r")).alias("bins"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = "pr as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem" for k, a in enumerate(_COLS) for b in _COLS[k + 1 :]) + ")"


@query("a b", "distance", f"select a, b, sqrt((1 - r) / 2) as distance from pr union all select b, a, sqrt((1 - r) / 2) from pr union all select c, c, 0.0 from (values {', '.join(f'({c!r})' for c in _COLS)}) v(c)", _PAIRS)
def codep_matrix(spark, sf):  # noqa: ANN001, ANN201
    return D.matrix(X.correlation_pairs(D.column_pairs(table(spark, sf, "lineitem"), _COLS)), "distance", _COLS)


@query("a b", "mixed", "select a, b, 0.7 * sqrt((1 - r) / 2) + 0.3 * sqrt((1 - abs(r)) / 2) as mixed from pr", _PAIRS)
def codep_mixed(spark, sf):  # noqa: ANN001, ANN201
    c = X.correlation_pairs(D.column_pairs(table(spark, sf, "lineitem"), _COLS))
    return c.withColumn("mixed", D.mixed(F.col("distance"), F.sqrt((1 - F.abs("corr")) / 2), 0.3))


@query("", "distance", """select 1 - sqrt(ab) / sqrt(sqrt(aa) * sqrt(bb)) as distance from (select avg(a * b) as ab, avg(a * a) as aa, avg(b * b) as bb from
       (select a - avg(a) over (partition by i) - avg(a) over (partition by j) + avg(a) over () as a, b - avg(b) over (partition by i) - avg(b) over (partition by j) + avg(b) over () as b from
        (select u.ts as i, v.ts as j, abs(u.x - v.x) as a, abs(u.y - v.y) as b from w u, w v where u.x is not null and u.y is not null and v.x is not null and v.y is not null)))""",
       PA + ", nm as (select min(asset) as n1, max(asset) as n2 from panel), w as (select ts, any_value(price) filter (where asset = n1) as x, any_value(price) filter (where asset = n2) as y from panel, nm group by ts)")
def codep_distance_corr(spark, sf):  # noqa: ANN001, ANN201
    p = V.panel(spark, sf)
    n = p.agg(F.min("asset"), F.max("asset")).first()
    return D.distance_correlation(X.wide(p, "ts", "asset", "price", [n[0], n[1]]).select("ts", F.col(n[0]).alias("x"), F.col(n[1]).alias("y")), "ts")


# ------------------------------------------------------------------------------------ breaks and regression


@query("g", "intercept slope se_intercept se_slope", """select g, regr_intercept(y, x) as intercept, regr_slope(y, x) as slope, sqrt(s2 * (1.0 / n + mx * mx / sxx)) as se_intercept, sqrt(s2 / sxx) as se_slope from
       (select g, x, y, n, mx, sxx, (syy - sxy * sxy / sxx) / (n - 2) as s2 from xy join (select g, count(*) as n, avg(x) as mx, regr_sxx(y, x) as sxx, regr_sxy(y, x) as sxy, regr_syy(y, x) as syy from xy group by g) using (g)) group by g, n, mx, sxx, s2""", _XY)  # fmt: skip
def ols_beta(spark, sf):  # noqa: ANN001, ANN201
    return K.ols(_xy(spark, sf), ["g"], "y", "x")


@query("g", "ss", "select g, sum((y - i - s * x) * (y - i - s * x)) as ss from xy join (select g, regr_slope(y, x) as s, regr_intercept(y, x) as i from xy group by g) using (g) group by g", _XY, digits=4)
def feat_residuals(spark, sf):  # noqa: ANN001, ANN201
    return K.residuals(_xy(spark, sf), ["g"], "y", "x").groupBy("g").agg(F.sum(F.col("residual") * F.col("residual")).alias("ss"))


def _p_sql(inner: str) -> str:
    """``inner`` (with f and n) and P(F > f) for 1 and n - 2: as a two-sided t, its angle integrated by Simpson's rule in 2000 steps."""
    return f"""select q.*, p.p_value from (select *, row_number() over () as row_no from ({inner})) q join (
      select row_no, 1 - 2 / sqrt(pi()) * exp(lgamma((any_value(v) + 1) / 2) - lgamma(any_value(v) / 2)) * any_value(top) / 6000
             * sum(case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end * pow(cos(top * k / 2000), v - 1)) as p_value
      from (select row_no, (n - 2)::double as v, atan(sqrt(greatest(f, 0) / (n - 2))) as top from (select *, row_number() over () as row_no from ({inner}))), range(2001) r(k) group by row_no) p using (row_no)"""


@query("symbol", "f p_value", _p_sql("""select symbol, ((c - s) / 1) / (s / (n - 2)) as f, n from (select symbol, sum((price - m) * (price - m)) as c, sum((price - pm) * (price - pm)) as s, count(*) as n from
       (select *, avg(price) over (partition by symbol) as m, avg(price) over (partition by symbol, day(ts) > 15) as pm from t) group by symbol) order by symbol"""), T)  # fmt: skip
def sb_chow(spark, sf):  # noqa: ANN001, ANN201
    t = V.ticks(spark, sf).withColumn("part", (F.dayofmonth("ts") > 15).cast("int"))
    m = t.groupBy("symbol").agg(F.avg("price").alias("m"), F.avg(F.when(F.col("part") == 0, F.col("price"))).alias("m0"), F.avg(F.when(F.col("part") == 1, F.col("price"))).alias("m1"))
    return K.chow(t.join(m, "symbol"), "m", "m0", "m1", "price", "part", 1, ["symbol"])


@query("symbol break_at", "f p_value", _p_sql("""select symbol, n1::bigint as break_at, f, n from (select *, row_number() over (partition by symbol order by f desc, n1) as k from (select symbol, n, n1, ((qt - st * st / n) - (q - s * s / n1) - (qt - q - (st - s) * (st - s) / (n - n1))) /
       (((q - s * s / n1) + (qt - q - (st - s) * (st - s) / (n - n1))) / (n - 2)) as f from
       (select symbol, row_number() over w as n1, sum(price) over w as s, sum(price * price) over w as q, sum(price) over (partition by symbol) as st, sum(price * price) over (partition by symbol) as qt, count(*) over (partition by symbol) as n from t
        window w as (partition by symbol order by ts, tie rows unbounded preceding)) where n1 >= floor(n * 0.15) and n1 < n - floor(n * 0.15) and n1 >= 15 and n - n1 >= 15)) where k = 1 order by symbol"""), T)  # fmt: skip
def sb_quandt_andrews(spark, sf):  # noqa: ANN001, ANN201
    return K.mean_break(V.ticks(spark, sf), "price")


@query("symbol ts tie is_break", "z", "select *, coalesce(z > 3, false) as is_break from (select symbol, ts, tie, (price - avg(price) over f) / nullif(stddev_samp(price) over f, 0) as z from t window f as (partition by symbol order by ts, tie rows between 29 preceding and current row))", T)
def sb_zscore(spark, sf):  # noqa: ANN001, ANN201
    return I.rolling_zscore(V.ticks(spark, sf), "price")


@query("symbol ts tie", "signal", f"select symbol, ts, tie, case when count(price) over {_f(30)} = 30 then avg(price) over {_f(30)} end - case when count(price) over {_f(5)} = 5 then avg(price) over {_f(5)} end as signal from t", T)
def sb_long_short(spark, sf):  # noqa: ANN001, ANN201
    return K.long_short(V.ticks(spark, sf), "price")


@query("symbol ts tie", "gain", """select symbol, ts, tie, case when count(price) over a = 20 and count(price) over b = 20 then (avg(price) over a - avg(price) over b) * (avg(price) over a - avg(price) over b) * 10 end as gain
       from t window a as (partition by symbol order by ts, tie rows between 20 preceding and 1 preceding), b as (partition by symbol order by ts, tie rows between current row and 19 following)""", T, digits=2)  # fmt: skip
def sb_window_slide(spark, sf):  # noqa: ANN001, ANN201
    return K.window_discrepancy(V.ticks(spark, sf), "price", 20)


@query("symbol ts tie pos_break neg_break", "s_pos s_neg", "select symbol, ts, tie, up > 3 as pos_break, down < -3 as neg_break, case when up > 3 then 0 else up end as s_pos, case when down < -3 then 0 else down end as s_neg from r join c using (symbol, rn)",
       _N.replace("t as (", "recursive t as (", 1) + """, e as (select *, price - avg(price) over f as eps from n window f as (partition by symbol order by rn rows between 29 preceding and current row)),
       c as (select *, stddev_samp(eps) over (partition by symbol order by rn rows between 29 preceding and current row) as sd from e),
       r as (select symbol, rn, 0.0::double as up, 0.0::double as down from c where rn = 0 union all
             select c.symbol, c.rn, case when c.rn < 30 or coalesce(sd, 0) = 0 then 0.0 else greatest(0, case when r.up > 3 then 0 else r.up end + eps) / sd end,
                    case when c.rn < 30 or coalesce(sd, 0) = 0 then 0.0 else least(0, case when r.down < -3 then 0 else r.down end + eps) / sd end from r join c on c.symbol = r.symbol and c.rn = r.rn + 1)""")  # fmt: skip
def sb_cusum(spark, sf):  # noqa: ANN001, ANN201
    return K.cusum(V.ticks(spark, sf), "price")


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sums of prices shipped, as one series."""
    li = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_extendedprice").alias("value"))
    return li.select(F.lit("all").alias("symbol"), F.col("d").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("tie"), (F.col("value") / 1000).alias("value"))


def _segments(name: str, **kw: object) -> None:
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        return K.segment(_daily(spark, sf), "value", **kw)

    fn.__name__ = name
    query("symbol break_at")(fn)


_segments("sb_ruptures_pelt", method="pelt")
_segments("sb_ruptures_dynamic", method="dynamic", breaks=3)
_segments("sb_ruptures_binary", method="binary", breaks=3)
_segments("sb_ruptures_bottom_up", method="bottom_up", breaks=3)


@query("symbol break_at")
def sb_ruptures_kernel(spark, sf):  # noqa: ANN001, ANN201
    p = V.panel(spark, sf).select(F.col("asset").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("tie"), "price")
    return K.segment(p, "price", method="kernel", breaks=1, least=3)


@query("symbol d", "statistic p_value critical corr", longs="n")
def feat_min_ffd(spark, sf):  # noqa: ANN001, ANN201
    return K.min_ffd(V.ticks(spark, sf), "price")


# ------------------------------------------------------------------------------------ cross-section and learning


@query("", "mean_volume mean_abs_rate", "select hour(ts) as hour, avg(volume) as mean_volume, avg(abs(rate)) as mean_abs_rate from n group by hour(ts)", _RATE, longs="hour")
def agg_by_hour(spark, sf):  # noqa: ANN001, ANN201
    return X.by_clock(_rates(spark, sf), "hour")


@query("", "mean_volume mean_abs_rate", "select isodow(ts) - 1 as weekday, avg(volume) as mean_volume, avg(abs(rate)) as mean_abs_rate from n group by isodow(ts)", _RATE, longs="weekday")
def agg_by_weekday(spark, sf):  # noqa: ANN001, ANN201
    return X.by_clock(_rates(spark, sf), "weekday")


@query("ts symbol", sql="select ts, symbol, dense_rank() over (partition by ts order by price) as rank from p", ctes=PR, longs="rank")
def rank_dense_xs(spark, sf):  # noqa: ANN001, ANN201
    return X.dense_ranks(_p(spark, sf), "price")


_RK = PA + """, rr as (select ts, asset, price / lag(price) over (partition by asset order by ts) - 1 as rate from panel),
  pf as (select ts, asset, case when count(rate) over a = 3 then sum(rate) over a end as pre, case when count(rate) over b = 3 then sum(rate) over b end as fut from rr
         window a as (partition by asset order by ts rows between 2 preceding and current row), b as (partition by asset order by ts rows between 1 following and 3 following)),
  rk as (select dense_rank() over (partition by ts order by pre) as a, dense_rank() over (partition by ts order by fut) as b from pf where pre is not null and fut is not null),
  cells as (select x.a, y.b, coalesce(c, 0) / sum(coalesce(c, 0)) over (partition by x.a) as share from (select distinct a from rk) x cross join (select distinct b from rk) y left join (select a, b, count(*) as c from rk group by all) k on k.a = x.a and k.b = y.b)"""


@query("", "share", "select a, b, least(share, (select quantile_cont(share, 0.99) from cells)) as share from cells", _RK, longs="a b")
def pivot_rank_heatmap(spark, sf):  # noqa: ANN001, ANN201
    p = V.panel(spark, sf).select(F.col("asset").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("tie"), "price")
    return X.rank_heatmap(X.rank_pairs(C.changes(p).withColumn("rate", F.col("pct")), 3, 3), "a", "b")


_QB = _RATE + """, h as (select *, hour(ts) as hr from n where rate is not null), e as (select symbol, hr, quantile_cont(rate, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from h group by all),
  bn as (select h.symbol, hr, ts, tie, len(list_filter(q, lambda v: v < rate)) as bin from h join e using (symbol, hr))"""


@query("symbol ts tie", sql="select symbol, ts, tie, bin from bn", ctes=_QB, longs="bin")
def bin_quantile(spark, sf):  # noqa: ANN001, ANN201
    d = _rates(spark, sf).filter("rate is not null").withColumn("hour", F.hour("ts"))
    return X.quantile_bins(d, "rate", ["symbol", "hour"], 10)


@query("", "share", "select a, b, count(*) / sum(count(*)) over (partition by a) as share from (select bin as a, lead(bin) over (partition by symbol, hr order by ts, tie) as b from bn) where b is not null group by a, b", _QB, longs="a b")
def hour_over_hour(spark, sf):  # noqa: ANN001, ANN201
    return X.hour_over_hour(_rates(spark, sf), "rate")


@query("ts", "click purchase view", "select ts, any_value(ln(price)) filter (where asset = 'click') as click, any_value(ln(price)) filter (where asset = 'purchase') as purchase, any_value(ln(price)) filter (where asset = 'view') as view from panel group by ts", PA)
def objects_matrix(spark, sf):  # noqa: ANN001, ANN201
    p = V.panel(spark, sf).withColumn("l", F.ln("price"))
    return X.wide(p, "ts", "asset", "l", ["click", "purchase", "view"])


@query("symbol ts tie", "scaled", "select symbol, ts, tie, (price - quantile_cont(price, 0.5) over h) / nullif(quantile_cont(price, 0.75) over h - quantile_cont(price, 0.25) over h, 0) as scaled from t window h as (partition by symbol)", T)
def ml_robust_scale(spark, sf):  # noqa: ANN001, ANN201
    return X.robust_scale(V.ticks(spark, sf), "price", ["symbol"])


_GUESS = "gs as (select l_returnflag as truth, case when l_quantity > 30 then 'N' when l_tax > 0.04 then 'R' else 'A' end as guess from lineitem)"


@query("label", "precision recall", """select label, count(*) filter (where truth = label and guess = label) / nullif(count(*) filter (where guess = label), 0) as precision,
       count(*) filter (where truth = label and guess = label) / nullif(count(*) filter (where truth = label), 0) as recall, count(*) filter (where truth = label) as support
       from gs, (select distinct truth as label from gs union select distinct guess from gs) group by label""", _GUESS, longs="support")  # fmt: skip
def ml_precision_recall(spark, sf):  # noqa: ANN001, ANN201
    g = F.when(F.col("l_quantity") > 30, "N").when(F.col("l_tax") > 0.04, "R").otherwise("A")
    return X.precision_recall(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("truth"), g.alias("guess")), "truth", "guess")


@query("label", "precision recall", longs="support")
def ml_logistic(spark, sf):  # noqa: ANN001, ANN201
    d = I.slopes(I.lag_returns(_rates(spark, sf), (1, 5)).drop("rn"), (5,))
    d = I.discounted_future(d.drop("rn"), spans=(1,)).filter("rd_1 is not null").withColumn("y", F.signum("rd_1").cast("int"))
    return X.precision_recall(X.logistic(d, ["ret_1", "ret_5", "slope_5"], "y").withColumnRenamed("label", "truth"), "truth", "guess")


@query("a b", "corr distance", "select a, b, r as corr, sqrt((1 - r) / 2) as distance from pr", _PAIRS)
def cl_corr_distance(spark, sf):  # noqa: ANN001, ANN201
    return X.correlation_pairs(D.column_pairs(table(spark, sf, "lineitem"), _COLS))


@query("p_partkey cluster", "silhouette", digits=5)
def cl_silhouette(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("p_partkey"), F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").cast("double").alias("b"), "n_regionkey")
    return X.silhouettes(p, "p_partkey", ["a", "b"], "n_regionkey").withColumnRenamed("n_regionkey", "cluster")


ORACLES["cl_silhouette"] = """with d as (select u.n_nationkey as i, u.n_regionkey as c, v.n_regionkey as e, avg(sqrt(power(u.n_nationkey - v.n_nationkey, 2) + power(u.n_regionkey - v.n_regionkey, 2))) as m
  from nation u, nation v where u.n_nationkey <> v.n_nationkey group by all), g as (select i, c, min(m) filter (where c = e) as a, min(m) filter (where c <> e) as b from d group by all)
  select i as p_partkey, c as cluster, round(case when a is null then 0.0 else (b - a) / nullif(greatest(a, b), 0) end + 1e-11, 5) as silhouette from g"""


@query("cluster", "quality", longs="size", digits=5)
def cl_cluster_quality(spark, sf):  # noqa: ANN001, ANN201
    return X.cluster_quality(QUERIES["cl_silhouette"](spark, sf), "cluster")


ORACLES["cl_cluster_quality"] = f"select cluster, round(avg(silhouette) / nullif(stddev_pop(silhouette), 0) + 1e-11, 5) as quality, count(*)::bigint as size from ({ORACLES['cl_silhouette']}) q_ group by cluster"


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier nation a profile of its customers' balances: one row per nation."""
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("key")).agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"), F.count(F.lit(1)).cast("double").alias("n")).fillna(0.0)


@query("key cluster")
def cl_kmeans_base(spark, sf):  # noqa: ANN001, ANN201
    return X.kmeans(_profiles(spark, sf), "key", ["m", "s", "n"], max_k=4, repeats=1)


@query("key cluster")
def cl_onc(spark, sf):  # noqa: ANN001, ANN201
    return X.optimal_clusters(_profiles(spark, sf), "key", ["m", "s", "n"], max_k=3, repeats=1, depth=1)


# ------------------------------------------------------------------------------------ positions and performance


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    """Order events moved to the first bar at or after them, closes with negative volume."""
    e = table(spark, sf, "event_df").filter("symbol is not null and date_time is not null")
    d = L.asof_forward(e.select("symbol", "date_time", "event_id", "order_direction", "order_style", "volume", "price", "profit", "order_trade_cost"), _p(spark, sf), "date_time")
    v = F.abs(number("volume")) * F.when(F.col("order_style") == "close", -1).otherwise(1)
    return d.select("symbol", F.col("found_ts").alias("ts"), F.struct("date_time", "event_id").alias("tie"), F.col("order_direction").alias("side"), v.alias("volume"), number("price").alias("price"), number("profit").alias("profit"), F.coalesce(number("order_trade_cost"), F.lit(0.0)).alias("cost"))


_SIDES = ("long", "short")
# the average price event by event, as in the original: an opening moves it by its share of the new position
_FLOW = "recursive " + PR + """, fl as (select e.symbol, p.ts, e.order_direction as side, abs(e.volume) * case when e.order_style = 'close' then -1 else 1 end as v, case when isnan(e.price) then null else e.price end as px, e.profit as pr, coalesce(e.order_trade_cost, 0) as c, e.date_time, e.event_id
    from (select * from event_df where symbol is not null and date_time is not null) e asof join p on p.symbol = e.symbol and p.ts >= e.date_time),
  en as (select *, row_number() over w as k, sum(coalesce(v, 0)) over (w rows unbounded preceding) as pos from fl window w as (partition by symbol, side order by ts, date_time, event_id)),
  av as (select symbol, side, ts, k, case when abs(pos) > 1e-9 and v > 0 and px is not null then px * v / pos else 0.0 end as avg from en where k = 1
         union all select en.symbol, en.side, en.ts, en.k, case when abs(en.pos) <= 1e-9 then 0.0 when en.v > 0 and en.px is not null then (av.avg * (en.pos - en.v) + en.px * en.v) / en.pos else av.avg end
         from av join en on en.symbol = av.symbol and en.side = av.side and en.k = av.k + 1),
  la as (select symbol, ts, """ + ", ".join(f"arg_max(avg, k) filter (where side = '{s}') as {s}_avg" for s in _SIDES) + """ from av group by symbol, ts),
  sd as (select symbol, ts, """ + ", ".join(f"sum(case when side = '{s}' then v end) as {s}_v, sum(case when side = '{s}' and not isnan(pr) then pr end) as {s}_pr, sum(case when side = '{s}' then c end) as {s}_c" for s in _SIDES) + """ from fl group by symbol, ts),
  ru as (select p.symbol, p.ts, p.tie, p.price, """ + ", ".join(f"sum(coalesce({s}_{a}, 0)) over w as {s}_{b}" for s in _SIDES for a, b in (("v", "position"), ("pr", "fix_profit"), ("c", "cost"))) + ", " + ", ".join(f"last_value({s}_avg ignore nulls) over w as {s}_last" for s in _SIDES) + """
         from p left join sd on sd.symbol = p.symbol and sd.ts = p.ts left join la on la.symbol = p.symbol and la.ts = p.ts window w as (partition by p.symbol order by p.ts, p.tie rows unbounded preceding)),
  po as (select *, """ + ", ".join(f"case when abs({s}_position) > 1e-9 then {s}_last end as {s}_avg_price" for s in _SIDES) + """ from ru),
  pc as (select *, coalesce((price - long_avg_price) * long_position, 0) as long_float, coalesce((price - short_avg_price) * short_position * -1, 0) as short_float from po),
  pp as (select *, long_position - short_position as net_position, long_float + long_fix_profit - long_cost + short_float + short_fix_profit - short_cost as capital from pc)"""


@query("symbol ts tie", "long_position short_position long_avg_price short_avg_price long_float short_float capital net_position", "select * from pp", _FLOW, digits=4)
def perf_position(spark, sf):  # noqa: ANN001, ANN201
    return P.positions(_p(spark, sf), _flow(spark, sf))


_CAP = _FLOW + """, uc as (select *, round(capital, 4) as cap from pp), uw as (select *, max(cap) over (partition by symbol order by ts, tie rows unbounded preceding) as peak from uc),
  st as (select *, sum(turn) over (partition by symbol order by ts, tie rows unbounded preceding) as streak_id from (select *, coalesce((cap < peak) <> lag(cap < peak) over (partition by symbol order by ts, tie), true)::int as turn from uw))"""


def _capital(spark: SparkSession, sf: str) -> DataFrame:
    return P.positions(_p(spark, sf), _flow(spark, sf)).withColumn("cap", F.round("capital", 4)).select("symbol", "ts", "tie", "rn", "price", "cap", "net_position", "long_fix_profit")


@query("symbol start_ts end_ts", "minutes position_minutes", """select symbol, streak_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as rows, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 as minutes,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 * count(*) filter (where abs(net_position) > 1e-9) / count(*) as position_minutes from st where cap < peak group by symbol, streak_id""", _CAP, longs="streak_id rows")  # fmt: skip
def perf_underwater(spark, sf):  # noqa: ANN001, ANN201
    return P.underwater(_capital(spark, sf), "cap", "net_position")


@query("symbol start_ts end_ts", "minutes", """select symbol, streak_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as rows, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 as minutes from
       (select *, sum(turn) over (partition by symbol order by ts, tie rows unbounded preceding) as streak_id from (select *, abs(net_position) > 1e-9 as held, coalesce((abs(net_position) > 1e-9) <> lag(abs(net_position) > 1e-9) over (partition by symbol order by ts, tie), true)::int as turn from pp)) where held group by symbol, streak_id""", _FLOW, longs="streak_id rows")  # fmt: skip
def perf_pnl_position(spark, sf):  # noqa: ANN001, ANN201
    return P.holding_streaks(_capital(spark, sf), "net_position")


@query("symbol", "sharpe", "select symbol, avg(rate) / nullif(stddev_samp(rate), 0) * sqrt((epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10 / 252) as sharpe from n group by symbol", _RATE)
def perf_sharpe(spark, sf):  # noqa: ANN001, ANN201
    return P.sharpe(_rates(spark, sf), "rate")


@query("symbol", "pnl_ratio holding_ratio", "select symbol, avg(rate) filter (where rate > 0) / nullif(avg(rate) filter (where rate < 0), 0) as pnl_ratio, count(*) filter (where volume > 50) / count(*) as holding_ratio from n group by symbol", _RATE)
def perf_profit_points(spark, sf):  # noqa: ANN001, ANN201
    d = _rates(spark, sf).withColumn("held", F.when(F.col("volume") > 50, 1.0).otherwise(0.0))
    return P.profit_points(d, "rate", "held")


@query("symbol", "mean std min p25 p50 p75 max", "select symbol, count(rate) as count, avg(rate) as mean, stddev_samp(rate) as std, min(rate) as min, quantile_cont(rate, 0.25) as p25, quantile_cont(rate, 0.5) as p50, quantile_cont(rate, 0.75) as p75, max(rate) as max from n group by symbol", _RATE, longs="count")
def describe_stats(spark, sf):  # noqa: ANN001, ANN201
    return X.describe(_rates(spark, sf), "rate", ["symbol"])


@query("symbol ts tie", "total", f"select symbol, ts, tie, count(price) over f as n, sum(price) over f as total from t window f as (partition by symbol order by ts, tie rows between 12 preceding and 1 preceding)", T, longs="n")
def bt_scene(spark, sf):  # noqa: ANN001, ANN201
    d = P.scenes(V.ticks(spark, sf), 12)
    return d.withColumn("n", F.size("scene")).withColumn("total", F.when(F.size("scene") > 0, F.aggregate("scene", F.lit(0.0), lambda a, x: a + x)))


@query("order_id sl_ts tp_ts", sql="""select o.order_id, min(p.ts) filter (where case when o.order_direction = 'long' then p.price < o.stop_loss_price else p.price > o.stop_loss_price end) as sl_ts,
       min(p.ts) filter (where case when o.order_direction = 'long' then p.price > o.take_profit_price else p.price < o.take_profit_price end) as tp_ts
       from (select * from info_df where symbol is not null and date_time is not null and close_date_time >= date_time) o join p on p.symbol = o.symbol and p.ts between o.date_time and o.close_date_time group by o.order_id""", ctes=PR)  # fmt: skip
def bt_order_triggers(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "info_df").filter("symbol is not null and date_time is not null and close_date_time >= date_time")
    o = o.select("order_id", "symbol", F.col("date_time").alias("t0"), F.col("close_date_time").alias("t1"), "order_direction", "stop_loss_price", "take_profit_price")
    d = L.events_with_bars(o, _p(spark, sf).select("symbol", "ts", "price"))
    long = F.col("order_direction") == "long"
    sl = F.when(long, F.col("price") < F.col("stop_loss_price")).otherwise(F.col("price") > F.col("stop_loss_price"))
    tp = F.when(long, F.col("price") > F.col("take_profit_price")).otherwise(F.col("price") < F.col("take_profit_price"))
    return d.groupBy("order_id").agg(F.min(F.when(sl, F.col("ts"))).alias("sl_ts"), F.min(F.when(tp, F.col("ts"))).alias("tp_ts"))


@query("order_id ts style", "volume", """select order_id, date_time as ts, 'open' as style, volume from info_df where date_time is not null union all
       select order_id, close_date_time, 'close', -volume from info_df where close_date_time is not null""")  # fmt: skip
def bt_export(spark, sf):  # noqa: ANN001, ANN201
    i = table(spark, sf, "info_df")
    legs = F.array(F.struct(F.col("date_time").alias("ts"), F.lit("open").alias("style"), F.col("volume").alias("volume")), F.struct(F.col("close_date_time").alias("ts"), F.lit("close").alias("style"), (-F.col("volume")).alias("volume")))
    return i.select("order_id", F.explode(legs).alias("e")).select("order_id", "e.*").filter("ts is not null")


_ACCOUNT = """recursive o as (select symbol, order_id, order_direction as side, case when isnan(price) then null else price end as px, coalesce(volume, 0) as vol, coalesce(deposit, 0) as dep, coalesce(slippage_cost, 0) + coalesce(context_cost, 0) as cost, coalesce(profit, 0) as pr, date_time as t0, close_date_time as t1 from info_df where symbol is not null),
  ev as (select symbol, order_id, side, px, vol as v, -dep - cost as cash, dep as asset, t0 as ts, 'open' as kind, 1 as o from o where t0 is not null union all select symbol, order_id, side, px, -vol, dep + pr, -dep, t1, 'close', 0 from o where t1 is not null),
  en as (select *, row_number() over w as k, sum(v) over (w rows unbounded preceding) as pos from ev window w as (partition by symbol, side order by ts, o, order_id)),
  av as (select symbol, side, order_id, kind, k, case when abs(pos) > 1e-9 and v > 0 and px is not null then px * v / pos else 0.0 end as avg from en where k = 1
         union all select en.symbol, en.side, en.order_id, en.kind, en.k, case when abs(en.pos) <= 1e-9 then 0.0 when en.v > 0 and en.px is not null then (av.avg * (en.pos - en.v) + en.px * en.v) / en.pos else av.avg end
         from av join en on en.symbol = av.symbol and en.side = av.side and en.k = av.k + 1),
  ac as (select en.symbol, en.ts, en.order_id, en.kind, en.side, 1e6 + sum(cash) over w as cash, """ + ", ".join(f"sum(case when en.side = '{s}' then asset else 0 end) over w as {s}_asset, sum(case when en.side = '{s}' then v else 0 end) over w as {s}_volume, last_value(case when en.side = '{s}' then avg end ignore nulls) over w as {s}_last" for s in _SIDES) + """
         from en join av on av.symbol = en.symbol and av.side = en.side and av.k = en.k window w as (partition by en.symbol order by en.ts, en.o, en.order_id rows unbounded preceding))"""
_ACC = "cash long_asset short_asset long_volume short_volume long_avg short_avg"


def _account_sql(kind: str) -> str:
    return f"select *, case when abs(long_volume) > 1e-9 then coalesce(long_last, 0) else 0 end as long_avg, case when abs(short_volume) > 1e-9 then coalesce(short_last, 0) else 0 end as short_avg from ac where kind = '{kind}'"


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "info_df")
    cost = F.coalesce("slippage_cost", F.lit(0.0)) + F.coalesce("context_cost", F.lit(0.0))
    o = i.select("symbol", "order_id", F.col("date_time").alias("open_ts"), F.col("close_date_time").alias("close_ts"), F.col("order_direction").alias("side"), number("price").alias("price"), "volume", "deposit", cost.alias("cost"), "profit")
    return P.account(o, 1e6)


@query("symbol ts order_id side", _ACC, _account_sql("open"), _ACCOUNT, digits=4)
def bt_account_open(spark, sf):  # noqa: ANN001, ANN201
    return _accounts(spark, sf).filter("kind = 'open'")


@query("symbol ts order_id side", _ACC, _account_sql("close"), _ACCOUNT, digits=4)
def bt_account_close(spark, sf):  # noqa: ANN001, ANN201
    return _accounts(spark, sf).filter("kind = 'close'")


@query("symbol ts tie", "reward", f"""select symbol, ts, tie, case when abs(reward) < 10000 then reward end as reward from (select symbol, ts, tie, exp(abs(x) * 0.1) * x + 0.01 * abs(pos - coalesce(lag(pos) over {WIN}, 0)) as reward from
       (select *, pos * (lead(price, 3) over {WIN} / price - 1) as x from (select *, case when volume > 50 then 1.0 else 0.0 end as pos from t)))""", T, digits=5)  # fmt: skip
def rl_reward(spark, sf):  # noqa: ANN001, ANN201
    d = V.ticks(spark, sf).withColumn("position", F.when(F.col("volume") > 50, 1.0).otherwise(0.0))
    return P.rewards(d, 3, change_cost=0.01).withColumn("reward", F.when(F.abs("reward") < 10_000, F.col("reward")))


# ------------------------------------------------------------------------------------ preparation of charts


@query("exchange", "share start_angle end_angle", """select exchange, c / t as share, (run - c) / t * 6.283185307179586 as start_angle, run / t * 6.283185307179586 as end_angle from
       (select exchange, count(*) as c, sum(count(*)) over () as t, sum(count(*)) over (order by exchange) as run from contracts group by exchange)""")  # fmt: skip
def viz_pie_shares(spark, sf):  # noqa: ANN001, ANN201
    return X.pie_shares(table(spark, sf, "contracts").withColumn("one", F.lit(1)), "exchange", "one")


@query("a b", "value", "select a, b, r as value from pr", _PAIRS)
def viz_heatmap_long(spark, sf):  # noqa: ANN001, ANN201
    c = X.correlation_pairs(D.column_pairs(table(spark, sf, "lineitem"), _COLS))
    w = c.groupBy("a").pivot("b", _COLS[1:]).agg(F.first("corr"))
    return w.unpivot("a", _COLS[1:], "b", "value").filter("value is not null")


@query("bar_id color", sql="select bar_id, case when close > open and not isnan(close) then 'green' else 'red' end as color from bars where close is not null and open is not null and not isnan(close)")
def viz_bar_color(spark, sf):  # noqa: ANN001, ANN201
    b = table(spark, sf, "bars").select("bar_id", number("open").alias("o"), number("close").alias("c")).dropna()
    return b.withColumn("color", F.when(F.col("c") > F.col("o"), "green").otherwise("red"))


@query("symbol", "lo hi", "select symbol, min(price) - 0.1 * (max(price) - min(price)) as lo, max(price) + 0.1 * (max(price) - min(price)) as hi from p group by symbol", PR)
def viz_axis_range(spark, sf):  # noqa: ANN001, ANN201
    pad = 0.1 * (F.max("price") - F.min("price"))
    return _p(spark, sf).groupBy("symbol").agg((F.min("price") - pad).alias("lo"), (F.max("price") + pad).alias("hi"))
