"""Further names: single columns of operators that compute several at once, and the tick forms of sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.functions.frames import rolling_apply
from barwise.operators import codependence as D
from barwise.operators.performance import env_steps
from barwise.plans import reference_io  # noqa: F401 (registers the queries used below)
from barwise.plans.reference import ORACLES, QUERIES, T, WIN, _COLS, _PAIRS, _RATE, query
from barwise.session import table
from barwise.sources import views as V
from barwise.sources.store import chunks, contains_any, download


def part(name: str, of: str, columns: str) -> None:
    """A query that gives some columns of another one; its SQL does the same."""
    cols = columns.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[of](spark, sf_dir).select(*cols)

    QUERIES[name] = run
    if of in ORACLES:
        ORACLES[name] = f"select {', '.join(cols)} from ({ORACLES[of]}) part_"


_ROW = "symbol ts tie "
for _name, _of, _cols in (
    ("price_diff", "pct_change", _ROW + "diff"), ("log_price", "pct_change", _ROW + "log_price"), ("log_price_diff", "pct_change", _ROW + "log_diff"),
    ("dt_hour", "dt_functions", "tie hour"), ("dt_weekday", "dt_functions", "tie weekday"), ("dt_day", "dt_functions", "tie day"), ("dt_format", "dt_functions", "tie date_text"),
    ("dt_parse", "dt_functions", "tie parsed"), ("dt_interval", "dt_make", "tie later"), ("utility_isoelastic", "utility_functions", _ROW + "u2 u1"), ("utility_exp", "utility_functions", _ROW + "ue"),
    ("lab_direction_scale", "lab_discounted_future", _ROW + "rd_5_dire rd_5_scale"), ("dist_angular", "dist_metrics", "g angular"), ("dist_abs_angular", "dist_metrics", "g abs_angular"),
    ("dist_sq_angular", "dist_metrics", "g sq_angular"), ("dist_euclidean", "dist_metrics", "g euclidean"), ("dist_manhattan", "dist_metrics", "g manhattan"), ("dist_chebyshev", "dist_metrics", "g chebyshev"),
    ("codep_cosine", "dist_metrics", "g cosine"), ("codep_kl", "codep_kl_js", "kl"), ("codep_js", "codep_kl_js", "js"), ("codep_mutual_info", "codep_information", "g mutual"),
    ("codep_variation_info", "codep_information", "g variation"), ("sb_cusum_pos", "sb_cusum", _ROW + "s_pos pos_break"), ("sb_cusum_neg", "sb_cusum", _ROW + "s_neg neg_break"),
    ("feat_indicator_copy", "ind_macd", _ROW + "dea macd"),
    ("store_list", "store_catalog", "library table_name"), ("store_write", "store_catalog", "library table_name version"), ("io_h5_save", "io_save_load", _ROW + "price"), ("io_h5_load", "io_save_load", _ROW + "price"),
):
    part(_name, _of, _cols)


def _tick_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ticks").filter("symbol is not null and created_at is not null").groupBy("symbol").agg(F.min("created_at").alias("start_ts"), F.max("created_at").alias("end_ts"))


_CHUNKS = """select symbol, c as chunk_start, least(c + interval 72 hour, z) as chunk_end from
  (select symbol, z, unnest(generate_series(a, z, interval 72 hour)) as c from (select symbol, min(created_at) as a, max(created_at) as z from ticks where symbol is not null and created_at is not null group by symbol)) where c < z"""


@query("symbol chunk_start chunk_end", sql=_CHUNKS)
def src_chunked_ticks(spark, sf):  # noqa: ANN001, ANN201
    return chunks(_tick_tasks(spark, sf), 72 * 3600)


@query("symbol chunk_start chunk_end", sql=_CHUNKS)
def src_multi_ticks(spark, sf):  # noqa: ANN001, ANN201
    def fetch(task):  # noqa: ANN001, ANN202
        return task[["symbol", "chunk_start", "chunk_end"]].to_frame().T

    return download(_tick_tasks(spark, sf), fetch, "symbol string, chunk_start timestamp_ntz, chunk_end timestamp_ntz", 72 * 3600)


@query("exchange symbol sec_name", sql="select exchange, symbol, sec_name from contracts where (exchange = 'XNA' and contains(sec_name, 'month')) or (exchange = 'XTP' and (contains(sec_name, 'contin') or contains(sec_name, '24')))")
def src_contract_filter(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "contracts")
    return contains_any(c.filter("exchange = 'XNA'"), "sec_name", ["month"]).unionByName(contains_any(c.filter("exchange = 'XTP'"), "sec_name", ["contin", "24"]))


@query("symbol tick_id created_at", "price", "select symbol, tick_id, created_at, case when isnan(price) then null else price end as price from (select *, row_number() over (partition by symbol order by created_at desc, tick_id desc) as k from ticks where symbol is not null and created_at is not null) where k = 1")
def src_realtime_ticks(spark, sf):  # noqa: ANN001, ANN201
    """The latest tick of each symbol, as a snapshot poll gives it."""
    t = table(spark, sf, "ticks").filter("symbol is not null and created_at is not null")
    last = t.groupBy("symbol").agg(F.max_by(F.struct("tick_id", "created_at", "price"), F.struct("created_at", "tick_id")).alias("l"))
    return last.select("symbol", "l.tick_id", "l.created_at", F.nullif(F.col("l.price"), F.lit(float("nan"))).alias("price"))


@query("symbol bar_id bob", sql="select symbol, bar_id, bob from (select *, row_number() over (partition by symbol order by bob desc, bar_id desc) as k from bars where symbol is not null and bob is not null) where k = 1")
def src_realtime_bars(spark, sf):  # noqa: ANN001, ANN201
    b = table(spark, sf, "bars").filter("symbol is not null and bob is not null")
    return b.groupBy("symbol").agg(F.max_by("bar_id", F.struct("bob", "bar_id")).alias("bar_id"), F.max("bob").alias("bob"))


@query("symbol ts tie", sql="select symbol, ts, tie, rank() over (partition by symbol order by price) - 1 as place from t", ctes=T, longs="place")
def search_value(spark, sf):  # noqa: ANN001, ANN201
    """How many prices of the symbol are smaller: counts per price and running totals of them, joined back."""
    from pyspark.sql import Window as W

    t = V.ticks(spark, sf)
    per = t.groupBy("symbol", "price").agg(F.count(F.lit(1)).alias("c"))
    below = per.select("symbol", "price", F.coalesce(F.sum("c").over(W.partitionBy("symbol").orderBy("price").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("place"))
    return t.join(below, ["symbol", "price"])


@query("symbol ts tie done", "portfolio reward", f"""select symbol, ts, tie, portfolio, ahead_1 is null as done, case when r >= 0 then (sqrt(r + 1) - 1) / 0.5 else exp(abs(r) * 0.1) * r end + case when portfolio <> before then 0.01 else 0 end as reward from
       (select *, portfolio * (ahead / price - 1) as r from (select *, lead(price, 3) over {WIN} as ahead, lead(price, 4) over {WIN} as ahead_0, lead(price, 5) over {WIN} as ahead_1, case when rn > 10 then lag(portfolio) over {WIN} else 0 end as before
        from (select *, (tie % 3 - 1)::double as portfolio from n))) where rn >= 10 and ahead_0 is not null""", _RATE, digits=4)  # fmt: skip
def rl_env_step(spark, sf):  # noqa: ANN001, ANN201
    return env_steps(V.ticks(spark, sf), F.pmod("tie", F.lit(3)) - 1, n=3)


@query("symbol ts tie", "slope", "select symbol, ts, tie, case when count(price) over f = 7 then regr_slope(price, rn) over f end as slope from n window f as (partition by symbol order by ts, tie rows between 6 preceding and current row)", _RATE)
def roll_apply(spark, sf):  # noqa: ANN001, ANN201
    """A function of one's own over the last rows, here the slope of a fitted line."""
    x = np.arange(7) - 3.0
    return rolling_apply(V.ticks(spark, sf), "price", "slope", 7, lambda y: float(x @ y) / 28.0)


@query("a b", "distance", "select a, b, sqrt((1 - r) / 2) as distance from pr", _PAIRS)
def codep_callable(spark, sf):  # noqa: ANN001, ANN201
    """A metric of one's own for every pair of columns."""
    return D.pair_metric(D.column_pairs(table(spark, sf, "lineitem"), _COLS), "distance", lambda x, y: np.sqrt((1 - np.corrcoef(x, y)[0, 1]) / 2))


@query("table_name", sql="select 'contracts' as table_name, 2 as version, 1 as versions, false as deleted union all select 'prices', 1, 2, false union all select 'spare', null, 0, true", longs="version versions deleted")
def store_admin(spark, sf):  # noqa: ANN001, ANN201
    """Versions kept and dropped, and tables deleted."""
    s = reference_io._stored(spark, sf)
    c = table(spark, sf, "contracts").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    s.write("market", "prices", s.read("market", "prices"), keep_old=True)
    for _ in range(3):
        s.write("market", "contracts", c, keep_old=True)
    s.keep_last("market", "contracts")
    s.write("market", "spare", c)
    s.delete("market", "spare")
    names = ("contracts", "prices", "spare")
    had = {t: s.versions("market", t) for t in names}
    rows = [(t, had[t][-1] if had[t] else None, len(had[t]), not s.has_table("market", t)) for t in names]
    return spark.createDataFrame(rows, "table_name string, version long, versions long, deleted boolean")
