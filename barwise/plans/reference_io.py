"""Queries over the store, ingestion, streams, rollouts and the remaining scalar functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions.frames import full, rolling
from barwise.operators import clean as C
from barwise.operators.crosssection import blocked_product
from barwise.plans.reference import BA, PR, WIN, T, _COLS, _PAIRS, _p, _rates, _RATE, query
from barwise.session import number, shared_folder, table
from barwise.sources import views as V
from barwise.sources.store import TableStore, download
from barwise.streaming.bars import clock_bars, volume_bars_stream


def _shared(spark: SparkSession) -> str:
    return shared_folder(spark, "store")


def _stored(spark: SparkSession, sf: str) -> TableStore:
    s = TableStore(spark, _shared(spark))
    s.write("market", "prices", _p(spark, sf).select("symbol", "ts", "tie", "price"), metadata={"source": "bars"})
    return s


_A, _Z = "2024-01-10 00:00:00", "2024-01-12 23:59:59"


def _lit(t: str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


@query("symbol ts tie", "price", f"select symbol, ts, tie, price from p where ts between timestamp '{_A}' and timestamp '{_Z}'", PR)
def store_read(spark, sf):  # noqa: ANN001, ANN201
    return _stored(spark, sf).read("market", "prices", start=_lit(_A), end=_lit(_Z), columns=["symbol", "ts", "tie", "price"])


@query("symbol ts tie", "price", f"select symbol, ts, tie, case when ts between timestamp '{_A}' and timestamp '{_Z}' then price * 2 else price end as price from p", PR)
def store_upsert_range(spark, sf):  # noqa: ANN001, ANN201
    s = _stored(spark, sf)
    new = s.read("market", "prices", start=_lit(_A), end=_lit(_Z)).withColumn("price", F.col("price") * 2)
    s.update("market", "prices", new, _lit(_A), _lit(_Z))
    return s.read("market", "prices")


@query("symbol ts tie", "price", f"select symbol, ts, tie, price from p where not ts between timestamp '{_A}' and timestamp '{_Z}'", PR)
def store_delete_range(spark, sf):  # noqa: ANN001, ANN201
    s = _stored(spark, sf)
    s.delete_range("market", "prices", _lit(_A), _lit(_Z))
    return s.read("market", "prices")


@query("table_name", sql="select 'contracts' as table_name, count(*) as n from contracts union all select 'prices', count(*) from p", ctes=PR, longs="n")
def store_read_batch(spark, sf):  # noqa: ANN001, ANN201
    s = _stored(spark, sf)
    s.write("market", "contracts", table(spark, sf, "contracts").withColumn("ts", _lit(_A)))
    return s.read_many("market", ["prices", "contracts"]).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


@query("library table_name", sql="select 'market' as library, 'prices' as table_name, 1 as version, 'bars' as source", longs="version")
def store_catalog(spark, sf):  # noqa: ANN001, ANN201
    s = _stored(spark, sf)
    s.write("market", "prices", s.read("market", "prices"), metadata=s.metadata("market", "prices"))
    rows = [(lib, t, v) for lib in s.libraries() for t in s.tables(lib) for v in s.versions(lib, t)]
    return spark.createDataFrame(rows, "library string, table_name string, version long")


@query("symbol exchange sec_id sec_name", "price_tick", "select symbol, exchange, sec_id, sec_name, price_tick from contracts")
def src_symbol_info(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "contracts").select("symbol", "exchange", "sec_id", "sec_name", "price_tick")


@query("symbol chunk_start", sql="select symbol, c as chunk_start, date_diff('hour', c, least(c + interval 48 hour, z)) as hours from (select symbol, z, unnest(generate_series(a, z, interval 48 hour)) as c from (select symbol, date_trunc('day', min(bob))::timestamp as a, date_trunc('day', max(bob))::timestamp as z from bars where symbol is not null group by symbol)) where c < z", longs="hours")
def src_multi_bars(spark, sf):  # noqa: ANN001, ANN201
    b = table(spark, sf, "bars").filter("symbol is not null").groupBy("symbol").agg(F.date_trunc("day", F.min("bob")).cast("timestamp_ntz").alias("start_ts"), F.date_trunc("day", F.max("bob")).cast("timestamp_ntz").alias("end_ts"))

    def fetch(task: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [task["symbol"]], "chunk_start": [task["chunk_start"]], "hours": [int((task["chunk_end"] - task["chunk_start"]).total_seconds() // 3600)]})

    return download(b, fetch, "symbol string, chunk_start timestamp_ntz, hours long", 48 * 3600)


@query("symbol ts tie", "price", "select symbol, ts, tie, price from p", PR)
def io_save_load(spark, sf):  # noqa: ANN001, ANN201
    at = _shared(spark)
    _p(spark, sf).select("symbol", "ts", "tie", "price").write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


@query("order_id", "profit", "select order_id, profit from info_df")
def csv_export(spark, sf):  # noqa: ANN001, ANN201
    at = _shared(spark)
    table(spark, sf, "info_df").select("order_id", "profit").write.option("header", True).csv(at)
    return spark.read.schema("order_id long, profit double").option("header", True).csv(at)


def _drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is and give its result."""
    spark = df.sparkSession
    out = _shared(spark)
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def _tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("double") + 1
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), k.alias("volume"))


@query("symbol start_ts", "open high low close volume", longs="ticks", digits=4)
def resample_stream(spark, sf):  # noqa: ANN001, ANN201
    return _drained(clock_bars(_tick_stream(spark, sf), "6 hours", "1 hour"))


@query("symbol start_ts end_ts", "volume high low open close", longs="ticks", digits=4)
def bar_stream(spark, sf):  # noqa: ANN001, ANN201
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drained(volume_bars_stream(_tick_stream(spark, sf), 1500.0))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# ------------------------------------------------------------------------------------ remaining functions


@query("symbol ts tie", "clipped", "select symbol, ts, tie, least(lo, quantile_cont(lo, 0.99) over (partition by symbol)) as clipped from (select symbol, ts, tie, greatest(price, quantile_cont(price, 0.01) over (partition by symbol)) as lo from p)", PR)
def winsorize_rate(spark, sf):  # noqa: ANN001, ANN201
    """One side after the other: the upper quantile is taken of what the lower clip left."""
    low = C.clip_quantile(_p(spark, sf), "price", 0.01, 1.0).withColumn("price", F.col("clipped"))
    return C.clip_quantile(low, "price", 0.0, 0.99)


_V2 = T + f""", r0 as (select symbol, ts, tie, coalesce(price / lag(price) over {WIN} - 1, 0) as rate from t),
  r1 as (select symbol, ts, tie, greatest(least(rate, quantile_cont(rate, 0.99) over (partition by symbol)), quantile_cont(rate, 0.01) over (partition by symbol)) as rate from r0),
  f as (select *, 0.01 / stddev_samp(rate) over (partition by symbol) * rate as rate_1, (rate - avg(rate) over (partition by symbol)) / stddev_samp(rate) over (partition by symbol) as rate_3,
        0.01 / nullif(case when count(rate) over w = 90 then stddev_samp(rate) over w end, 0) * rate as rate_2 from r1 window w as (partition by symbol order by ts, tie rows between 89 preceding and current row))"""


@query("symbol ts tie", "rate rate_1 rate_2 rate_3 close_1", "select *, exp(sum(ln(1 + rate_1)) over (partition by symbol order by ts, tie rows unbounded preceding)) as close_1 from f", _V2, digits=4)
def norm_rate_v2(spark, sf):  # noqa: ANN001, ANN201
    from barwise.functions.frames import running

    d = C.clip_quantile(C.changes(V.ticks(spark, sf)).withColumn("rate", F.coalesce("pct", F.lit(0.0))), "rate").withColumn("rate", F.col("clipped"))
    d = C.zscore(d, "rate", "rate_3", sample=True)
    s = d.groupBy("symbol").agg(F.stddev_samp("rate").alias("_s"))
    d = d.join(s, "symbol").withColumn("rate_1", F.try_divide(F.lit(0.01), F.col("_s")) * F.col("rate"))
    d = rolling(d.drop("_s"), lambda w: {"_r": full(F.stddev_samp, "rate", w, 90)}, back=90).withColumn("rate_2", F.try_divide(F.lit(0.01), F.col("_r")) * F.col("rate"))
    d = running(d.withColumnRenamed("_r", "roll_std"), sums={"log_close": F.ln(1 + F.col("rate_1"))})
    return d.withColumn("close_1", F.exp("log_close"))


@query("tie day_start later", sql="select tie, make_timestamp(year(ts), month(ts), day(ts), 0, 0, 0.0) as day_start, ts + interval 90 minute as later from t", ctes=T)
def dt_make(spark, sf):  # noqa: ANN001, ANN201
    ts = F.col("ts")
    made = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.lit(0), F.lit(0), F.lit(0))
    return V.ticks(spark, sf).select("tie", made.alias("day_start"), (ts + F.make_dt_interval(mins=F.lit(90))).alias("later"))


@query("tie", "root logged power low", "select tie, sqrt(price) as root, ln(price) as logged, power(price / 100, 1.5) as power, least(price, volume) as low, sign(price - volume) as side, cast(case when price <= volume then 0 else 1 end as bigint) as argmin from t", T, longs="side argmin")
def math_scalars(spark, sf):  # noqa: ANN001, ANN201
    p, v = F.col("price"), F.col("volume")
    both = F.array(p, v)
    return V.ticks(spark, sf).select(
        "tie", F.sqrt(p).alias("root"), F.ln(p).alias("logged"), F.pow(p / 100, F.lit(1.5)).alias("power"), F.least(p, v).alias("low"), F.signum(p - v).alias("side"),
        (F.array_position(both, F.array_min(both)) - 1).alias("argmin"))


@query("vec_id", "dot first_half", """select vec_id, list_dot_product(embedding[1:3]::double[], [0.5, 0.3, 0.2]::double[]) as dot, list_sum(embedding[1:32]::double[]) as first_half, len(embedding) as n from embeddings""", longs="n", digits=4)
def array_functions(spark, sf):  # noqa: ANN001, ANN201
    e = F.col("embedding")
    weights = F.array(*[F.lit(x) for x in (0.5, 0.3, 0.2)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", total(F.zip_with(F.slice(e, 1, 3), weights, lambda a, b: a.cast("double") * b)).alias("dot"), total(F.slice(e, 1, 32)).alias("first_half"), F.size(e).alias("n"))


@query("item_id", sql="select item_id, length(text) as chars, len(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))) as letters from eval_items", longs="chars letters")
def string_functions(spark, sf):  # noqa: ANN001, ANN201
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return table(spark, sf, "eval_items").select("item_id", F.char_length("text").alias("chars"), F.size(F.array_distinct(chars)).alias("letters"))


@query("kind", "value", "select 'price' as kind, price as value from t union all select 'volume', volume from t", T)
def concat_arrays(spark, sf):  # noqa: ANN001, ANN201
    t = V.ticks(spark, sf)
    return t.select(F.lit("price").alias("kind"), F.col("price").alias("value")).union(t.select(F.lit("volume"), F.col("volume")))


@query("n_nationkey", sql="select n_nationkey, row_number() over (order by n_regionkey, n_nationkey) - 1 as place from nation", longs="place")
def reorder_by_label(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "nation").withColumn("place", F.row_number().over(W.orderBy("n_regionkey", "n_nationkey")) - 1)


@query("a b", sql="select a, b from pr", ctes=_PAIRS)
def join_pairs_triangular(spark, sf):  # noqa: ANN001, ANN201
    c = spark.createDataFrame(list(enumerate(_COLS)), "i int, name string")
    return c.alias("l").join(c.alias("r"), F.col("l.i") < F.col("r.i")).select(F.col("l.name").alias("a"), F.col("r.name").alias("b"))


@query("i j", "d", "select u.n_nationkey as i, v.n_nationkey as j, abs(u.n_regionkey - v.n_regionkey) as d from nation u, nation v")
def join_cross_pairwise(spark, sf):  # noqa: ANN001, ANN201
    n = table(spark, sf, "nation")
    pairs = blocked_product(n.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("ri")), n.select(F.col("n_nationkey").alias("j"), F.col("n_regionkey").alias("rj")))
    return pairs.withColumn("d", F.abs(F.col("ri") - F.col("rj")))


@query("symbol ts", "price volume", "select b.symbol, b.bob as ts, case when isnan(b.close) then null else b.close end as price, e.v as volume from b left join (select symbol, date_time, sum(volume) as v from event_df where symbol is not null and date_time is not null group by all) e on e.symbol = b.symbol and e.date_time = b.bob", BA)
def join_index_align(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "event_df").filter("symbol is not null and date_time is not null").groupBy("symbol", F.col("date_time").alias("ts")).agg(F.sum("volume").alias("volume"))
    b = V.bars(spark, sf).select("symbol", F.col("bob").alias("ts"), number("close").alias("price"))
    return b.join(e, ["symbol", "ts"], "left")


@query("symbol ts", sql="""select e.symbol, p.ts, count(*) as orders from (select symbol, date_time from event_df where symbol is not null and date_time is not null) e asof join p on p.symbol = e.symbol and p.ts >= e.date_time group by all""", ctes=PR, longs="orders")
def join_event_replay(spark, sf):  # noqa: ANN001, ANN201
    from barwise.operators.labels import asof_forward

    e = table(spark, sf, "event_df").filter("symbol is not null and date_time is not null").select("symbol", "date_time")
    return asof_forward(e, _p(spark, sf), "date_time").groupBy("symbol", F.col("found_ts").alias("ts")).agg(F.count(F.lit(1)).alias("orders"))


@query("symbol ts tie", sql=f"select symbol, ts, tie, lag(tie) over {WIN} as prev_tie, lead(tie) over {WIN} as next_tie from n where rate is not null", ctes=_RATE, longs="prev_tie next_tie")
def rl_replay_transitions(spark, sf):  # noqa: ANN001, ANN201
    d = _rates(spark, sf).filter("rate is not null").drop("rn")
    return rolling(d, lambda w: {"prev_tie": F.lag("tie").over(w), "next_tie": F.lead("tie").over(w)}, back=1, ahead=1)


@query("tie", "priority")
def rl_replay_sample(spark, sf):  # noqa: ANN001, ANN201
    """A weighted sample without replacement: the 500 largest u^(1/w), u from a seeded hash (the size is the feature)."""
    d = _rates(spark, sf).filter("rate is not null")
    u = (F.pmod(F.xxhash64("tie", F.lit(7)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    return d.select("tie", (F.ln(u) / (F.abs("rate") + 1e-6)).alias("priority")).orderBy(F.col("priority").desc(), "tie").limit(500)


@query("episode", "total", longs="steps")
def rl_rollout(spark, sf):  # noqa: ANN001, ANN201
    """Episodes of random positions over each symbol's day: one seeded episode per (symbol, day)."""
    d = _rates(spark, sf).filter("rate is not null").select(F.concat_ws("@", "symbol", F.date_format("ts", "yyyy-MM-dd")).alias("episode"), "ts", "tie", "rate")

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "tie"])
        name = pdf["episode"].iloc[0]
        rng = np.random.default_rng(list(name.encode()))
        position = rng.integers(-1, 2, len(pdf))
        return pd.DataFrame({"episode": [name], "total": [float((position[:-1] * pdf["rate"].to_numpy()[1:]).sum())], "steps": [len(pdf)]})

    return d.groupBy("episode").applyInPandas(play, "episode string, total double, steps long")


@query("", "price_mean volume_mean", "select avg(price) as price_mean, avg(volume) as volume_mean, count(*) as n from t", T, longs="n")
def agg_scalar(spark, sf):  # noqa: ANN001, ANN201
    return V.ticks(spark, sf).agg(F.avg("price").alias("price_mean"), F.avg("volume").alias("volume_mean"), F.count(F.lit(1)).alias("n"))


