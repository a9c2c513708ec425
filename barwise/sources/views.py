"""Input views of the time-series operators: ticks, bars, prices, panel, event intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.session import number, table


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, ts, tie, price, high, low, volume`` from the event stream (symbol: its type)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double") + 1
    v = F.col("value")
    out = e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tie"), v.alias("price"), v.alias("high"), v.alias("low"), k.alias("volume"))
    return out.filter("symbol is not null and ts is not null and price is not null and volume is not null")


TICKS_SQL = """t as (select event_type as symbol, ts, event_id as tie, value as price, value as high, value as low,
                 cast(json_extract(props, '$.k') as double) + 1 as volume from events
          where event_type is not null and ts is not null and value is not null and json_extract(props, '$.k') is not null)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with repeated deliveries removed: of the rows of a symbol and bob the one with the smallest id."""
    b = table(spark, sf_dir, "bars").filter("symbol is not null and bob is not null")
    first = F.row_number().over(W.partitionBy("symbol", "bob").orderBy("bar_id"))
    return b.withColumn("_n", first).filter("_n = 1").drop("_n")


BARS_SQL = """b as (select * exclude (n) from (select *, row_number() over (partition by symbol, bob order by bar_id) as n
          from bars where symbol is not null and bob is not null) where n = 1)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, ts, tie, price, open, low, high, volume, amount, position``: the bars whose close is a number above 0."""
    b = bars(spark, sf_dir)
    num = {c: number(c) for c in ("open", "low", "high", "volume", "amount", "position")}
    return b.select("symbol", F.col("bob").alias("ts"), F.col("bar_id").alias("tie"), number("close").alias("price"), *[c.alias(n) for n, c in num.items()]).filter("price > 0")


PRICES_SQL = (
    BARS_SQL
    + """, p as (select symbol, bob as ts, bar_id as tie, close as price, open, low, high, volume, amount, position
          from b where close is not null and not isnan(close) and close > 0)"""
)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts, asset, price``: the last event value of each type and day."""
    t = ticks(spark, sf_dir)
    return t.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("symbol").alias("asset")).agg(F.max_by("price", F.struct("ts", "tie")).alias("price"))


PANEL_SQL = TICKS_SQL + ", panel as (select date_trunc('day', ts)::timestamp as ts, symbol as asset, arg_max(price, struct_pack(a := ts, b := tie)) as price from t group by all)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, symbol, t0, t1``: closed orders as intervals."""
    i = table(spark, sf_dir, "info_df")
    return i.select(F.col("order_id").alias("event_id"), "symbol", F.col("date_time").alias("t0"), F.col("close_date_time").alias("t1")).filter("symbol is not null and t0 is not null and t1 >= t0")


INTERVALS_SQL = "i as (select order_id as event_id, symbol, date_time as t0, close_date_time as t1 from info_df where symbol is not null and date_time is not null and close_date_time >= date_time)"
