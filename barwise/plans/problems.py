"""Queries of the general training-data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.operators.flatten import flatten_levels, flatten_records, flatten_ticks
from barwise.operators.intervals import interval_gaps, merge_intervals
from barwise.operators.regular_grid import MIN_SUPPORT, regular_grid
from barwise.operators.spikes import implausible
from barwise.operators.trailing import trailing_totals
from barwise.session import floor_div, table

DAY_S = 86_400


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = flatten_ticks(table(spark, sf_dir, "tick_payloads"), "record_id", "payload")
    return flatten_levels(ticks, "record_id").select("record_id", "tick_no", "symbol", "level_no")


def p1_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_levels(flatten_ticks(table(spark, sf_dir, "tick_payloads"), "record_id", "payload"), "record_id")


def p1_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_ticks(table(spark, sf_dir, "tick_payloads"), "record_id", "payload").drop("quotes")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_records(table(spark, sf_dir, "tick_payloads"), "record_id", "payload")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(table(spark, sf_dir, "bars"))


def p5_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trailing_totals(table(spark, sf_dir, "bars"), "symbol", "bob", "close")
    return out.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows_day", *[F.round(F.col(c) + 1e-9, 4).alias(c) if c[:5] != "count" else F.col(c) for c in out.columns[3:]])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trailing_totals(table(spark, sf_dir, "bars"), "symbol", "bob", "close")
    return out.filter("count_7d = 0 and count_30d > 0").select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regular_grid(table(spark, sf_dir, "ticks"), "symbol", "created_at", "price", "last_volume")
    return out.select("symbol", F.col("step").alias("epoch_minute"), "readings", "volume", F.round("value", 6).alias("price"), F.round("support", 6).alias("support"), "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that the local regression filled, or that it marked for want of support."""
    out = regular_grid(table(spark, sf_dir, "ticks"), "symbol", "created_at", "price", "last_volume")
    made = ((F.col("mark") == "filled") & F.col("value").isNotNull()) | ((F.col("mark") == "missing") & (F.col("support") < MIN_SUPPORT))
    return out.filter(made).select("symbol", F.col("step").alias("epoch_minute"))


def p7_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge_intervals(table(spark, sf_dir, "bars"), "symbol", "bob", "eob")
    return out.select("symbol", floor_div(F.col("period_start_us"), 1_000_000).alias("period_start"), floor_div(F.col("period_end_us"), 1_000_000).alias("period_end"), "intervals")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = interval_gaps(table(spark, sf_dir, "bars"), "symbol", "bob", "eob", min_gap_us=2_000_000)
    s = gaps.select("symbol", floor_div(F.col("gap_start_us"), 1_000_000).alias("gap_start"), floor_div(F.col("gap_end_us"), 1_000_000).alias("gap_end"))
    return s.filter(floor_div(F.col("gap_start"), DAY_S) == floor_div(F.col("gap_end"), DAY_S))


QUERIES = {f.__name__: f for f in (p1_found, p1_levels, p1_ticks, p1_records, p3_found, p5_found, p5_trailing, p6_found, p6_grid, p7_found, p7_periods)}
