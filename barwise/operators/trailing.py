"""Totals and averages over trailing calendar periods (problem 5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from barwise.session import number


def trailing_totals(df: DataFrame, key: str, ts: str, value: str, days: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and calendar day from its first to its last day with a row.

    Columns: ``key, day`` (date), ``rows_day``, and per ``n`` in ``days`` ``sum_{n}d``,
    ``count_{n}d`` and ``avg_{n}d`` over the ``n`` days ending that day.

    The rows are reduced to one per entity and day before anything is ordered, the
    missing days are added from the entity's own calendar (an exploded sequence, not a
    cross join), and the window then takes a fixed number of rows.  Null and NaN values
    do not count but their day still belongs to the calendar; rows with a null key or
    time are left out; repeated rows count as often as they occur; sums over a period
    without values are null and counts 0.  An empty table gives no rows.
    """
    daily = (
        df.select(F.col(key).alias("_k"), F.to_date(F.col(ts)).alias("_d"), number(value).alias("_v"))
        .filter("_k is not null and _d is not null")
        .groupBy("_k", "_d")
        .agg(F.sum("_v").alias("_s"), F.count("_v").alias("_c"), F.count(F.lit(1)).alias("_n"))
    )
    calendar = (
        daily.groupBy("_k")
        .agg(F.min("_d").alias("_a"), F.max("_d").alias("_z"))
        .select("_k", F.explode(F.sequence("_a", "_z", F.expr("interval 1 day"))).alias("_d"))
    )
    dense = calendar.join(daily, ["_k", "_d"], "left")
    out = [F.col("_k").alias(key), F.col("_d").alias("day"), F.coalesce("_n", F.lit(0)).cast("long").alias("rows_day")]
    for n in days:
        w = W.partitionBy("_k").orderBy("_d").rowsBetween(-(n - 1), 0)
        total, count = F.sum("_s").over(w), F.coalesce(F.sum("_c").over(w), F.lit(0)).cast("long")
        out += [total.alias(f"sum_{n}d"), count.alias(f"count_{n}d"), F.try_divide(total, count).alias(f"avg_{n}d")]
    return dense.select(*out)
