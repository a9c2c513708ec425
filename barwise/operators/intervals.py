"""Merging overlapping intervals and listing the gaps between them (problem 7).

Sort by start per entity, compare each start with the running maximum of the ends
before it, label islands by a running count, aggregate.  A single hot entity would
make such a window one task, so the window runs per (entity, block of time): a
block takes over the largest end and the number of islands of all blocks before it
from a summary that has one row per entity and block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from barwise.functions.frames import rolling
from barwise.session import epoch_us, floor_div

DAY_US = 86_400_000_000


def _islands(df: DataFrame, key: str, start: str, end: str, block_us: int) -> DataFrame:
    """``_k, _i, _from, _to, _n``: the covered periods of each entity, numbered without gaps from 1 in order of time, and the rows of each."""
    rows = (
        df.select(F.col(key).alias("_k"), epoch_us(F.col(start)).alias("_s"), epoch_us(F.col(end)).alias("_e"))
        .filter("_k is not null and _s is not null and _e > _s")
        .withColumn("_b", floor_div(F.col("_s"), block_us))
    )
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    reached = rows.groupBy("_k", "_b").agg(F.max("_e").alias("_m")).select("_k", "_b", F.max("_m").over(before).alias("_in"))
    inside = W.partitionBy("_k", "_b").orderBy("_s", "_e")
    carry = F.greatest("_p", "_in")
    rows = rows.withColumn("_p", F.max("_e").over(inside.rowsBetween(W.unboundedPreceding, -1))).join(reached, ["_k", "_b"])
    rows = rows.withColumn("_new", F.coalesce(F.col("_s") > carry, F.lit(True)).cast("long"))
    offset = rows.groupBy("_k", "_b").agg(F.sum("_new").alias("_t")).select("_k", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return (
        rows.withColumn("_l", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(offset, ["_k", "_b"])
        .groupBy("_k", (F.col("_off") + F.col("_l")).alias("_i"))
        .agg(F.min("_s").alias("_from"), F.max("_e").alias("_to"), F.count(F.lit(1)).alias("_n"))
    )


def merge_intervals(df: DataFrame, key: str, start: str, end: str, block_us: int = DAY_US) -> DataFrame:
    """``key, period_start_us, period_end_us, intervals``: the continuous covered periods.

    Intervals are half-open; touching ones belong together.  Rows with a null key, start or end, or an end not after the
    start, are ignored; ``intervals`` counts the rows of a period, copies included; an empty table gives no rows.  Only the
    three named columns are read, so further columns may have any name.
    """
    return _islands(df, key, start, end, block_us).select(F.col("_k").alias(key), F.col("_from").alias("period_start_us"), F.col("_to").alias("period_end_us"), F.col("_n").alias("intervals"))


def interval_gaps(df: DataFrame, key: str, start: str, end: str, min_gap_us: int = 1, block_us: int = DAY_US) -> DataFrame:
    """``key, gap_start_us, gap_end_us``: stretches of at least ``min_gap_us`` between two successive periods of :func:`merge_intervals`.

    Rows are ignored as there; repeated rows change nothing; an entity with one covered period has no gaps; an empty
    table gives no rows.  The period after another one is found by its number, in blocks of numbers.
    """
    periods = _islands(df, key, start, end, block_us).select(F.col("_k").alias("symbol"), (F.col("_i") - 1).alias("rn"), "_from", "_to")
    d = rolling(periods, lambda w: {"_next": F.lead("_from").over(w)}, ahead=1)
    return d.filter(F.col("_next") - F.col("_to") >= min_gap_us).select(F.col("symbol").alias(key), F.col("_to").alias("gap_start_us"), F.col("_next").alias("gap_end_us"))
