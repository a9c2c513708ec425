"""Exact quantiles without holding a group in one task.

A group's values are reduced to counts, sorted into equally large ranges drawn from the data, summed
range by range, and only the ranges that hold a wanted rank are added up value by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions import frames
from barwise.session import number


def quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float], name: str = "_q") -> DataFrame:
    """``by`` and ``name``, an array of the quantiles at ``probs`` with linear interpolation between neighbours.

    Nulls and NaN do not count; groups without values give no row.
    """
    by = list(by)
    counts = df.select(*by, number(value).alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranged = frames.ranged(counts, *by, "_v").withColumnRenamed("_p", "_r")
    lower = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    per = ranged.groupBy(*by, "_r").agg(F.sum("_c").alias("_t"))
    per = per.select(*by, "_r", "_t", F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_off"), F.sum("_t").over(W.partitionBy(*by)).alias("_n"))
    # 0-based places below and above each quantile
    places = F.flatten(F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), f((F.col("_n") - 1) * p).cast("long").alias("at"), F.lit(s).alias("side")) for s, f in enumerate((F.floor, F.ceil))]) for i, p in enumerate(probs)]))
    held = per.withColumn("_w", F.filter(places, lambda x: (x["at"] >= F.col("_off")) & (x["at"] < F.col("_off") + F.col("_t")))).filter(F.size("_w") > 0)
    held = held.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate([*by, "_r"])], "_off", "_n", "_w")
    inner = ranged.join(held, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate([*by, "_r"])]))
    run = F.col("_off") + F.sum("_c").over(W.partitionBy(*by, "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    got = inner.withColumn("_to", run).withColumn("_h", F.filter("_w", lambda x: (x["at"] < F.col("_to")) & (x["at"] >= F.col("_to") - F.col("_c"))))
    got = got.select(*by, "_v", "_n", F.explode("_h").alias("_h")).groupBy(*by, "_n", F.col("_h.i").alias("_i")).agg(
        F.min(F.when(F.col("_h.side") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_h.side") == 1, F.col("_v"))).alias("_b"))
    share = F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")]
    place = (F.col("_n") - 1) * share
    x = F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))
    return got.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", x.alias("_x")))).alias("_s")).select(*by, F.col("_s._x").alias(name))


def mean_ranks(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``, the rank of a value in its group from 1 on, equal values with the mean of their ranks.

    Ranks are worked out for the distinct values, range by range, and joined to the rows; rows with a null value or group are dropped.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranged = frames.ranged(counts, *by, value)
    lower = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    per = ranged.groupBy(*by, "_p").agg(F.sum("_c").alias("_t")).select(*by, "_p", F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_off"))
    upto = F.sum("_c").over(W.partitionBy(*by, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranks = ranged.join(per, [*by, "_p"]).select(*by, value, (F.col("_off") + upto - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value])
