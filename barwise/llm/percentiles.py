"""Percentiles of very large numeric columns from mergeable counts (problem 2).

Cumulative frequencies: values are reduced to (group, value, count), which adds up over
files, days or partitions; the counts are range-sorted into ranges drawn from the data, equally
large however close the values of a group lie; running sums are taken inside a range, the
totals of the lower ranges are added as offset, and the first value whose cumulative count
reaches the target rank is the percentile.

With ``rel_error`` 0 the counts are of the values themselves and percentiles are exact
(nearest rank).  With ``rel_error`` e > 0 a value is replaced by the middle of a
logarithmic bin, ratio (1 + e) / (1 - e) wide, before counting: every percentile then lies
within the fraction e of the exact one, and a group keeps at most some ln(max/min) / (2 e)
counts however many values it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from barwise.functions import frames
from barwise.session import number

PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _bin(v: Column, rel_error: float) -> Column:
    """Number of the logarithmic bin; the sign is kept apart."""
    return F.ceil(F.ln(F.abs(v)) / F.lit(math.log((1 + rel_error) / (1 - rel_error))))


def representative(v: Column, rel_error: float) -> Column:
    """The value that stands for ``v`` in the counts."""
    if rel_error <= 0:
        return v
    g = (1 + rel_error) / (1 - rel_error)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.exp(_bin(v, rel_error) * F.lit(math.log(g))) * F.lit(2 / (1 + g)))


def value_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rel_error: float = 0.0, by: Column | None = None) -> DataFrame:
    """Partial result: ``<keys>, [part,] metric, value, n``.

    Null and NaN values are skipped (infinite ones too); null keys form a group of their
    own; repeated rows count each time.  ``by`` adds the part (a day, a file) to the keys.
    """
    metrics = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), number(c).alias("v")) for c in columns])).alias("m")
    part = [by.alias("part")] if by is not None else []
    rows = df.select(*keys, *part, metrics).select(*keys, *(["part"] if part else []), "m.metric", "m.v").filter(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    rows = rows.withColumn("value", representative(F.col("v"), rel_error) + F.lit(0.0))
    return rows.groupBy(*keys, *(["part"] if part else []), "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of several parts (or of unions of :func:`value_counts` results) as counts of the whole."""
    return counts.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """``<keys>, metric, prob, n, value``: the smallest value whose cumulative count is at least ``prob * n``.

    ``counts`` must have one row per group, metric and value.  Groups without a value give
    no rows; a group with one value has it at every probability.
    """
    group = [*keys, "metric"]
    ranged = frames.ranged(counts, *group, "value").withColumnRenamed("_p", "_r")
    lower = W.partitionBy(*group).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_r").agg(F.sum("n").alias("_t"))
    offsets = totals.select(*group, "_r", "_t", F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_off"), F.sum("_t").over(W.partitionBy(*group)).alias("_n"))
    # ranks that fall into a range: only those ranges are looked into value by value
    ranks = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.struct(p.alias("prob"), F.greatest(F.ceil(p * F.col("_n")), F.lit(1)).cast("long").alias("rank")))
    wanted = offsets.withColumn("_q", F.filter(ranks, lambda q: (q["rank"] > F.col("_off")) & (q["rank"] <= F.col("_off") + F.col("_t")))).filter(F.size("_q") > 0)
    wanted = wanted.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate([*group, "_r"])], "_off", "_n", "_q")
    same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*group, "_r"])]
    inner = ranged.join(wanted, reduce(and_, same)).select(*group, "_r", "value", "n", "_off", "_n", "_q")
    run = W.partitionBy(*group, "_r").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    reached = inner.withColumn("_c", F.col("_off") + F.sum("n").over(run)).withColumn("_b", F.col("_c") - F.col("n"))
    hits = F.filter("_q", lambda q: (q["rank"] > F.col("_b")) & (q["rank"] <= F.col("_c")))
    return reached.select(*group, F.col("_n").alias("n"), "value", F.explode(hits).alias("q")).select(*group, F.col("q.prob").alias("prob"), "n", "value")
