"""Irregular readings onto a regular grid (problem 6).

Local linear regression with a compact (Epanechnikov) kernel.  Because the kernel is
zero beyond its bandwidth, a reading only reaches the few grid points near it; each
reading is sent to those points and everything a local fit needs is five weighted sums,
so the fit is an ordinary partial aggregation and no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.session import epoch_us, floor_div, number

DAY_S = 86_400
MIN_SUPPORT = 2.0


def regular_grid(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    volume: str,
    step_s: int = 60,
    bandwidth_s: int = 180,
    min_support: float = MIN_SUPPORT,
) -> DataFrame:
    """One row per entity and grid step between its first and last usable reading of each day.

    Usable: key and time not null, value not null, not NaN and above 0.  Columns: ``key``,
    ``step`` (epoch seconds div ``step_s``), ``readings`` and ``volume`` of the step itself,
    ``value`` fitted at the middle of the step, ``support`` (effective number of readings,
    (sum w)^2 / sum w^2) and ``mark``: ``observed``, ``filled`` or ``missing``.  A step
    whose effective support is below ``min_support`` is ``missing`` with a null value unless
    it has readings of its own, whose local mean is then given.  Where all nearby readings
    share one instant the slope is undefined and the local mean is given.  Repeated rows
    weigh as often as they occur; null volumes count 0; an empty table gives no rows.
    """
    us = step_s * 1_000_000
    half = us // 2
    h = float(bandwidth_s)
    usable = (
        df.select(F.col(key).alias("_k"), epoch_us(F.col(ts)).alias("_t"), number(value).alias("_v"), number(volume).alias("_q"))
        .filter("_k is not null and _t is not null and _v > 0")
        .withColumn("_m", floor_div(F.col("_t"), us))
    )
    h_us = int(bandwidth_s * 1_000_000)
    near = usable.withColumn(
        "_g", F.explode(F.sequence(floor_div(F.col("_t") - h_us - half, us), floor_div(F.col("_t") + h_us - half, us) + 1))
    ).withColumn("_x", (F.col("_t") - (F.col("_g") * us + half)) / F.lit(1e6))
    near = near.withColumn("_w", F.lit(1.0) - (F.col("_x") / h) * (F.col("_x") / h)).filter("_w > 0 or _g = _m")
    w, x, v = F.greatest(F.col("_w"), F.lit(0.0)), F.col("_x"), F.col("_v")
    own = F.col("_g") == F.col("_m")
    sums = near.groupBy("_k", "_g").agg(
        F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(w * w).alias("ww"),
        F.sum(w * v).alias("t0"), F.sum(w * x * v).alias("t1"), F.count_if(own).alias("n"),
        F.sum(F.when(own, F.coalesce("_q", F.lit(0.0)))).alias("q"), F.avg(F.when(own, v)).alias("mean"),
    )
    per_day = DAY_S // step_s
    steps = (
        usable.groupBy("_k", floor_div(F.col("_m"), per_day).alias("_d"))
        .agg(F.min("_m").alias("_a"), F.max("_m").alias("_z"))
        .select("_k", F.explode(F.sequence("_a", "_z")).alias("_g"))
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    support = F.coalesce(F.try_divide(F.col("s0") * F.col("s0"), F.col("ww")), F.lit(0.0))
    local = F.when(det > 1e-9 * F.col("s0") * F.col("s0") * h * h, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.try_divide("t0", "s0"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    value = F.when(support >= min_support, local).otherwise(F.col("mean"))
    return steps.join(sums, ["_k", "_g"], "left").select(
        F.col("_k").alias(key),
        F.col("_g").alias("step"),
        n.alias("readings"),
        F.coalesce("q", F.lit(0.0)).alias("volume"),
        value.alias("value"),
        support.alias("support"),
        F.when(n > 0, "observed").when(value.isNotNull(), "filled").otherwise("missing").alias("mark"),
    )
