"""Ordered computations per symbol that do not make a hot symbol one task.

``numbered`` sorts the rows once, by ranges of (symbol, ts, tie) that are equally large whatever the
symbol or the day, writes them to the shared folder, and gives each row its place in its
symbol's order from one count per symbol and range.  All later steps keep that place.
``rolling`` cuts the order into blocks and lends each block the rows before and after it
that its frames reach, so a frame of fixed size never needs a whole symbol in one sort.
``running`` does the same for frames that reach back to the start: inside a block over the
rows, before it over one summary row per block.  It uses its input twice; so that chains of
steps do not read their source twice as often with every step, what is not read from one
written table already is written to the shared folder first.

All inputs have ``symbol, ts`` and a column ``tie`` that makes the order total.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.session import bounded, floor_div, stored

BLOCK = 8_192
#: Leaves of a plan (a written table and its counts) up to which it may be used twice as it is.
LEAVES = 2


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted by ``order`` and written, with ``_m``, a number that ascends in that order, and ``_p``, the range a row lies in.

    The ranges are drawn from the data and equally large, whatever values are frequent.
    """
    d = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    return d.withColumn("_p", F.shiftright("_m", 33))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``rn``, the 0-based place of a row in its symbol's order by (ts, tie); rows without a symbol are dropped."""
    d = ranged(df, "symbol", "ts", "tie")
    heads = d.groupBy("symbol", "_p").agg(F.min("_m").alias("_a"), F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy("symbol").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select("symbol", "_p", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_a")).alias("_o"))
    return d.join(bounded(heads), ["symbol", "_p"]).withColumn("rn", F.col("_m") + F.col("_o")).drop("_m", "_p", "_o")


def rolling(df: DataFrame, columns: Callable[[WindowSpec], Mapping[str, Column]], back: int = 0, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """``df`` with columns over a window ordered by ``rn`` whose frames reach at most ``back`` rows back and ``ahead`` rows on."""
    block = max(block, back + 1, ahead + 1)
    d = df if "rn" in df.columns else numbered(df)
    own = floor_div(F.col("rn"), block)
    at = F.pmod(F.col("rn"), F.lit(block))
    copies = F.filter(F.array(own, F.when(at >= block - back, own + 1) if back else F.lit(None).cast("long"), F.when((at < ahead) & (own > 0), own - 1) if ahead else F.lit(None).cast("long")), lambda x: x.isNotNull())
    cut = d.withColumn("_blk", F.explode(copies))
    w = W.partitionBy("symbol", "_blk").orderBy("rn")
    made = columns(w)
    kept = [c for c in d.columns if c not in made]
    return cut.select(*kept, "_blk", *[c.alias(n) for n, c in made.items()]).filter(F.col("_blk") == floor_div(F.col("rn"), block)).drop("_blk")


def full(fn: Callable[[Column], Column], x: Column | str, w: WindowSpec, n: int) -> Column:
    """``fn(x)`` over the last ``n`` rows, null unless all of them have a value."""
    x = F.col(x) if isinstance(x, str) else x
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(f) == n, fn(x).over(f))


def full_next(fn: Callable[[Column], Column], x: Column | str, w: WindowSpec, n: int) -> Column:
    """``fn(x)`` over the next ``n`` rows, null unless all of them have a value."""
    x = F.col(x) if isinstance(x, str) else x
    f = w.rowsBetween(1, n)
    return F.when(F.count(x).over(f) == n, fn(x).over(f))


def rolling_apply(df: DataFrame, value: str, name: str, n: int, fn: Callable[[np.ndarray], float]) -> DataFrame:
    """``df`` with ``name``: any function of the last ``n`` values, null until there are ``n`` (the way out where no built-in function will do)."""

    def each(windows: pd.Series) -> pd.Series:
        return pd.Series([fn(np.asarray(x, "float64")) if x is not None else None for x in windows], dtype="float64")

    d = rolling(df, lambda w: {"_window": F.when(F.count(value).over(w.rowsBetween(-(n - 1), 0)) == n, F.collect_list(value).over(w.rowsBetween(-(n - 1), 0)))}, back=n)
    return d.withColumn(name, F.pandas_udf(each, "double")(F.col("_window"))).drop("_window")


def ewm(df: DataFrame, columns: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Exponentially weighted means: ``name -> (column, q)``, weights q^age, normalised.

    Nulls carry no weight but age the others.  The sums run over the block and as many lent
    rows as it takes for weights to fall below 1e-16, scaled from the block's start, so the
    powers neither overflow nor depend on the length of the series.
    """
    reach = max(math.ceil(math.log(1e-16) / math.log(q)) for _, q in columns.values())
    block = max(512, reach)

    def make(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(W.unboundedPreceding, 0)
        out = {}
        for name, (c, q) in columns.items():
            p = F.pow(F.lit(1.0 / q), F.col("_age"))
            x = F.col(c)
            out[name] = F.try_divide(F.sum(x * p).over(f), F.sum(F.when(x.isNotNull(), p)).over(f))
        return out

    d = df if "rn" in df.columns else numbered(df)
    # age counts from the start of the block before: the same for a row and its lent copy only up to
    # a common factor, which the quotient cancels
    aged = d.withColumn("_age", F.pmod(F.col("rn"), F.lit(block)).cast("double"))
    own = floor_div(F.col("rn"), block)
    copies = F.filter(F.array(F.struct(own.alias("b"), F.col("_age").alias("a")), F.struct((own + 1).alias("b"), (F.col("_age") - block).alias("a"))), lambda s: s["b"] >= 0)
    cut = aged.withColumn("_s", F.explode(copies)).withColumn("_blk", F.col("_s.b")).withColumn("_age", F.col("_s.a"))
    made = make(W.partitionBy("symbol", "_blk").orderBy("rn"))
    return cut.select(*d.columns, "_blk", *[c.alias(n) for n, c in made.items()]).filter(F.col("_blk") == floor_div(F.col("rn"), block)).drop("_blk")


def running(
    df: DataFrame, sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, latest: Mapping[str, Column] | None = None, totals: Mapping[str, str] | None = None, block: int = BLOCK
) -> DataFrame:
    """Totals, maxima and last known values from a symbol's first row up to each row (null only before the first value).

    ``totals`` names, for sums, a column with the sum over the whole symbol.
    """
    sums, maxima, latest, totals = sums or {}, maxima or {}, latest or {}, totals or {}
    d = df if "rn" in df.columns else numbered(df)
    kept = [c for c in d.columns if c not in {*sums, *maxima, *latest}]
    d = d.select(*kept, *[c.alias(f"_v_{n}") for n, c in {**sums, **maxima, **latest}.items()], floor_div(F.col("rn"), block).alias("_blk"))
    if d._jdf.queryExecution().analyzed().collectLeaves().size() > LEAVES:
        d = stored(d)
    inside = W.partitionBy("symbol", "_blk").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("symbol").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    agg = [F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums] + [F.max(f"_v_{n}").alias(f"_b_{n}") for n in maxima]
    agg += [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("rn"))).alias(f"_b_{n}") for n in latest]
    blocks = d.groupBy("symbol", "_blk").agg(*agg)
    carry = [F.sum(f"_b_{n}").over(before).alias(f"_c_{n}") for n in sums] + [F.max(f"_b_{n}").over(before).alias(f"_c_{n}") for n in maxima]
    carry += [F.last(f"_b_{n}", True).over(before).alias(f"_c_{n}") for n in latest]
    carry += [F.sum(f"_b_{n}").over(W.partitionBy("symbol")).alias(f"_t_{n}") for n in totals]
    local = {n: F.sum(f"_v_{n}").over(inside) for n in sums} | {n: F.max(f"_v_{n}").over(inside) for n in maxima} | {n: F.last(f"_v_{n}", True).over(inside) for n in latest}
    out = d.select("*", *[c.alias(f"_l_{n}") for n, c in local.items()]).join(blocks.select("symbol", "_blk", *carry), ["symbol", "_blk"])
    final = {}
    for n in sums:
        final[n] = F.when(F.col(f"_l_{n}").isNull(), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in maxima:
        final[n] = F.greatest(f"_l_{n}", f"_c_{n}")
    for n in latest:
        final[n] = F.coalesce(f"_l_{n}", f"_c_{n}")
    return out.select(*[c for c in kept if c[:1] != "_"], *[c.alias(n) for n, c in final.items()], *[F.col(f"_t_{n}").alias(t) for n, t in totals.items()])


def _composed(batches: Iterator[pa.RecordBatch], no: int) -> Iterator[pa.RecordBatch]:
    """Batches (.., first, a, b) with a and b replaced by those of all steps x -> a x + b since the last row with ``first``."""
    kept = (1.0, 0.0)
    for batch in batches:
        first, a, b = (batch.column(no + j).to_numpy(zero_copy_only=False) for j in range(3))
        a, b, start = a.astype("float64"), b.astype("float64"), np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
        # in steps of 1, 2, 4, .. each row takes in the steps composed up to the row so far before it
        reach, span = np.arange(len(a)), 1
        while span < len(a) and (reach - span >= start).any():
            back = np.flatnonzero((reach - span >= start) & (reach >= span))
            b[back] += a[back] * b[back - span]
            a[back] *= a[back - span]
            span *= 2
        open_ = start < 0  # rows that go on with what the batch before left
        b[open_] += a[open_] * kept[1]
        a[open_] *= kept[0]
        if len(a):
            kept = (float(a[-1]), float(b[-1]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:no], batch.column(no), pa.array(a), pa.array(b)], names=batch.schema.names)


def affine(df: DataFrame, name: str, a: Column, b: Column, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name`` = a times its value in the row before plus b, beginning from 0 in each symbol; null a or b leave the value as it was.

    Such steps compose to steps of the same kind: each block of rows is composed by itself, then one step per block.
    """
    d = df if "rn" in df.columns else numbered(df)
    whole = a.isNotNull() & b.isNotNull()
    cols = [c for c in d.columns if c != name]
    at = len(cols) + 1
    first = F.pmod(F.col("rn"), F.lit(block)) == 0
    rows = d.select(*cols, floor_div(F.col("rn"), block).alias("_blk"), first.alias("_f"), F.when(whole, a.cast("double")).otherwise(1.0).alias("_a"), F.when(whole, b.cast("double")).otherwise(0.0).alias("_b"))
    rows = rows.repartition("symbol", "_blk").sortWithinPartitions("symbol", "_blk", "rn")
    rows = rows.mapInArrow(lambda batches: _composed(batches, at), rows.schema)
    ends = rows.groupBy("symbol", "_blk").agg(F.max_by(F.struct("_a", "_b"), "rn").alias("_e")).select("symbol", "_blk", (F.col("_blk") == 0).alias("_f"), "_e._a", "_e._b")
    ends = ends.repartition("symbol").sortWithinPartitions("symbol", "_blk")
    ends = ends.mapInArrow(lambda batches: _composed(batches, 2), ends.schema)
    before = ends.select("symbol", (F.col("_blk") + 1).alias("_blk"), F.col("_b").alias("_x"))
    got = rows.join(before, ["symbol", "_blk"], "left")
    return got.select(*cols, (F.col("_a") * F.coalesce("_x", F.lit(0.0)) + F.col("_b")).alias(name))
