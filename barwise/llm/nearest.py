"""Matching records of two tables by nearest time (problem 4).

Both tables are repartitioned by entity and stretch of time, sorted inside each
partition, and read by a two-pointer merge over the sorted stream that holds the last
right-hand record and the left-hand records still waiting for the next one.  Stretches
keep a hot entity from becoming one task; right-hand records within the tolerance of a
stretch's edge are sent to both sides of it, so no stretch needs to look at another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.session import epoch_us, floor_div

_FAR = np.iinfo("int64").max


class _Merge:
    """Streams (key, stretch, time, side, id) in order; side 0 is right, 1 is left."""

    def __init__(self, tolerance: int) -> None:
        self.tol = tolerance
        self.rest: pa.Table | None = None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield self._step(b, False)
        if self.rest is not None:
            yield self._step(None, True)

    def _step(self, b: pa.RecordBatch | None, last: bool) -> pa.RecordBatch:
        parts = ([self.rest] if self.rest is not None else []) + ([pa.Table.from_batches([b])] if b is not None else [])
        t = pa.concat_tables(parts).combine_chunks()
        n = t.num_rows
        num = lambda c: t.column(c).to_numpy()
        stretch, time, side, ident = num("b"), num("t"), num("side"), num("id")
        same = np.zeros(n, bool)
        if n > 1:
            k = t.column("k").combine_chunks()
            same[1:] = pc.equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) & (stretch[1:] == stretch[:-1])
        group = np.cumsum(~same)
        # of right records at one instant only the first (smallest id) is kept
        right = side == 0
        right[1:] &= ~(same[1:] & (side[:-1] == 0) & (time[1:] == time[:-1]))
        at = np.arange(n)
        before = np.maximum.accumulate(np.where(right, at, -1))
        after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
        before_ok = (before >= 0) & (group[np.maximum(before, 0)] == group)
        after_ok = (after < n) & (group[np.minimum(after, n - 1)] == group)
        left = side == 1
        waiting = left & ~after_ok & (group == group[-1]) & (time + self.tol >= time[-1])
        if last:
            waiting[:] = False
        d0 = np.where(before_ok, time - time[np.maximum(before, 0)], _FAR)
        d1 = np.where(after_ok, time[np.minimum(after, n - 1)] - time, _FAR)
        pick = np.where(d0 <= d1, np.maximum(before, 0), np.minimum(after, n - 1))
        dist = np.minimum(d0, d1)
        done = left & ~waiting
        hit = dist[done] <= self.tol
        out = pa.RecordBatch.from_arrays(
            [pa.array(ident[done]), pa.array(ident[pick[done]], mask=~hit), pa.array(np.where(hit, dist[done], 0), mask=~hit)], names=["l", "r", "d"]
        )
        if last:
            self.rest = None
        else:
            keep = waiting.copy()
            if group[before[-1]] == group[-1] and before[-1] >= 0:
                keep[before[-1]] = True
            self.rest = t.filter(pa.array(keep)) if keep.any() else None
        return out


def nearest_in_time(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, left_id: str, right_id: str, tolerance_s: int = 300, stretch_s: int = 86_400
) -> DataFrame:
    """``left_id, right_id, distance_us``: each left record with its nearest right record in time.

    Only records of the same ``key`` are compared; the smallest absolute distance wins if it
    is at most ``tolerance_s``, else both other columns are null.  Of right records at one
    instant the smallest id is taken; of two equally far ones the earlier.  Left records with
    a null key or time are left out, right ones with a null key or time match nothing;
    repeated left records are matched each by itself; ids are 64-bit and unique per table.
    An empty right table leaves every left record unmatched.
    """
    span, tol = stretch_s * 1_000_000, tolerance_s * 1_000_000
    side = lambda df, ts, ident, no: df.select(F.col(key).alias("k"), epoch_us(F.col(ts)).alias("t"), F.lit(no).cast("tinyint").alias("side"), F.col(ident).cast("long").alias("id")).filter("k is not null and t is not null")
    near = side(right, right_ts, right_id, 0).withColumn("b", F.explode(F.sequence(floor_div(F.col("t") - tol, span), floor_div(F.col("t") + tol, span))))
    own = side(left, left_ts, left_id, 1).withColumn("b", floor_div(F.col("t"), span))
    rows = own.unionByName(near).repartition("k", "b").sortWithinPartitions("k", "b", "t", "side", "id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _Merge(tol)(batches)

    out = rows.select("k", "b", "t", "side", "id").mapInArrow(merge, "l long, r long, d long")
    return out.select(F.col("l").alias(left_id), F.col("r").alias(right_id if right_id != left_id else f"{right_id}_right"), F.col("d").alias("distance_us"))
