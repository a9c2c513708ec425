"""Implausible readings: impossible values, brief excursions, frozen values (problem 3).

Readings that are impossible by themselves are seen in the row.  For the others every source
is judged by its own normal behaviour, in two passes over its readings in order of time:

1. quantile sketches - counts in logarithmic bins, which add up over blocks of rows and partitions - of
   its changes from bar to bar and of its sizes, both by hour of day, and counts of its runs of equal values;
2. from the merged sketches each source gets expanded interquartile fences, of all hours and of each hour, and its
   longest ordinary run; each block of rows is held against those of its source.

Blocks have equally many rows, with a few lent from their neighbours, so a hot source or a burst
is spread over tasks; runs that reach over the edge of a block are put together from one row
per block.  What a block must know travels with its rows, so nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from barwise.functions.frames import numbered
from barwise.session import epoch_us, floor_div, number, stored

BLOCK, HALO = 65_536, 1_024  # rows of a block, and rows lent to it on each side
HALF = 5  # neighbours on each side whose median is the local level
GAMMA = 1.02  # ratio of neighbouring sketch bins: quantiles are within 1 %
ZERO = 2**20  # added to the bins of values above 0, so that those below 0 can have the same with a minus
LONGEST = 3  # bars a brief excursion may last
LEAST_READINGS = 8
HOUR_READINGS = 30  # from which on an hour has fences of its own
#: Runs from LONG_RUN on are frozen if more than twice as long as the next shorter one; shorter runs only if chance,
#: with equal neighbours as often as in the shorter runs, makes one in so few sources.
LONG_RUN, RARE = 10, 1e-4


@dataclass(frozen=True)
class Fences:
    """How far the fences are expanded beyond the quartiles, in interquartile ranges: of all readings and of those of the hour.

    ``change``: fields whose departure from the local level is held against their changes from bar to bar.  ``size``: fields
    whose logarithm is held against that of other readings, upwards.
    """

    change: Mapping[str, tuple[float, float]] = field(default_factory=lambda: {"close": (9.3, 4.0), "position": (18.0, 8.0)})
    size: Mapping[str, tuple[float, float]] = field(default_factory=lambda: {"volume": (3.4, 2.6)})

    @property
    def fields(self) -> list[str]:
        return [*self.change, *self.size]


SKETCH = "symbol string, field string, kind string, hour int, b int, a double, n long, _blk long"


def _local_median(y: np.ndarray) -> np.ndarray:
    """Median of up to HALF neighbours on each side and the value itself."""
    w, n = 2 * HALF + 1, len(y)
    out = np.empty(n)
    if n >= w:
        out[HALF : n - HALF] = np.median(np.lib.stride_tricks.sliding_window_view(y, w), axis=1)
    for i in [*range(min(HALF, n)), *range(max(n - HALF, min(HALF, n)), n)]:
        out[i] = np.median(y[max(0, i - HALF) : i + HALF + 1])
    return out


def _runs(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the runs of equal values."""
    start = np.flatnonzero(np.r_[True, y[1:] != y[:-1]]) if len(y) else np.array([], int)
    return start, np.diff(np.r_[start, len(y)])


def _bins(values: np.ndarray) -> np.ndarray:
    """Sketch bins, in the order of the values."""
    out, some = np.zeros(len(values), "int64"), values != 0
    out[some] = np.sign(values[some]) * (ZERO + np.ceil(np.log(np.abs(values[some])) / np.log(GAMMA)))
    return out


def _value(b: str) -> Column:
    """The value a sketch bin stands for."""
    return F.when(F.col(b) == 0, 0.0).otherwise(F.signum(b) * F.exp((F.abs(b) - ZERO) * F.lit(float(np.log(GAMMA)))))


class _Bars:
    """A block's bars with a usable reading of one field: ``y`` in order of time, ``own`` those that are not lent."""

    def __init__(self, t: pa.Table, name: str) -> None:
        ts, order = t.column("ts").to_numpy(), np.argsort(t.column("rn").to_numpy(), kind="stable")
        self.v = np.asarray(t.column(name).to_numpy(), "float64")[order]  # null becomes NaN
        self.ident, self.own_row = t.column("tie").to_numpy()[order], t.column("own").to_numpy()[order].astype(bool)
        ts = ts[order]
        start = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])  # copies of a reading share its time
        self.bar = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(ts)]))
        pick = np.minimum.reduceat(np.where(np.isnan(self.v), len(ts), np.arange(len(ts))), start)
        self.at = np.flatnonzero(pick < len(ts))
        self.y = self.v[pick[self.at]]
        self.own = self.own_row[start[self.at]]
        self.hour = (ts[start[self.at]] // 3_600_000_000 % 24).astype("int64")

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """Ids of the own rows that carry the chosen readings, copies included."""
        value = np.full(self.bar[-1] + 1, np.nan)
        value[self.at[chosen]] = self.y[chosen]
        return self.ident[(self.v == value[self.bar]) & self.own_row]


def _sketches(fences: Fences) -> Callable[[pa.Table], pa.Table]:
    def scan(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        blk = t.column("_blk")[0].as_py()

        def add(name: str, kind: str, hour: np.ndarray, b: np.ndarray) -> None:
            (h, b), n = np.unique(np.stack([hour, b]), axis=1, return_counts=True)
            out.extend((name, kind, int(i), int(j), 0.0, int(k), blk) for i, j, k in zip(h, b, n))

        for name in fences.fields:
            bars = _Bars(t, name)
            y, own = bars.y, bars.own
            if name in fences.change:
                add(name, "change", bars.hour[1:][own[1:]], _bins(np.diff(y))[own[1:]])
            else:
                ok = own & (y > 0)
                add(name, "size", bars.hour[ok], _bins(y[ok]))
            start, length = _runs(y[own])
            inner = length[1:-1]
            add(name, "run", np.full(len(inner), -1), inner)
            edge = np.unique(np.r_[0, len(start) - 1]) if len(start) else []
            # the first and the last run may go on in the neighbouring blocks
            out.extend((name, "edge", int(i > 0), int(length[i]), float(y[own][start[i]]), 1, blk) for i in edge)
        cols = list(zip(*out)) if out else [()] * 7
        src = pa.repeat(t.column("symbol")[0], len(out)) if out else pa.array([], "string")
        kinds = ("string", "string", "int32", "int32", "float64", "int64", "int64")
        return pa.table([src, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["symbol", "field", "kind", "hour", "b", "a", "n", "_blk"])

    return scan


def _brief(out: np.ndarray) -> np.ndarray:
    """The marked readings that stand in marked runs of at most LONGEST."""
    start, length = _runs(out)
    return np.flatnonzero(out & (np.repeat(length, length) <= LONGEST))


def _judge(fences: Fences) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def judge(t: pa.Table, known: pa.Table) -> pa.Table:
        ids, names = [np.array([], "int64")], []
        told = {(r["field"], r["kind"], r["hour"]): r for r in known.to_pylist()}
        for name in fences.fields if t.num_rows else []:
            bars = _Bars(t, name)
            hits = [np.array([], "int64")]
            if (name, "fence", -1) in told and len(bars.y):
                with np.errstate(divide="ignore"):
                    x = bars.y - _local_median(bars.y) if name in fences.change else np.log(np.maximum(bars.y, 0.0))
                fence = lambda h, name=name: told.get((name, "fence", h), {"lo": np.inf, "a": -np.inf})
                lo, hi = (np.array([fence(h)[c] for h in range(24)])[bars.hour] for c in ("lo", "a"))
                hits.append(_brief(((x > fence(-1)["a"]) & (x > hi)) | ((x < fence(-1)["lo"]) & (x < lo))))
            if (name, "frozen", -1) in told:
                own = np.flatnonzero(bars.own)
                start, length = _runs(bars.y[own])
                whole, first = length.copy(), np.ones(len(length), bool)
                for i in {0, len(start) - 1} if len(start) else ():
                    edge = told[name, "edge", int(i > 0)]
                    whole[i], first[i] = int(edge["a"]), bool(edge["n"])
                for i in np.flatnonzero(whole >= told[name, "frozen", -1]["a"]):
                    hits.append(own[start[i] + int(first[i]) : start[i] + length[i]])
            got = bars.rows(np.unique(np.concatenate(hits))) if len(bars.y) else ids[0]
            ids.append(got)
            names += [name] * len(got)
        return pa.table([pa.array(np.concatenate(ids)), pa.array(names, "string")], names=["id", "field"])

    return judge


def _quantiles(sketch: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles (as bin numbers) of merged sketches: the first bin whose running count reaches the share."""
    w = W.partitionBy(*keys).orderBy("b")
    run = sketch.select(*keys, "b", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("c"), F.sum("n").over(W.partitionBy(*keys)).alias("total"))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("c") >= p * F.col("total"), F.col("b"))).alias(name) for name, p in probs.items()], F.max("total").alias("total"))


def _fence(found: DataFrame, fences: Fences) -> DataFrame:
    """``symbol, field, kind 'fence', hour (-1: all), lo, a``: a departure from the local level or the logarithm of a size below ``lo`` or above ``a`` is out of bounds."""
    keys = ["symbol", "field", "kind", "hour"]
    hourly = found.filter("kind in ('change', 'size')").groupBy(*keys, "b").agg(F.sum("n").alias("n"))
    both = hourly.unionByName(hourly.groupBy("symbol", "field", "kind", "b").agg(F.sum("n").alias("n")).withColumn("hour", F.lit(-1)))
    q = _quantiles(both, keys, {"q1": 0.25, "q3": 0.75})
    # where most readings do not change, or all alike, there is no range: the size of the changes there are takes its place
    moved = _quantiles(both.filter("kind = 'change' and b <> 0"), keys, {"m1": 0.25, "m3": 0.75}).drop("total")
    least = F.when(F.col("hour") >= 0, HOUR_READINGS).when(F.col("kind") == "size", LEAST_READINGS).otherwise(LEAST_READINGS - 1)
    q = q.join(moved, keys, "left").filter(F.col("total") >= least)
    wide = lambda no: F.create_map(*[F.lit(x) for f, m in {**fences.change, **fences.size}.items() for x in (f, float(m[no]))])[F.col("field")]
    times = F.when(F.col("hour") < 0, wide(0)).otherwise(wide(1))
    change = F.col("kind") == "change"
    low, high = (F.when(change, _value(c)).otherwise(F.ln(_value(c))) for c in ("q1", "q3"))
    size = F.greatest(F.abs(_value("m1")), F.abs(_value("m3")))
    span = F.when(change & (high == low), size).when(change, high - low).otherwise(F.greatest(high - low, F.when(F.col("hour") < 0, 0.05).otherwise(0.2)))
    lo = F.when(change, low - times * span).otherwise(F.lit(float("-inf")))
    return q.select("symbol", "field", F.lit("fence").alias("kind"), "hour", lo.alias("lo"), (high + times * span).alias("a"), F.lit(0).cast("long").alias("n")).filter("a is not null")


def _frozen(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frozen, edges): from which length on runs of a source are frozen, and per block and edge (``hour`` 0 first, 1 last) the
    whole length ``a`` of the run that stands there and whether it begins there (``n``)."""
    keys = ["symbol", "field"]
    place = W.partitionBy(*keys).orderBy("_blk", "hour")
    piece = found.filter("kind = 'edge'")
    same = (F.lag("a").over(place) == F.col("a")) & (F.lag("_blk").over(place) < F.col("_blk"))
    piece = piece.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("long")).withColumn("run", F.sum("new").over(place.rowsBetween(W.unboundedPreceding, 0)))
    piece = piece.withColumn("whole", F.sum("b").over(W.partitionBy(*keys, "run")))
    lens = found.filter("kind = 'run'").select(*keys, F.col("b").cast("long").alias("b"), "n").unionByName(piece.filter("new = 1").select(*keys, F.col("whole").alias("b"), F.lit(1).cast("long").alias("n")))
    lens = lens.groupBy(*keys, "b").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys).orderBy("b")
    shorter = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lens = lens.withColumn("below", F.coalesce(F.lag("b").over(w), F.lit(1))).withColumn("bars", shorter(F.col("b") * F.col("n"))).withColumn("equal", shorter((F.col("b") - 1) * F.col("n")))
    chance = F.col("bars") * F.pow((F.col("equal") + 1) / (F.col("bars") + 1), F.col("b") - 1)
    least = lens.filter((F.col("b") > 2 * F.col("below")) & ((F.col("b") >= LONG_RUN) | ((F.col("bars") > 0) & (chance < RARE)))).groupBy(*keys).agg(F.min("b").cast("double").alias("a"))
    frozen = least.select(*keys, F.lit("frozen").alias("kind"), F.lit(-1).alias("hour"), F.lit(None).cast("double").alias("lo"), "a", F.lit(0).cast("long").alias("n"))
    edges = piece.select(*keys, "kind", "hour", F.lit(None).cast("double").alias("lo"), F.col("whole").cast("double").alias("a"), F.col("new").alias("n"), "_blk")
    return frozen, edges


def implausible(df: DataFrame, src: str = "symbol", ident: str = "bar_id", ts: str = "bob", fences: Fences | None = None) -> DataFrame:
    """``ident, field``: the readings that cannot be true, each once.

    (a) impossible: close not above 0 or outside its row's low and high (where these are
    known), other fields below 0, infinite values; (b) brief excursions of at most three bars
    beyond the source's fences, after which the old level returns; (c) readings after the
    first of a run of equal values more than twice as long as any ordinary run of the source.

    Rows of one source and time are copies of one bar: they are judged together and each
    copy with the flagged value is given.  Null and NaN are never flagged and stand in no
    one's neighbourhood (neighbours are looked for up to ``HALO`` rows beyond the block); rows with a null source or time
    are only judged by (a); sources with fewer than eight readings only by (a) and (c); an empty table gives no rows.
    """
    fences = fences or Fences()
    names = fences.fields
    eps = lambda v: 1e-9 * F.abs(v)

    def bad(f: str) -> Column:
        v, inf = F.col(f), F.abs(F.col(f)) == float("inf")
        if f != "close":
            return (v < 0) | inf
        return (v <= 0) | inf | F.coalesce(v < F.col("low") - eps(v), F.lit(False)) | F.coalesce(v > F.col("high") + eps(v), F.lit(False))

    rows = df.select(F.col(src).cast("string").alias("symbol"), epoch_us(F.col(ts)).alias("ts"), F.col(ident).cast("long").alias("tie"), *[number(f).alias(f) for f in ("low", "high", *names)])
    wrong = F.filter(F.array(*[F.when(bad(f), F.lit(f)) for f in names]), lambda f: f.isNotNull())
    impossible = rows.select(F.col("tie").alias("id"), F.explode(wrong).alias("field"))
    good = rows.filter("symbol is not null and ts is not null").select("symbol", "ts", "tie", *[F.when(~bad(f), F.col(f)).alias(f) for f in names])
    d = numbered(good.filter(F.coalesce(*names).isNotNull()))
    own, at = floor_div(F.col("rn"), BLOCK), F.pmod(F.col("rn"), F.lit(BLOCK))
    copies = F.filter(F.array(own, F.when(at >= BLOCK - HALO, own + 1), F.when((at < HALO) & (own > 0), own - 1)), lambda x: x.isNotNull())
    cut = d.withColumn("_blk", F.explode(copies)).select("symbol", "_blk", "ts", "tie", "rn", (F.col("_blk") == own).alias("own"), *names)
    key = ["symbol", "_blk"]
    found = stored(cut.groupBy(*key).applyInArrow(_sketches(fences), SKETCH))
    frozen, edges = _frozen(found)
    blocks = found.select(*key).distinct()
    known = _fence(found, fences).unionByName(frozen).join(blocks, "symbol").unionByName(edges)
    judged = cut.groupBy(*key).cogroup(known.select(*key, "field", "kind", "hour", "lo", "a", "n").groupBy(*key)).applyInArrow(_judge(fences), "id long, field string")
    return impossible.unionByName(judged).distinct().select(F.col("id").alias(ident), "field")
