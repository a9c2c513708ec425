"""Entropies, distances and dependence measures.

Pairwise measures take long input (``key, x, y``) and reduce it in one aggregation per
measure; measures over all pairs of columns unpivot once and join on the row, so the work
is rows times pairs of columns and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.operators.quantiles import mean_ranks
from barwise.session import bounded


def shannon(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, entropy``: -sum p log2 p over the characters of a text; empty and null texts give no row."""
    c = df.select(ident, F.explode(F.split(F.col(text), "")).alias("_c")).filter("_c <> ''").groupBy(ident, "_c").agg(F.count(F.lit(1)).alias("_n"))
    return _entropy(c, ident, F.sum("_n").over(W.partitionBy(ident)))


def word_shannon(df: DataFrame, ident: str, text: str, k: int) -> DataFrame:
    """``ident, entropy`` over overlapping k-grams with p = count / length of the text (as the reference has it, so that the p do not sum to 1)."""
    n = F.char_length(text)
    at = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1)))
    g = df.select(ident, F.col(text).alias("_t"), n.alias("_len"), F.explode(at).alias("_i")).select(ident, "_len", F.substring("_t", F.col("_i"), F.lit(k)).alias("_c"))
    return _entropy(g.groupBy(ident, "_c", "_len").agg(F.count(F.lit(1)).alias("_n")), ident, F.col("_len"))


def _entropy(counts: DataFrame, ident: str, total: Column) -> DataFrame:
    p = counts.withColumn("_p", F.col("_n") / total)
    return p.groupBy(ident).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def lempel_ziv(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, entropy``: number of distinct phrases of the incremental parsing over the length; a trailing repeated phrase is not counted.

    One pass over each text in Arrow batches; a text never leaves its task.
    """
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                seen: set[str] = set()
                phrase = ""
                for c in t or "":
                    phrase += c
                    if phrase not in seen:
                        seen.add(phrase)
                        phrase = ""
                out.append(len(seen) / len(t) if t else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, "float64")], names=[ident, "entropy"])

    return df.select(ident, text).mapInArrow(run, f"{ident} {df.schema[ident].dataType.simpleString()}, entropy double").filter("entropy is not null")


def distances(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``x, y``: angular, absolute and squared angular distance, L1, L2 and L-infinity, cosine distance."""
    x, y = F.col("x"), F.col("y")
    g = df.filter("x is not null and y is not null").groupBy(*by).agg(
        F.corr("x", "y").alias("r"), F.sum(F.abs(x - y)).alias("manhattan"), F.sqrt(F.sum((x - y) * (x - y))).alias("euclidean"), F.max(F.abs(x - y)).alias("chebyshev"),
        F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"),
    )
    r, root = F.col("r"), lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return g.select(
        *by, root((1 - r) / 2).alias("angular"), root((1 - F.abs(r)) / 2).alias("abs_angular"), root((1 - r * r) / 2).alias("sq_angular"),
        "manhattan", "euclidean", "chebyshev", (1 - F.try_divide("_xy", F.sqrt("_xx") * F.sqrt("_yy"))).alias("cosine"),
    )


def spearman(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, spearman``: half of 1 minus the correlation of mean ranks."""
    d = df.filter("x is not null and y is not null").select(*by, "x", "y")
    d = mean_ranks(mean_ranks(d, "x", by, "rx"), "y", by, "ry")
    return d.groupBy(*by).agg(((1 - F.corr("rx", "ry")) / 2).alias("spearman"))


def distance_correlation(df: DataFrame, ident: str) -> DataFrame:
    """``distance``: 1 minus the distance correlation of ``x, y`` over ``ident, x, y``.

    Quadratic in its rows by definition; meant for a bounded sample, and refused beyond
    ``MAX_DCOR_ROWS`` rows.  Row means come from sorted prefix sums, and the sum of products of
    distances from one pass over pairs of row blocks.
    """
    if df.limit(MAX_DCOR_ROWS + 1).count() > MAX_DCOR_ROWS:
        raise ValueError(f"distance correlation is for at most {MAX_DCOR_ROWS} rows")
    d = df.select(F.col(ident).alias("i"), "x", "y").filter("x is not null and y is not null")
    all_rows = d.agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("all"))
    pairs = d.join(F.broadcast(all_rows), F.lit(True)).withColumn("o", F.explode("all")).select("i", F.col("o.i").alias("j"), F.abs(F.col("x") - F.col("o.x")).alias("a"), F.abs(F.col("y") - F.col("o.y")).alias("b"))
    rows = pairs.groupBy("i").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    s = pairs.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.count(F.lit(1)).alias("nn"))
    m = rows.agg(F.sum(F.col("ma") * F.col("mb")).alias("mab"), F.sum(F.col("ma") * F.col("ma")).alias("maa"), F.sum(F.col("mb") * F.col("mb")).alias("mbb"), F.avg("ma").alias("ga"), F.avg("mb").alias("gb"), F.count(F.lit(1)).alias("n"))
    t = s.join(m, F.lit(True))

    def cov(xy: str, mxy: str, gx: str, gy: str) -> Column:
        return F.col(xy) / F.col("nn") - 2 * F.col(mxy) / F.col("n") + F.col(gx) * F.col(gy)

    return t.select((1 - F.try_divide(F.sqrt(cov("ab", "mab", "ga", "gb")), F.sqrt(F.sqrt(cov("aa", "maa", "ga", "ga")) * F.sqrt(cov("bb", "mbb", "gb", "gb"))))).alias("distance"))


MAX_DCOR_ROWS = 5_000


def kl_js(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, kl, js``: sum x ln(x / y) and the mean of both directions, over the cells where both are above 0."""
    x, y = F.col("x"), F.col("y")
    d = df.filter("x > 0 and y > 0").groupBy(*by).agg(F.sum(x * F.ln(x / y)).alias("kl"), F.sum(y * F.ln(y / x)).alias("_lk"))
    return d.select(*by, "kl", ((F.col("kl") + F.col("_lk")) / 2).alias("js"))


def optimal_bins(n: Column, r: Column) -> Column:
    """Number of histogram bins for ``n`` pairs of correlation ``r``; null where the formula gives none."""
    k = ((F.log2(n) + 1) * (1 - 2 * F.abs(r))).cast("int")
    return F.when(k > 0, k)


def _binned(df: DataFrame, by: list[str], bins: int) -> DataFrame:
    d = df.filter("x is not null and y is not null")
    edge = d.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, a, z: F.least(F.floor(F.try_divide(F.col(v) - F.col(a), F.col(z) - F.col(a)) * bins), F.lit(bins - 1)).cast("int")
    return d.join(bounded(edge), by).groupBy(*by, cell("x", "x0", "x1").alias("i"), cell("y", "y0", "y1").alias("j")).agg(F.count(F.lit(1)).alias("c"))


def information(df: DataFrame, by: list[str], bins: int) -> DataFrame:
    """``by, mutual, variation``: 1 - I / min(Hx, Hy) and (Hx + Hy - 2 I) / (Hx + Hy - I) from equal-width 2-D histograms."""
    c = _binned(df, by, bins)
    total = F.sum("c").over(W.partitionBy(*by))
    p = c.select(*by, "i", "j", (F.col("c") / total).alias("p"))
    px, py = F.sum("p").over(W.partitionBy(*by, "i")), F.sum("p").over(W.partitionBy(*by, "j"))
    joint = p.select(*by, "i", "j", "p", px.alias("px"), py.alias("py"))
    mi = joint.groupBy(*by).agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))
    h = lambda k, name: p.groupBy(*by, k).agg(F.sum("p").alias("q")).groupBy(*by).agg((-F.sum(F.col("q") * F.ln("q"))).alias(name))
    t = mi.join(h("i", "hx"), by).join(h("j", "hy"), by)
    both = F.col("hx") + F.col("hy")
    return t.select(*by, (1 - F.try_divide("mi", F.least("hx", "hy"))).alias("mutual"), F.try_divide(both - 2 * F.col("mi"), both - F.col("mi")).alias("variation"))


def histogram_distance(df: DataFrame, by: list[str], width: float) -> DataFrame:
    """``by, js``: symmetrised Kullback-Leibler divergence of the densities of x and y in bins of ``width``; bins empty for either are left out."""
    low = df.groupBy(*by).agg(F.least(F.min("x"), F.min("y")).alias("lo"), F.count("x").alias("nx"), F.count("y").alias("ny"))
    d = df.join(bounded(low), by)
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("x").alias("v")), F.struct(F.lit(1).alias("s"), F.col("y").alias("v")))).alias("e")
    cells = d.select(*by, "lo", "nx", "ny", pairs).filter("e.v is not null").groupBy(*by, "nx", "ny", F.floor((F.col("e.v") - F.col("lo")) / width).alias("k")).agg(
        F.count_if(F.col("e.s") == 0).alias("cx"), F.count_if(F.col("e.s") == 1).alias("cy"))
    return kl_js(cells.select(*by, (F.try_divide("cx", "nx") / width).alias("x"), (F.try_divide("cy", "ny") / width).alias("y")), by).select(*by, "js")


def mixed(a: Column, b: Column, theta: float) -> Column:
    """(1 - theta) a + theta b."""
    return a * (1 - theta) + b * theta


def column_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, x, y``: the values of every pair of columns (a before b), row by row."""
    pairs = [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(p).cast("double").alias("x"), F.col(q).cast("double").alias("y")) for k, p in enumerate(columns) for q in columns[k + 1 :]]
    return df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")


def matrix(pairs: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """``a, b, value`` for all ordered pairs: symmetric, 0 on the diagonal."""
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value)
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 0.0) for c in columns], f"a string, b string, {value} double")
    return pairs.select("a", "b", value).unionByName(flipped).unionByName(diagonal)




def pair_metric(pairs: DataFrame, name: str, metric: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """``a, b, name``: any function of the two columns of every pair of :func:`column_pairs`, rows with a null or NaN left out.

    The function sees both columns whole, so that each pair is held in one task; measures of this module that aggregate do not need it.
    """

    def whole(x: pd.Series, y: pd.Series) -> float:
        ok = x.notna() & y.notna()
        return float(metric(x[ok].to_numpy(), y[ok].to_numpy()))

    return pairs.groupBy("a", "b").agg(F.pandas_udf(whole, "double")("x", "y").alias(name))
