"""Aggregates over symbols at a time, binning, transition tables, clustering and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions.frames import rolling, running
from barwise.operators.quantiles import quantiles
from barwise.session import bounded, checkpointed


def by_clock(df: DataFrame, unit: str, rate: str = "rate") -> DataFrame:
    """``unit, mean_volume, mean_abs_rate`` pooled over symbols; ``unit`` is ``hour`` or ``weekday`` (Monday 0)."""
    k = (F.hour if unit == "hour" else F.weekday)("ts").alias(unit)
    return df.groupBy(k).agg(F.avg("volume").alias("mean_volume"), F.avg(F.abs(F.col(rate))).alias("mean_abs_rate"))


def dense_ranks(df: DataFrame, value: str, at: str = "ts") -> DataFrame:
    """``df`` with ``rank``: dense rank of the value among all rows of a time."""
    return df.withColumn("rank", F.dense_rank().over(W.partitionBy(at).orderBy(value)))


def blocked_product(left: DataFrame, right: DataFrame, blocks: int = 16) -> DataFrame:
    """All pairs of rows of two tables without a column in common, block against block: no side is gathered, each is sent out ``blocks`` times."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int")
    a, b = left.withColumn("_l", block(left)).withColumn("_r", every), right.withColumn("_r", block(right)).withColumn("_l", every)
    return a.join(b, ["_l", "_r"]).drop("_l", "_r")


def rank_heatmap(df: DataFrame, a: str, b: str, clip: float = 0.99) -> DataFrame:
    """``a, b, share``: for each rank of ``a`` the share of each rank of ``b``, missing pairs 0, clipped at a quantile of all cells.

    The grid is a product of two rank domains, each as large as one cross-section.
    """
    counts = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    ids = lambda c: counts.select(c).distinct()
    grid = blocked_product(ids(a), ids(b))
    cells = grid.join(counts, [a, b], "left").withColumn("share", F.coalesce("c", F.lit(0)) / F.sum("c").over(W.partitionBy(a)))
    top = cells.agg(F.percentile("share", F.lit(clip)).alias("_top"))
    return cells.join(F.broadcast(top), F.lit(True)).select(a, b, F.least("share", "_top").alias("share"))


def quantile_bins(df: DataFrame, value: str, by: list[str], bins: int) -> DataFrame:
    """``df`` with ``bin`` 0 .. bins - 1: how many inner exact quantiles of the group lie below the value."""
    q = quantiles(df, value, by, [k / bins for k in range(1, bins)])
    return df.join(bounded(q), by).withColumn("bin", F.when(F.col(value).isNotNull(), F.aggregate("_q", F.lit(0), lambda n, e: n + (F.col(value) > e).cast("int")))).drop("_q")


def transitions(df: DataFrame, by: list[str], order: list[str], label: str = "bin") -> DataFrame:
    """``a, b, share``: how often label a is followed by b in the next row of its group, as a share of a."""
    nxt = F.lead(label).over(W.partitionBy(*by).orderBy(*order))
    c = df.select(F.col(label).alias("a"), nxt.alias("b")).filter("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    return c.select("a", "b", (F.col("c") / F.sum("c").over(W.partitionBy("a"))).alias("share"))


def wide(df: DataFrame, index: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """One row per ``index`` and one column per name; absent cells are null."""
    return df.groupBy(index).pivot(columns, names).agg(F.first(value))


def robust_scale(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with ``scaled``: (value - median) / interquartile range of its group."""
    q = quantiles(df, value, by, [0.25, 0.5, 0.75])
    return df.join(bounded(q), by).withColumn("scaled", F.try_divide(F.col(value) - F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0])).drop("_q")


def precision_recall(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``label, precision, recall, support``; null where a class is never guessed or never true."""
    both = df.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("label"), truth, guess)
    hit = F.count_if((F.col(truth) == F.col("label")) & (F.col(guess) == F.col("label")))
    t, g = F.count_if(F.col(truth) == F.col("label")), F.count_if(F.col(guess) == F.col("label"))
    return both.groupBy("label").agg(F.try_divide(hit, g).alias("precision"), F.try_divide(hit, t).alias("recall"), t.alias("support"))


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, std (n - 1), min, exact quartiles and max of a column per group; groups without values have count 0 and nulls."""
    g = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, value, by, [0.25, 0.5, 0.75])
    return g.join(q, by, "left").select(*by, "count", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def correlation_pairs(pairs: DataFrame) -> DataFrame:
    """``a, b, corr, distance`` with distance the root of half of 1 - corr."""
    c = pairs.groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))
    return c.withColumn("distance", F.sqrt(F.greatest((1 - F.col("corr")) / 2, F.lit(0.0))))


def silhouettes(points: DataFrame, ident: str, features: list[str], cluster: str) -> DataFrame:
    """``ident, cluster, silhouette`` (euclidean) of clustered points.

    Needs every distance, so the points are bounded: refused beyond ``MAX_POINTS`` rows.
    """
    n = points.limit(MAX_POINTS + 1).count()
    if n > MAX_POINTS:
        raise ValueError(f"silhouettes are for at most {MAX_POINTS} points")
    vec = F.array(*[F.col(f).cast("double") for f in features])
    p = points.select(F.col(ident).alias("i"), F.col(cluster).alias("c"), vec.alias("v"))
    others = p.agg(F.collect_list(F.struct(F.col("i").alias("j"), F.col("c").alias("d"), F.col("v").alias("u"))).alias("all"))
    sq = F.aggregate(F.zip_with("v", "o.u", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = p.join(F.broadcast(others), F.lit(True)).withColumn("o", F.explode("all")).filter("i <> o.j").select("i", "c", F.col("o.d").alias("d"), F.sqrt(sq).alias("r"))
    mean = pairs.groupBy("i", "c", "d").agg(F.avg("r").alias("m"))
    g = mean.groupBy("i", "c").agg(F.min(F.when(F.col("c") == F.col("d"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("d"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return g.select(F.col("i").alias(ident), F.col("c").alias(cluster), s.alias("silhouette"))


MAX_POINTS = 5_000


def kmeans(points: DataFrame, ident: str, features: list[str], max_k: int = 10, repeats: int = 3, seed: int = 1) -> DataFrame:
    """``ident, cluster``: k-means for k = 2 .. max_k and several starts; the labelling with the best mean / deviation of silhouettes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = checkpointed(VectorAssembler(inputCols=features, outputCol="_f").transform(points.select(ident, *features)))
    n, best, quality = data.count(), None, float("-inf")
    for k in range(2, min(max_k, n - 1) + 1):
        for r in range(repeats):
            made = KMeans(k=k, seed=seed + r, featuresCol="_f", predictionCol="cluster").fit(data).transform(data).drop("_f")
            s = silhouettes(made, ident, features, "cluster").agg(F.avg("silhouette").alias("m"), F.stddev_pop("silhouette").alias("s")).first()
            q = s["m"] / s["s"] if s["s"] else float("-inf")
            if q > quality:
                best, quality = made.select(ident, "cluster"), q
    return best if best is not None else data.select(ident, F.lit(0).alias("cluster"))


def cluster_quality(sil: DataFrame, cluster: str) -> DataFrame:
    """``cluster, size, quality``: mean over population deviation of its silhouettes; null where they do not vary."""
    return sil.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.try_divide(F.avg("silhouette"), F.stddev_pop("silhouette")).alias("quality"))


def optimal_clusters(points: DataFrame, ident: str, features: list[str], max_k: int = 10, repeats: int = 3, depth: int = 3) -> DataFrame:
    """``ident, cluster``: clusters of below-average quality are clustered again, together, as long as mean quality rises."""
    base = checkpointed(points.select(ident, *features))
    made = checkpointed(kmeans(base, ident, features, max_k, repeats))
    for _ in range(depth):
        q = cluster_quality(silhouettes(made.join(base, ident), ident, features, "cluster"), "cluster").collect()
        score = {r["cluster"]: r["quality"] for r in q if r["quality"] is not None}
        mean = sum(score.values()) / len(score) if score else 0.0
        weak = [c for c, v in score.items() if v < mean]
        if len(weak) <= 1:
            break
        part = base.join(made.filter(F.col("cluster").isin(weak)).select(ident), ident)
        again = kmeans(part, ident, features, max_k, repeats).withColumn("cluster", F.col("cluster") + 1000)
        new = checkpointed(made.filter(~F.col("cluster").isin(weak)).unionByName(again))
        q2 = [r["quality"] for r in cluster_quality(silhouettes(new.join(base, ident), ident, features, "cluster"), "cluster").collect() if r["quality"] is not None]
        if not q2 or sum(q2) / len(q2) <= mean:
            break
        made = new
    dense = made.select("cluster").distinct().withColumn("_n", F.dense_rank().over(W.orderBy("cluster")) - 1)
    return made.join(F.broadcast(dense), "cluster").select(ident, F.col("_n").alias("cluster"))


def logistic(df: DataFrame, features: list[str], label: str, seed: int = 1) -> DataFrame:
    """``label, guess``: robustly scaled features through a multinomial logistic regression fitted on the same rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import RobustScaler, StringIndexer, VectorAssembler

    d = df.select(*features, F.col(label).cast("string").alias("label")).dropna()
    steps = [
        VectorAssembler(inputCols=features, outputCol="_v"), RobustScaler(inputCol="_v", outputCol="_s", withCentering=True),
        StringIndexer(inputCol="label", outputCol="_y"), LogisticRegression(featuresCol="_s", labelCol="_y", predictionCol="_p", family="multinomial", maxIter=30),
    ]
    model = Pipeline(stages=steps).fit(d)
    names = F.array(*[F.lit(x) for x in model.stages[2].labels])
    return model.transform(d).select("label", names[F.col("_p").cast("int")].alias("guess"))


def pie_shares(df: DataFrame, name: str, value: str) -> DataFrame:
    """``name, share, start_angle, end_angle`` in order of name."""
    d = df.groupBy(name).agg(F.sum(value).alias("value"))
    d = d.select(F.lit("all").alias("symbol"), F.col(name).alias("ts"), F.lit(0).alias("tie"), "value")
    d = running(d, sums={"upto": F.col("value")}, totals={"upto": "total"})
    turn = lambda c: F.try_divide(c, F.col("total"))
    two_pi = 6.283185307179586
    return d.select(F.col("ts").alias(name), turn(F.col("value")).alias("share"), (turn(F.col("upto") - F.col("value")) * two_pi).alias("start_angle"), (turn(F.col("upto")) * two_pi).alias("end_angle"))


def hour_over_hour(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Transition shares of a value's quantile bin within (symbol, hour) to the next row of the same hour."""
    d = df.withColumn("hour", F.hour("ts")).filter(F.col(value).isNotNull())
    return transitions(quantile_bins(d, value, ["symbol", "hour"], bins), ["symbol", "hour"], ["ts", "tie"])


def rank_pairs(df: DataFrame, past: int, future: int) -> DataFrame:
    """``a, b``: dense ranks at each time of the past and of the coming sum of rates over the given spans."""
    f = lambda c, n, lo, hi, w: F.when(F.count(c).over(w.rowsBetween(lo, hi)) == n, F.sum(c).over(w.rowsBetween(lo, hi)))
    d = rolling(df, lambda w: {"_pre": f("rate", past, -(past - 1), 0, w), "_fut": f("rate", future, 1, future, w)}, back=past, ahead=future).filter("_pre is not null and _fut is not null")
    rank: Column = F.dense_rank().over(W.partitionBy("ts").orderBy("_pre"))
    return d.select("ts", rank.alias("a"), F.dense_rank().over(W.partitionBy("ts").orderBy("_fut")).alias("b"))
