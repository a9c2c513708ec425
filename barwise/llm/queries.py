"""Queries of the problems tagged llm, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.leakage import leaked_items
from barwise.llm.mixing import mix
from barwise.llm.nearest import nearest_in_time
from barwise.llm.percentiles import merge_counts, percentiles, value_counts
from barwise.llm.toxicity import LINKS, toxic_rates, toxicity
from barwise.session import checkpointed, table

REL_ERROR = 0.001
METRICS = ["close", "volume"]


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles within ``REL_ERROR`` of the exact ones, whose counts add up over parts."""
    counts = value_counts(table(spark, sf_dir, "bars"), ["symbol"], METRICS, REL_ERROR)
    out = percentiles(counts, ["symbol"])
    return out.select("symbol", "metric", "prob", "n", F.round("value", 6).alias("value"), F.lit(REL_ERROR).alias("rel_error"))


def p2_percentiles_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from partial results per day of bob, combined."""
    bars = table(spark, sf_dir, "bars")
    daily = value_counts(bars, ["symbol"], METRICS, REL_ERROR, by=F.to_date("bob"))
    out = percentiles(merge_counts(daily, ["symbol"]), ["symbol"])
    return out.select("symbol", "metric", "prob", "n", F.round("value", 6).alias("value"), F.lit(REL_ERROR).alias("rel_error"))


def p2_percentiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(value_counts(table(spark, sf_dir, "bars"), ["symbol"], METRICS), ["symbol"])


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = table(spark, sf_dir, "event_df"), table(spark, sf_dir, "bars")
    return nearest_in_time(events, bars, "symbol", "date_time", "bob", "event_id", "bar_id", tolerance_s=300)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).filter("bar_id is not null").select("event_id", "bar_id")


def p4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order event with a symbol and a time, matched or not."""
    return _nearest(spark, sf_dir)


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds passages of an evaluation item, with the extent of the leak."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    report = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
    return report.withColumn("actual_share", F.round("actual_share", 6))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture, with its shard and place."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


#: Probability from which a document counts as toxic.  Of what two independently fitted models judged apart, the windows that
#: really were toxic scored above 0.7 and polite remarks beside the text from 0.54 to 0.64.
TOXIC = 0.6


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return out.select("doc_id", *[F.round(c, 4).alias(c) for c in LINKS])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")).filter(F.col("toxic") >= TOXIC).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of toxic documents per source, in its plain form."""
    docs = table(spark, sf_dir, "documents")
    return toxic_rates(docs, checkpointed(toxicity(docs, table(spark, sf_dir, "doc_labels"))), threshold=TOXIC).withColumn("rate", F.round("rate", 6))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_percentiles_daily, p2_percentiles_exact, p4_found, p4_all, p8_found, p8_leaks, p9_mixture, p9_report, p10_found, p10_scores, p10_rates)}

_PROBS = "(values (0.01), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)) q(prob)"
_VALUES = "(select symbol, 'close' as metric, close as v from bars union all select symbol, 'volume', volume from bars)"


def _percentile_sql(value: str, shown: str, extra: str) -> str:
    return f"""
    with x as (select symbol, metric, {value} as value from {_VALUES} where v is not null and not isnan(v)),
    c as (select symbol, metric, value, count(*) as k from x group by all),
    r as (select *, sum(k) over (partition by symbol, metric order by value) as upto, sum(k) over (partition by symbol, metric) as n from c)
    select symbol, metric, prob::double as prob, n::bigint as n, {shown} as value{extra}
    from r, {_PROBS}
    where greatest(ceil(prob::double * n), 1) > upto - k and greatest(ceil(prob::double * n), 1) <= upto
    """


_G = f"ln({1 + REL_ERROR}/{1 - REL_ERROR})"
_BINNED = f"case when v = 0 then 0.0 else sign(v) * exp(ceil(ln(abs(v)) / {_G}) * {_G}) * (2 / (1 + {1 + REL_ERROR}/{1 - REL_ERROR})) end"
_PAIRS = """
    with e as (select event_id, symbol, date_time from event_df where symbol is not null and date_time is not null),
    b as (select symbol, bob, min(bar_id) as bar_id from bars where bob is not null group by all),
    m as (select event_id, bar_id, abs(epoch_us(bob) - epoch_us(date_time)) as d,
                 row_number() over (partition by event_id order by abs(epoch_us(bob) - epoch_us(date_time)), bob) as rn
          from e join b on b.symbol = e.symbol and b.bob between e.date_time - interval 300 seconds and e.date_time + interval 300 seconds)
"""
ORACLES = {
    "p2_percentiles": _percentile_sql(_BINNED, "round(value, 6)", f", {REL_ERROR}::double as rel_error"),
    "p2_percentiles_daily": _percentile_sql(_BINNED, "round(value, 6)", f", {REL_ERROR}::double as rel_error"),
    "p2_percentiles_exact": _percentile_sql("v", "value", ""),
    "p4_found": _PAIRS + "select event_id, bar_id from m where rn = 1",
    "p4_all": _PAIRS + "select e.event_id, m.bar_id, m.d as distance_us from e left join m on m.event_id = e.event_id and rn = 1",
}
