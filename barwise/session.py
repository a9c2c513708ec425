"""Session-level helpers shared by every operator.

Nothing here keeps state between calls.  Broadcasts are only ever taken through
:func:`bounded`, which looks at the row count first and leaves the choice of the
join to the planner (sort-merge with AQE skew handling) beyond the limit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side counts as small enough to be copied to every executor.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors see, removed when the session's JVM ends.

    It lies below ``spark.checkpoint.dir``.  Where that is unset only a local session, whose executors are one machine,
    has a place of its own (Spark's scratch folder); on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        base = spark.sparkContext.getConf().get("spark.local.dir", "/tmp").split(",")[0]
    at = f"{base.rstrip('/')}/barwise-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the folder all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table written to the shared folder, of which later steps read only the columns they need."""
    at = shared_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is, for the planner to join.

    What is worked out from more than one table (or the same one twice) is written to the shared folder and counted there,
    so that it is worked out once; otherwise the count stops after ``limit + 1`` rows.
    """
    if df._jdf.queryExecution().analyzed().collectLeaves().size() > 1:
        df = stored(df)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (independent of the session zone)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def epoch_s(ts: Column | str) -> Column:
    """Whole seconds since 1970, rounded down."""
    return floor_div(epoch_us(ts), 1_000_000)


def floor_div(x: Column, by: int) -> Column:
    """Integer division rounding down, exact for all longs (``/`` would go through double)."""
    d = F.lit(by).cast("long")
    return F.call_function("div", x - F.pmod(x, d), d)


def number(c: Column | str) -> Column:
    """A double with NaN turned into null, so that aggregates skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("double"), F.lit(float("nan")))
