"""A versioned table store on plain Parquet, and chunked ingestion.

A version is a folder ``<root>/<library>/<table>/v=<n>``, complete once it holds
``_SUCCESS``; the newest complete one is current.  A new version is written next to the old
ones, so readers of an older version are never disturbed and a failed write is never seen.
All file access goes through the Hadoop file system API, so any shared store works.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class TableStore:
    """Libraries of versioned tables below ``root``; ``index`` is the time column ranges refer to."""

    def __init__(self, spark: SparkSession, root: str, index: str = "ts") -> None:
        self.spark, self.root, self.index = spark, root.rstrip("/"), index
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def libraries(self) -> list[str]:
        return self._names(self.root)

    def create_library(self, library: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{library}"))

    def delete_library(self, library: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{library}"), True)

    def tables(self, library: str) -> list[str]:
        return [t for t in self._names(f"{self.root}/{library}") if self.versions(library, t)]

    def has_table(self, library: str, table: str) -> bool:
        return bool(self.versions(library, table))

    def versions(self, library: str, table: str) -> list[int]:
        base = f"{self.root}/{library}/{table}"
        return sorted(int(v[2:]) for v in self._names(base) if v.startswith("v=") and self._fs.exists(self._path(f"{base}/{v}/_SUCCESS")))

    def write(self, library: str, table: str, df: DataFrame, keep_old: bool = False, metadata: dict[str, str] | None = None) -> int:
        """Write a new version, and drop the older ones unless ``keep_old``; metadata are kept beside the data."""
        if self.index not in df.columns:
            raise ValueError(f"a table needs the column {self.index}")
        old = self.versions(library, table)
        no = (old[-1] + 1) if old else 0
        at = f"{self.root}/{library}/{table}/v={no}"
        df.write.mode("overwrite").parquet(at)
        rows = sorted((metadata or {}).items())
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{at}/_metadata")
        for v in [] if keep_old else old:
            self._fs.delete(self._path(f"{self.root}/{library}/{table}/v={v}"), True)
        return no

    def metadata(self, library: str, table: str, version: int | None = None) -> dict[str, str]:
        at = f"{self._at(library, table, version)}/_metadata"
        return {r["key"]: r["value"] for r in self.spark.read.schema("key string, value string").json(at).collect()}

    def _at(self, library: str, table: str, version: int | None) -> str:
        have = self.versions(library, table)
        if not have or (version is not None and version not in have):
            raise KeyError(f"{library}/{table} version {version}")
        return f"{self.root}/{library}/{table}/v={have[-1] if version is None else version}"

    def _between(self, start: object, end: object) -> Column:
        cond = F.lit(True)
        if start is not None:
            cond = cond & (F.col(self.index) >= F.lit(start))
        if end is not None:
            cond = cond & (F.col(self.index) <= F.lit(end))
        return cond

    def read(self, library: str, table: str, version: int | None = None, start: object = None, end: object = None, columns: Sequence[str] | None = None) -> DataFrame:
        """A lazy table; the (inclusive) range and the columns reach the Parquet scan."""
        df = self.spark.read.parquet(self._at(library, table, version)).filter(self._between(start, end))
        return df.select(*columns) if columns else df

    def read_many(self, library: str, tables: Sequence[str]) -> DataFrame:
        """Several tables under one schema, with their names in ``table_name``."""
        parts = [self.read(library, t).withColumn("table_name", F.lit(t)) for t in tables]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def update(self, library: str, table: str, df: DataFrame, start: object = None, end: object = None) -> int:
        """Replace the rows in a range (by default from the first to the last time of ``df``); a missing table is created."""
        if not self.has_table(library, table):
            return self.write(library, table, df)
        if start is None or end is None:
            lo, hi = df.agg(F.min(self.index), F.max(self.index)).first()
            start, end = (lo if start is None else start), (hi if end is None else end)
        kept = self.read(library, table).filter(~self._between(start, end) | F.col(self.index).isNull())
        return self.write(library, table, kept.unionByName(df.filter(self._between(start, end)), allowMissingColumns=True))

    def delete_range(self, library: str, table: str, start: object, end: object) -> int:
        return self.write(library, table, self.read(library, table).filter(~self._between(start, end) | F.col(self.index).isNull()))

    def delete(self, library: str, table: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{library}/{table}"), True)

    def keep_last(self, library: str, table: str) -> None:
        for v in self.versions(library, table)[:-1]:
            self._fs.delete(self._path(f"{self.root}/{library}/{table}/v={v}"), True)


def chunks(tasks: DataFrame, step_s: int) -> DataFrame:
    """``tasks`` (with ``start_ts, end_ts``) cut into half-open chunks of ``step_s`` seconds: ``chunk_start, chunk_end``; empty ranges give none."""
    step = F.make_dt_interval(secs=F.lit(float(step_s)))
    at = F.when(F.col("start_ts") < F.col("end_ts"), F.filter(F.sequence("start_ts", "end_ts", step), lambda t: t < F.col("end_ts")))
    d = tasks.withColumn("chunk_start", F.explode(at))
    return d.withColumn("chunk_end", F.least(F.col("chunk_start") + step, F.col("end_ts")))


def download(tasks: DataFrame, fetch: Callable[[pd.Series], pd.DataFrame], schema: str, step_s: int, partitions: int = 16) -> DataFrame:
    """Rows fetched chunk by chunk: each chunk is one call of ``fetch`` in some task; empty chunks give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                got = fetch(row)
                if got is not None and len(got):
                    yield got

    return chunks(tasks, step_s).repartition(partitions).mapInPandas(run, schema)


def contains_any(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose column holds any of the substrings; nulls hold none."""
    cond = F.lit(False)
    for p in patterns:
        cond = cond | F.coalesce(F.contains(F.col(column), F.lit(p)), F.lit(False))
    return df.filter(cond)


def last_rows(df: DataFrame, n: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """The latest ``n`` rows of each group; the cut-off per (group, day) keeps all but the latest days out of the sort."""
    day = F.to_date("ts")
    per = df.groupBy(*by, day.alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    later = W.partitionBy(*by).orderBy(F.col("_d").desc()).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_after", F.coalesce(F.sum("_c").over(later), F.lit(0))).filter(F.col("_after") < n).select(*by, "_d", "_after")
    d = df.withColumn("_d", day).join(per, [*by, "_d"])
    place = F.row_number().over(W.partitionBy(*by, "_d").orderBy(F.col("ts").desc(), F.col("tie").desc()))
    return d.withColumn("_n", place + F.col("_after")).filter(F.col("_n") <= n).drop("_n", "_d", "_after")
