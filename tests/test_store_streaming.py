"""The table store, chunked ingestion and the streaming resamplers."""

import datetime as dt

import pandas as pd

from barwise.sources.store import TableStore, chunks, contains_any, download, last_rows
from barwise.streaming.bars import clock_bars, volume_bars_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, tie long, price double, volume double"


def frame(spark, days, price=1.0):
    return spark.createDataFrame([("a", T0 + dt.timedelta(days=d), d, price, 1.0) for d in days], SCHEMA)


def test_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    s.create_library("lib")
    assert s.libraries() == ["lib"] and not s.has_table("lib", "t")
    assert s.write("lib", "t", frame(spark, range(10)), metadata={"unit": "1d"}) == 0
    assert s.metadata("lib", "t") == {"unit": "1d"}
    assert s.read("lib", "t", start=T0 + dt.timedelta(days=2), end=T0 + dt.timedelta(days=4), columns=["ts"]).count() == 3
    s.update("lib", "t", frame(spark, range(8, 12), 2.0))
    got = {r["tie"]: r["price"] for r in s.read("lib", "t").collect()}
    assert len(got) == 12 and got[8] == 2.0 and got[7] == 1.0 and s.versions("lib", "t") == [1]
    s.write("lib", "t", frame(spark, [1]), keep_old=True)
    assert s.versions("lib", "t") == [1, 2] and s.read("lib", "t", version=1).count() == 12
    s.delete_range("lib", "t", T0, T0 + dt.timedelta(days=1))
    assert s.read("lib", "t").count() == 0
    s.update("lib", "u", frame(spark, [3]))
    assert s.read_many("lib", ["t", "u"]).filter("table_name = 'u'").count() == 1
    s.delete("lib", "t")
    assert s.tables("lib") == ["u"]
    s.delete_library("lib")
    assert s.libraries() == []


def test_chunks_and_download(spark):
    tasks = spark.createDataFrame([("a", T0, T0 + dt.timedelta(hours=5)), ("b", T0, T0)], "symbol string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = chunks(tasks, 7200).orderBy("chunk_start").collect()
    assert [(r["chunk_end"] - r["chunk_start"]).seconds // 3600 for r in got] == [2, 2, 1]

    def fetch(row):
        return pd.DataFrame({"symbol": [row["symbol"]], "ts": [row["chunk_start"]]}) if row["chunk_start"].hour else None

    assert download(tasks, fetch, "symbol string, ts timestamp_ntz", 7200, 2).count() == 2


def test_last_rows_and_contains(spark):
    df = frame(spark, range(30)).unionByName(frame(spark, [29]))
    assert sorted(r["tie"] for r in last_rows(df, 4).collect()) == [27, 28, 29, 29]
    c = spark.createDataFrame([("gold month",), (None,), ("tin",)], "n string")
    assert contains_any(c, "n", ["month", "x"]).count() == 1


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_clock_bars(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(seconds=20 * i), i, float(i), 1.0) for i in range(300)]
    got = run(spark, clock_bars(stream(spark, tmp_path, rows)), "clock")
    first = got.orderBy("start_ts").first()
    assert (first["open"], first["close"], first["ticks"]) == (0.0, 2.0, 3)


def test_volume_bars_stream_keeps_state(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(seconds=i), i, float(i), 2.0) for i in range(25)] + [("b", T0, 0, 1.0, 1.0)]
    got = run(spark, volume_bars_stream(stream(spark, tmp_path, rows), 10.0), "vol").orderBy("start_ts").collect()
    assert [(r["symbol"], r["ticks"], r["open"], r["close"]) for r in got] == [("a", 5, float(5 * k), float(5 * k + 4)) for k in range(5)]
