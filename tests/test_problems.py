"""The general training-data operators on small fixtures: nulls, ties, copies, empty tables, clashing names."""

import datetime as dt
import json
import random

import numpy as np
import pytest

from barwise.operators.flatten import flatten_levels, flatten_records, flatten_ticks
from barwise.operators.intervals import interval_gaps, merge_intervals
from barwise.operators.regular_grid import regular_grid
from barwise.operators.spikes import implausible
from barwise.operators.trailing import trailing_totals

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


# ---------------------------------------------------------------- intervals

IV = "symbol string, bob timestamp_ntz, eob timestamp_ntz, _k int, _s string, gap_start_us int"


def brute_periods(rows):
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        iv = sorted((r[1], r[2]) for r in rows if r[0] == k and r[1] is not None and r[2] is not None and r[2] > r[1])
        cur = None
        for a, b in iv:
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                cur = [a, b]
                out.append((k, cur))
    return [(k, a, b) for k, (a, b) in out]


def test_intervals_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), at(s := rng.randrange(0, 400_000)), at(s + rng.randrange(-50, 9000)), 1, "x", 2) for _ in range(600)]
    rows += [("a", None, at(1), 1, "x", 2), ("a", at(1), None, 1, "x", 2), ("long", at(0), at(900_000), 1, "x", 2), ("long", at(5), at(6), 1, "x", 2)] + rows[:20]
    df = spark.createDataFrame(rows, IV).repartition(3)
    want = brute_periods(rows)
    us = lambda t: round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    got = sorted((r[0], r[1], r[2]) for r in merge_intervals(df, "symbol", "bob", "eob").collect())
    assert got == sorted((k, us(a), us(b)) for k, a, b in want)
    gaps = sorted((r[0], r[1], r[2]) for r in interval_gaps(df, "symbol", "bob", "eob").collect())
    assert gaps == sorted((k, us(b), us(c)) for (k, _, b), (k2, c, _) in zip(want, want[1:]) if k == k2)


def test_intervals_empty_and_touching(spark):
    assert merge_intervals(spark.createDataFrame([], IV), "symbol", "bob", "eob").count() == 0
    assert interval_gaps(spark.createDataFrame([], IV), "symbol", "bob", "eob").count() == 0
    df = spark.createDataFrame([("a", at(0), at(5), 0, "", 0), ("a", at(5), at(9), 0, "", 0)], IV)
    assert interval_gaps(df, "symbol", "bob", "eob").count() == 0
    assert merge_intervals(df, "symbol", "bob", "eob").first()["intervals"] == 2


# ---------------------------------------------------------------- trailing totals


def test_trailing(spark):
    nan = float("nan")
    rows = [("a", at(0), 1.0, 7), ("a", at(0), 1.0, 7), ("a", at(86400), nan, 7), ("a", at(86400 * 9), None, 7), ("a", at(86400 * 40), 5.0, 7), ("b", at(5), 2.0, 7), (None, at(5), 2.0, 7), ("b", None, 2.0, 7)]
    df = spark.createDataFrame(rows, "symbol string, bob timestamp_ntz, close double, sum_7d int")
    got = {(r["symbol"], r["day"].isoformat()): r for r in trailing_totals(df, "symbol", "bob", "close").collect()}
    assert len(got) == 41 + 1
    first = got["a", "2024-01-01"]
    assert (first["rows_day"], first["sum_7d"], first["count_7d"], first["avg_7d"]) == (2, 2.0, 2, 1.0)
    ninth = got["a", "2024-01-09"]
    assert ninth["count_7d"] == 0 and ninth["sum_7d"] is None and ninth["avg_7d"] is None and ninth["count_30d"] == 2
    assert got["a", "2024-02-10"]["sum_30d"] == 5.0
    assert trailing_totals(df.limit(0), "symbol", "bob", "close").count() == 0


# ---------------------------------------------------------------- regular grid

TK = "symbol string, created_at timestamp_ntz, price double, last_volume double, step int, mark string"


def test_grid(spark):
    nan = float("nan")
    rows = [("a", at(30 + 60 * m), 100.0 + m, 1.0, 0, "") for m in (0, 1, 2, 9, 10)]
    rows += [("a", at(70), nan, 1.0, 0, ""), ("a", at(80), 0.0, 1.0, 0, ""), ("a", None, 5.0, 1.0, 0, ""), (None, at(5), 5.0, 1.0, 0, ""), ("a", at(45), 100.25, None, 0, ""), ("b", at(86399), 1.0, 2.0, 0, ""), ("b", at(86401), 1.0, 2.0, 0, "")]
    df = spark.createDataFrame(rows, TK)
    got = {(r["symbol"], r["step"]): r for r in regular_grid(df, "symbol", "created_at", "price", "last_volume").collect()}
    m0 = 1704067200 // 60
    assert sorted(s - m0 for k, s in got if k == "a") == list(range(11))
    assert [got["a", m0 + m]["mark"] for m in (0, 3, 5, 6, 9)] == ["observed", "filled", "missing", "missing", "observed"]
    assert got["a", m0]["readings"] == 2 and got["a", m0]["volume"] == 1.0
    assert got["a", m0 + 1]["value"] == pytest.approx(101.0, abs=0.2)
    assert got["a", m0 + 5]["value"] is None
    # days are gridded apart: one step at the end of one day, one at the start of the next
    assert sorted(s - m0 for k, s in got if k == "b") == [1439, 1440]
    assert regular_grid(df.limit(0), "symbol", "created_at", "price", "last_volume").count() == 0


def test_grid_reproduces_a_line(spark):
    rows = [("a", at(s), 10 + 0.01 * s, 1.0, 0, "") for s in range(0, 3600, 7)]
    for r in regular_grid(spark.createDataFrame(rows, TK), "symbol", "created_at", "price", "last_volume").collect():
        mid = r["step"] * 60 + 30 - 1704067200
        assert r["value"] == pytest.approx(10 + 0.01 * mid, rel=1e-6)


# ---------------------------------------------------------------- nested records


def payloads():
    lv = lambda p: {"bid_p": p, "bid_v": 1, "ask_p": str(p + 1), "ask_v": None}
    docs = [
        {"symbol": "A", "created_at": 1704067200123, "price": 1.5, "quotes": [lv(1), None, lv(2)]},
        {"batch": {"seq": 1, "symbol": "B", "ticks": [{"price": "2", "quotes": json.dumps([lv(3)])}, {"symbol": "C", "price": 3, "quotes": {"4": lv(4), "2": lv(5), "7": None}}, {"price": 1}]}},
        {"meta": {"symbol": "D", "vendor": {"name": "x"}}, "data": [{"price": 1, "created_at": "2024-01-01T00:00:00Z", "quotes": lv(6)}, {"price": 2, "quotes": []}, {"price": 2, "quotes": None}]},
        [{"symbol": "E", "ticks": [{"price": 1, "quotes": [lv(7)]}]}, {"symbol": "F", "ticks": [{"price": 1}, {"price": 1, "quotes": [lv(8), {"queue": [{"side": "bid"}]}]}]}],
    ]
    text = [json.dumps(d) for d in docs]
    return [*text, text[0], text[1][:-9], '{"symbol": "A", "price": 1, "quotes": [{"bid_p": 1}]} x', "", None, "null", "3", "[]", "{}", '{"a": {"b": [1, {"c": 2}]}}', text[0][:-1] + ',"extra":"' + "y" * 200_000 + '"}']


def test_flatten(spark):
    df = spark.createDataFrame([(i, p, 1, "q") for i, p in enumerate(payloads())], "record_id long, payload string, tick_no int, symbol string")
    ticks = flatten_ticks(df, "record_id", "payload")
    got = sorted((r["record_id"], r["tick_no"], r["symbol"], r["level_no"]) for r in flatten_levels(ticks, "record_id").collect())
    one = [(1, "A", 1), (1, "A", 3)]
    want = [(0, *x) for x in one] + [(1, 1, "B", 1), (1, 2, "C", 2), (1, 2, "C", 4), (2, 1, "D", 1), (3, 1, "E", 1), (3, 3, "F", 1), (3, 3, "F", 2)] + [(4, *x) for x in one] + [(14, *x) for x in one]
    assert got == sorted(want)
    rec = {r["record_id"]: (r["valid"], r["ticks"]) for r in flatten_records(df, "record_id", "payload").collect()}
    assert [rec[i] for i in (0, 1, 2, 3, 5, 6, 7, 8, 11)] == [(True, 1), (True, 3), (True, 3), (True, 3), (False, 0), (False, 0), (False, 0), (False, 0), (True, 0)]
    t = {(r["record_id"], r["tick_no"]): r for r in ticks.collect()}
    assert t[0, 1]["created_at"] == at(0) + dt.timedelta(milliseconds=123) and t[2, 1]["created_at"] == at(0) and t[1, 1]["price"] == 2.0
    assert flatten_levels(flatten_ticks(df.limit(0), "record_id", "payload"), "record_id").count() == 0


# ---------------------------------------------------------------- spikes

BR = "bar_id long, symbol string, bob timestamp_ntz, low double, high double, close double, volume double, position double, src string, field string"


def series(n=400, seed=1, symbol="a", start=0):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.integers(-2, 3, n)) * 0.1
    v = np.exp(rng.normal(6, 0.7, n)).round()
    p = 5000 + np.cumsum(rng.integers(-30, 31, n))
    return [[start + i, symbol, at(60 * i), c[i] - 0.5, c[i] + 0.5, c[i], v[i], float(p[i]), "", ""] for i in range(n)]


def flags(spark, rows):
    plain = [tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows]
    got = implausible(spark.createDataFrame(plain, BR)).collect()
    assert len(got) == len(set(got))
    return {(r[0], r[1]) for r in got}


def test_clean_series_has_no_flags(spark):
    assert flags(spark, series()) == set()


def test_spikes(spark):
    rows = series()
    rows[50][5] = -1.0  # impossible
    rows[60][5] = rows[60][4] + 0.2  # above its own high
    for i in (100, 101, 102):  # brief excursion
        rows[i][5] += 40
        rows[i][4] += 41
    for i in range(200, 400):  # lasting move
        for c in (3, 4, 5):
            rows[i][c] += 30
    rows[300][6] = 1e8
    rows[310][6] = -3.0
    rows[320][7] = 0.0
    for i in range(330, 360):  # frozen position; the first reading is true
        rows[i][7] = 777.0
    rows[340][7] = None
    rows[20][5] = float("nan")
    copy = [9_000, *rows[101][1:]]
    got = flags(spark, [*rows, copy, [9_001, None, None, 1.0, 2.0, -5.0, 1.0, 1.0, "", ""], [9_002, "lone", at(0), 1.0, 2.0, 1.5, -1.0, None, "", ""]])
    want = {(50, "close"), (60, "close"), (100, "close"), (101, "close"), (102, "close"), (9_000, "close"), (300, "volume"), (310, "volume"), (320, "position"), (9_001, "close"), (9_002, "volume")}
    want |= {(i, "position") for i in range(331, 360) if i != 340}
    assert got == want


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    import barwise.operators.spikes as s

    rows = series(3000, seed=3)
    for i in range(150, 3000, 290):
        rows[i][5] += 50
        rows[i][4] += 51
    for i in range(1000, 1400):  # frozen over the edges of blocks
        rows[i][7] = 777.0
    whole = flags(spark, rows)
    assert {(i, "position") for i in range(1001, 1400)} <= whole and len(whole) >= 408
    for block in (60, 333):
        monkeypatch.setattr(s, "BLOCK", block)
        monkeypatch.setattr(s, "HALO", 20)
        assert flags(spark, rows) == whole


def test_a_stretch_of_its_own_scale_is_held_against_the_whole_source(spark):
    """A reading far outside the source's changes is flagged, however wild the rows around it are."""
    rows = series(8000, seed=4)
    rng = np.random.default_rng(1)
    for i in range(5000, 5400):  # changes ten times as large
        for c in (3, 4, 5):
            rows[i][c] += float(rng.integers(-10, 11)) * 0.1
    for i in range(5100, 5400, 100):
        rows[i][5] += 6
        rows[i][4] += 7
    got = flags(spark, rows)
    assert {(i, "close") for i in range(5100, 5400, 100)} <= got


def test_short_frozen_runs(spark):
    """Seven equal readings are frozen where no other two neighbours are equal."""
    rows = series(900, seed=6)
    for i, r in enumerate(rows):
        r[7] = 5000.0 + i % 2 * 10 + i
    for i in range(300, 307):
        rows[i][7] = 777.0
    assert {i for i, f in flags(spark, rows) if f == "position"} >= set(range(301, 307))


def test_spikes_empty_and_constant(spark):
    assert flags(spark, [[0, "a", at(0), None, None, None, None, None, "", ""]]) == set()
    assert implausible(spark.createDataFrame([], BR)).count() == 0
    flat = [[i, "a", at(60 * i), 1.0, 1.0, 1.0, 5.0, 5.0, "", ""] for i in range(8)]
    assert flags(spark, flat) == set()


def test_input_order_does_not_matter(spark):
    rows = series(600, seed=9)
    rows[77][5] += 30
    a = flags(spark, rows)
    random.Random(1).shuffle(rows)
    assert flags(spark, rows) == a
