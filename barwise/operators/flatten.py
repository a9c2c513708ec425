"""Deeply nested JSON records into related flat tables (problem 1).

The JVM decodes a payload once into nested columns.  From there on nothing walks rows:
each Arrow batch is flattened by its buffers - the offsets of a list say where the
children of a parent lie, the parent-index kernel says whose child an element is, and
keys reach the children by one vectorised ``take``.  Records -> ticks -> quote levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["created_at", "price", "last_volume", "trade_type", "cum_volume", "cum_amount", "cum_position"]
SIDES = ["bid_p", "bid_v", "ask_p", "ask_v"]

_TICK = "symbol string, " + ", ".join(f"{f} string" for f in FIELDS) + ", quotes string"
_ROOT = f"array<struct<{_TICK}, ticks array<struct<{_TICK}>>, data array<struct<{_TICK}>>, meta struct<symbol string>, batch struct<symbol string, ticks array<struct<{_TICK}>>, data array<struct<{_TICK}>>>>>"
_LEVEL = "struct<" + ", ".join(f"{s} string" for s in SIDES) + ">"
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(text: Column) -> Column:
    """Whether ``text`` is one JSON value and nothing else.

    The parser stops after the first value, so the text is tried as a list entry and as an
    object member: whatever follows the value breaks at least one of the two.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()


def _decoded(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(rid, groups array<struct<symbol, ticks>>) of the valid payloads, in order of appearance; groups is null where there are none."""
    root = df.select(F.col(id_col).alias("rid"), F.col(payload).cast("string").alias("p")).filter(is_json(F.col("p")))
    root = root.select("rid", F.from_json("p", _ROOT, _JSON).alias("root"))

    def group(x: Column) -> Column:
        single = F.struct(*[x[c].alias(c) for c in ["symbol", *FIELDS, "quotes"]])
        ticks = F.coalesce(x["batch"]["ticks"], x["batch"]["data"], x["ticks"], x["data"])
        lone = F.when(F.coalesce(*[x[c] for c in FIELDS], x["quotes"]).isNotNull(), F.array(single))
        outer = F.coalesce(F.nullif(x["symbol"], F.lit("")), F.nullif(x["meta"]["symbol"], F.lit("")))
        return F.struct(
            F.coalesce(F.nullif(x["batch"]["symbol"], F.lit("")), outer).alias("symbol"),
            F.filter(F.coalesce(ticks, lone), lambda t: t.isNotNull()).alias("ticks"),
        )

    # (no filter on what was decoded: it would be decoded once more for it; null lists have no children)
    return root.select("rid", F.transform("root", group).alias("groups"))


def _parents(arr: pa.ListArray) -> np.ndarray:
    return pc.list_parent_indices(arr).to_numpy(zero_copy_only=False)


def _numbered(parents: np.ndarray) -> np.ndarray:
    """1, 2, ... within each run of equal parents (parents ascend)."""
    if not len(parents):
        return parents.astype("int32")
    at = np.arange(len(parents))
    first = np.r_[True, parents[1:] != parents[:-1]]
    return (at - np.maximum.accumulate(np.where(first, at, 0)) + 1).astype("int32")


def _one(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _ticks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        groups = b.column(1)
        rec_of_group = _parents(groups)
        flat = _one(pc.list_flatten(groups))
        ticks, outer = pc.struct_field(flat, "ticks"), pc.struct_field(flat, "symbol")
        group_of_tick = _parents(ticks)
        t = _one(pc.list_flatten(ticks))
        rec = rec_of_group[group_of_tick]
        own = pc.struct_field(t, "symbol")
        own = pc.if_else(pc.equal(own, ""), pa.scalar(None, own.type), own)
        cols = [b.column(0).take(pa.array(rec)), pa.array(_numbered(rec)), pc.coalesce(own, outer.take(pa.array(group_of_tick)))]
        cols += [pc.struct_field(t, f) for f in [*FIELDS, "quotes"]]
        yield pa.RecordBatch.from_arrays([_one(c) for c in cols], names=["rid", "tick_no", "symbol", *FIELDS, "quotes"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rid", "tick_no", "symbol"]
    for b in batches:
        lv = b.column(3)
        parent = pa.array(_parents(lv))
        flat = _one(pc.list_flatten(lv))
        cols = [b.column(i).take(parent) for i in range(3)] + [pc.struct_field(flat, f) for f in ["level_no", *SIDES]]
        yield pa.RecordBatch.from_arrays([_one(c) for c in cols], names=[*names, "level_no", *SIDES])


def _tick_time(c: Column) -> Column:
    """Epoch milliseconds or seconds, ISO with or without zone, or plain date and time."""
    num = c.try_cast("double")
    micros = F.when(F.abs(num) >= 1e14, num).when(F.abs(num) >= 1e11, num * 1e3).otherwise(num * 1e6)
    text = F.regexp_replace(F.regexp_replace(F.trim(c), "(Z|[+]00:?00)$", ""), "T", " ")
    return F.coalesce(
        F.timestamp_add("MICROSECOND", micros.try_cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")),
        text.try_cast("timestamp_ntz"),
    )


def flatten_ticks(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """``id_col, tick_no, symbol, <tick fields>, quotes``: one row per tick of a valid payload.

    ``tick_no`` counts the ticks of a record from 1 in order of appearance, over all its
    groups.  ``symbol`` is the tick's own, or else that of the nearest object around it
    (where the symbol of an object stands in its ``meta`` member, that one).  Numbers sent
    as text are numbers, times in any of the feed's formats are timestamps, fields that are
    absent or unreadable are null.  ``quotes`` stays JSON text for :func:`flatten_levels`.
    Null or damaged payloads, bare scalars and empty containers give no rows; repeated
    records give their rows again under their own id; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = _decoded(df, id_col, payload).mapInArrow(_ticks, f"rid {kind}, tick_no int, {_TICK}")
    num = {"trade_type": "int"}
    return out.select(
        F.col("rid").alias(id_col), "tick_no", "symbol", _tick_time(F.col("created_at")).alias("created_at"),
        *[F.col(f).try_cast("double").try_cast(num.get(f, "double")).alias(f) for f in FIELDS[1:]], "quotes",
    )


def flatten_levels(ticks: DataFrame, id_col: str) -> DataFrame:
    """``id_col, tick_no, symbol, level_no, bid_p, bid_v, ask_p, ask_v``: one row per quote level.

    A list gives its places from 1 (a null entry keeps its place and is no level), an object
    keyed by numbers gives its keys, a lone object is level 1; quotes sent as JSON text count
    the same; empty, null or damaged quotes give no rows.
    """
    q = F.col("quotes")
    valid = ticks.select(id_col, "tick_no", "symbol", "quotes").filter(q.isNotNull() & (F.length(F.trim(q)) > 2)).filter(is_json(q))
    level = lambda no, x: F.struct(no.cast("int").alias("level_no"), *[x[s].try_cast("double").alias(s) for s in SIDES])
    listed = F.from_json(q, f"array<{_LEVEL}>", _JSON)
    keyed = F.map_entries(F.from_json(q, f"map<string, {_LEVEL}>", _JSON))
    present = F.from_json(q, "array<string>", _JSON)
    levels = (
        F.when(q.rlike(r"^\s*\["), F.filter(F.transform(F.arrays_zip(listed.alias("l"), present.alias("p")), lambda x, i: F.when(x["p"].isNotNull(), level(i + 1, x["l"]))), lambda x: x.isNotNull()))
        .when(q.rlike(r'^\s*\{\s*"\s*[0-9]+\s*"\s*:'), F.transform(F.filter(keyed, lambda e: e["value"].isNotNull()), lambda e: level(e["key"], e["value"])))
        .when(q.rlike(r'^\s*\{\s*"'), F.array(level(F.lit(1), F.from_json(q, _LEVEL, _JSON))))
    )
    kind = ticks.schema[id_col].dataType.simpleString()
    cols = ", ".join(f"{s} double" for s in SIDES)
    return (
        valid.select(F.col(id_col).alias("rid"), "tick_no", "symbol", levels.alias("lv"))
        .mapInArrow(_levels, f"rid {kind}, tick_no int, symbol string, level_no int, {cols}")
        .withColumnRenamed("rid", id_col)
    )


def flatten_records(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """``id_col, valid, ticks``: every record, whether its payload is JSON, and how many ticks it holds."""
    counts = flatten_ticks(df, id_col, payload).groupBy(id_col).agg(F.count(F.lit(1)).alias("ticks"))
    base = df.select(F.col(id_col), F.coalesce(is_json(F.col(payload).cast("string")), F.lit(False)).alias("valid"))
    return base.join(counts, id_col, "left").select(id_col, "valid", F.coalesce("ticks", F.lit(0)).cast("long").alias("ticks"))
