"""Mixing sources to target shares of tokens (problem 9).

Documents of a source fall, by hash, into a fixed number of blocks.  How often the
documents of a source are used follows from its quota: whole passes over all blocks, and
one partial pass over the first blocks of a seeded permutation, the last of them cut at a
document.  The block copies of all sources are dealt to output shards by a
multivariate-hypergeometric splitting tree: at each node the exact number of copies of
each source that go left is drawn without replacement, so every shard gets whole numbers
that add up exactly, and blocks are disjoint.  Where a source has fewer than ``BLOCKS`` block copies
these are dealt in pieces (by a further hash), so that small quotas reach every shard as well.
Within a shard documents are ordered by a seeded hash.

Only the table of blocks (sources x blocks rows, a parameter, whatever the documents)
reaches the driver; texts are tokenised once and never move for the accounting.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.session import bounded, checkpointed

BLOCKS = 256
SHARDS = 16


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str, pattern: str | None) -> Callable[[list[str]], list[int]]:
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]


def token_counts(docs: DataFrame, doc_id: str, text: str, keep: list[Column], path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, tokens`` and the columns ``keep``: the length of every whole text in tokens; null texts have 0.

    ``path`` is a file of ranks (token in base 64, rank) and ``pattern`` the expression that cuts texts before; by default those of the
    module ``public_tokenizers``, which the machines' tokenizer folder is installed as.
    """
    at = path or tokenizer_path()
    cols = docs.select(F.col(doc_id), F.col(text).alias("_text"), *keep)
    names = [c for c in cols.columns if c != "_text"]
    schema = ", ".join(f"{c} {cols.schema[c].dataType.simpleString()}" for c in names) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or _encoder(at, pattern)
            n = count([t or "" for t in b.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n, "int64")], names=[*names, "tokens"])

    return cols.mapInArrow(run, schema)


def split_tree(copies: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shard, source) numbers of block copies: ``copies`` per source dealt out exactly.

    At each node a capacity of copies goes to the left half; how many of each source these are is one draw
    without replacement from what the node holds (multivariate hypergeometric).
    """
    out = np.zeros((shards, len(copies)), "int64")

    def deal(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals")
        deal(lo, mid, left)
        deal(mid, hi, have - left)

    deal(0, shards, copies.astype("int64"))
    return out


@dataclass(frozen=True)
class Plan:
    """Per source: target, tokens there are, most copies, and the quota in tokens."""

    source: str
    target: float
    tokens: int
    repeats: int
    quota: int


def quotas(have: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> list[Plan]:
    """Quotas in tokens so that every source has its share of the largest total the repeats allow.

    Sources without documents or without a positive target cannot take part: the shares of the
    others are kept in proportion.  With ``total`` given, that total is aimed at; sources whose
    repeats end before their share is reached give what they have.
    """
    usable = [(s, w, r) for s, w, r in targets if have.get(s, 0) > 0 and w and w > 0 and r and r > 0]
    weight = sum(w for _, w, _ in usable)
    if total is None:
        total = min((int(have[s] * r / (w / weight)) for s, w, r in usable), default=0)
    part = {s: min(have[s] * r, round(total * w / weight)) for s, w, r in usable}
    return [Plan(s, w or 0.0, have.get(s, 0), r or 0, part.get(s, 0)) for s, w, r in targets]


def mix(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    total: int | None = None, seed: int = 11, shards: int = SHARDS, blocks: int = BLOCKS, path: str | None = None, pattern: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: ``doc_id, source, tokens, copy, shard, position`` - one row per use of a document,
    ``copy`` counting its uses from 1 to at most the source's ``max_repeats``.  report: one row
    per target source with target and actual share, tokens and documents available and used,
    and the most uses of one document.

    Sources are compared in plain form (lower case, blanks and separators as underscores).
    Documents of other sources, or without a source, are left out; documents with null or empty
    text have no tokens and join the mixture in the passes that use all of their block; target
    sources without documents are reported with actual share 0; target rows repeated for one
    source count once (the first by share and repeats); null shares or repeats count as 0.
    Repeated documents are documents of their own.
    """
    spark = docs.sparkSession
    wanted = {}
    for r in targets.select(source, "target_share", "max_repeats").filter(F.col(source).isNotNull()).orderBy(source, "target_share", "max_repeats").limit(10_001).collect():
        wanted.setdefault(_plain_text(r[0]), (float(r[1] or 0.0), int(r[2] or 0)))
    if len(wanted) > 10_000:
        raise ValueError("more than 10000 target sources")
    plain = F.regexp_replace(F.lower(F.trim(F.col(source))), r"[\s\-_./]+", "_").alias("source")
    block = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(blocks)).cast("int").alias("_b")
    named = docs.select(doc_id, text, plain, block).filter(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
    sized = checkpointed(token_counts(named, doc_id, text, [F.col("source"), F.col("_b")], path, pattern))
    per_block = {(r["source"], r["_b"]): int(r["t"]) for r in sized.groupBy("source", "_b").agg(F.sum("tokens").alias("t")).collect()}
    have: dict[str, int] = {}
    for (s, _), t in per_block.items():
        have[s] = have.get(s, 0) + t
    plans = quotas(have, [(s, w, r) for s, (w, r) in wanted.items()], total)
    copies = _uses(plans, per_block, seed)
    pieces = {s: max(1, -(-blocks // max(1, len(c)))) for s, c in copies.items()}
    copies = {s: [(*use, k) for use in c for k in range(pieces[s])] for s, c in copies.items()}
    dealt = split_tree(np.array([len(c) for c in copies.values()] or [0]), shards, np.random.default_rng(seed))
    placed = []
    for no, uses in enumerate(copies.values()):
        order = np.random.default_rng([seed, no]).permutation(len(uses))
        shard_of = np.repeat(np.arange(shards), dealt[:, no])
        placed += [(*uses[i], int(s)) for i, s in zip(order, shard_of)]
    use = _local(spark, placed, "source string, _b int, copy int, _cut long, _piece int, shard int")
    in_pieces = bounded(_local(spark, list(pieces.items()), "source string, _pieces int"))
    sized = sized.join(in_pieces, "source").withColumn("_piece", F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed + 3)), F.col("_pieces")).cast("int")).drop("_pieces")
    # a block that is used in part is cut where its documents, in hashed order, have reached the rest of the quota
    cut_blocks = _local(spark, sorted({(s, b, c) for s, b, _, c, _, _ in placed if c is not None}), "source string, _b int, _cut long")
    order = F.xxhash64(F.col(doc_id), F.lit(seed + 1))
    # (in ranges of the hash, so that only the range holding the cut is ordered document by document)
    at_cut = sized.join(bounded(cut_blocks), ["source", "_b"]).withColumn("_h", order).withColumn("_sub", F.shiftright("_h", 54))
    before = W.partitionBy("source", "_b").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    ranges = at_cut.groupBy("source", "_b", "_sub", "_cut").agg(F.sum("tokens").alias("_t"))
    ranges = ranges.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).filter("_off <= _cut").select("source", "_b", "_sub", "_off")
    inside = W.partitionBy("source", "_b", "_sub").orderBy("_h", doc_id).rowsBetween(W.unboundedPreceding, 0)
    cut = (
        at_cut.join(ranges, ["source", "_b", "_sub"])
        .withColumn("_run", F.col("_off") + F.sum("tokens").over(inside))
        .filter(F.col("_run") - F.col("tokens") / 2 <= F.col("_cut"))
        .select(doc_id, "source", "tokens", "_b", "_piece")
    )
    whole = sized.join(bounded(use.filter("_cut is null").drop("_cut")), ["source", "_b", "_piece"])
    part = cut.join(bounded(use.filter("_cut is not null").drop("_cut")), ["source", "_b", "_piece"])
    cols = [doc_id, "source", "tokens", "copy", "shard"]
    mixture = whole.select(*cols).unionByName(part.select(*cols)).withColumn("position", F.xxhash64(F.col(doc_id), "copy", F.lit(seed + 2)))
    used = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("most_uses"))
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    base = _local(spark, [(p.source, p.target, p.repeats, p.quota) for p in plans], "source string, target_share double, max_repeats int, quota long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    all_used = F.sum(F.coalesce("tokens_used", F.lit(0))).over(W.partitionBy())
    report = (
        base.join(there, "source", "left").join(used, "source", "left")
        .select("source", "target_share", F.coalesce(F.try_divide(F.coalesce("tokens_used", F.lit(0)), all_used), F.lit(0.0)).alias("actual_share"),
                zero("documents"), zero("tokens"), "quota", zero("tokens_used"), zero("uses"), "max_repeats", zero("most_uses"))
    )
    return mixture, report


def _plain_text(s: str) -> str:
    import re

    return re.sub(r"[\s\-_./]+", "_", s.strip(" ").lower())


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _uses(plans: list[Plan], per_block: dict[tuple[str, int], int], seed: int) -> dict[str, list[tuple]]:
    """Per source its block copies (source, block, copy, cut); cut is null for a whole block."""
    copies: dict[str, list[tuple]] = {}
    for no, p in enumerate(plans):
        blocks = sorted(b for s, b in per_block if s == p.source)
        out: list[tuple] = []
        if p.quota > 0 and p.tokens > 0:
            passes, left = divmod(p.quota, p.tokens)
            out += [(p.source, b, c + 1, None) for c in range(int(passes)) for b in blocks]
            for b in np.random.default_rng([seed, 1, no]).permutation(blocks).tolist() if left else []:
                size = per_block[p.source, b]
                out.append((p.source, b, int(passes) + 1, None if size <= left else int(left)))
                left -= min(size, left)
                if left <= 0:
                    break
        copies[p.source] = out
    return copies
