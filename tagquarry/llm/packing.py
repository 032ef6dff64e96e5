"""Packing: documents into sequences of equal attention cost.

A piece of n tokens costs  LINEAR * n + QUADRATIC * n * n  (attention is within a document only). A document
beyond the capacity is first cut into pieces of the capacity. The pieces are spread over shards by a hash;
in each shard, pieces in descending order go to the sequence of lowest cost so far among those with room; a
new sequence is opened if none has. A shard starts with as many sequences as its tokens need at least.
The number of shards follows the tokens, so no task's work grows with the input, and all shards have
sequences of like cost because each holds a random share of all pieces.

Defined results:
- a text's tokens are its words (letters, marks, digits) and its other visible characters, each one token;
- a null or empty text has no token and is in no sequence;
- very long texts are cut, never shortened; chunk numbers the pieces of a document from 0, first is its first token;
- ties: equal pieces go in the order of doc_id (null last), chunk; equal sequences are filled in the order of their numbers;
- repeated rows and null doc_ids are packed each for itself, spread over the shards like others; further columns are left out;
- an empty table, or one without a token, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut

CAPACITY = 2048
#: Cost of a token in the layers that are linear in the length, and of a pair of tokens in attention, in millionths.
LINEAR, QUADRATIC = 1000, 1
#: Tokens of a shard, about: 2,000 sequences.
SHARD_TOKENS = CAPACITY * 2000
#: Equal rows that one task numbers.
BLOCK = 1 << 20
SCHEMA = "shard int, seq int, slot int, doc_id long, chunk int, first long, n_tokens int, cost long, seq_tokens int, seq_cost long"
_KINDS = [(c.split()[0], {"int": np.int32, "long": np.int64}[c.split()[1]]) for c in SCHEMA.split(", ")]


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]")), F.lit(0)).cast("long")


def assign(sizes: np.ndarray, capacity: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> np.ndarray:
    """The sequence of each piece; sizes descending, none beyond the capacity."""
    s = sizes.astype(np.int64)
    n = max(1, -(-int(s.sum()) // capacity))
    cost, room = np.zeros(n, np.int64), np.full(n, capacity, np.int64)
    out = np.empty(len(s), np.int64)
    far = np.iinfo(np.int64).max
    for i, x in enumerate(s.tolist()):
        k = int(cost.argmin())
        if room[k] < x:
            k = int(np.where(room >= x, cost, far).argmin())
            if room[k] < x:
                k = len(cost)
                cost, room = np.append(cost, 0), np.append(room, capacity)
        cost[k] += linear * x + quadratic * x * x
        room[k] -= x
        out[i] = k
    return out


def _packer(capacity: int, linear: int, quadratic: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.select(["shard", "doc_id", "chunk", "first", "n_tokens"]).take(pc.sort_indices(t, sort_keys=[("n_tokens", "descending"), ("doc_id", "ascending"), ("chunk", "ascending")]))
        size = t["n_tokens"].to_numpy().astype(np.int64)
        seq = assign(size, capacity, linear, quadratic)
        cost = linear * size + quadratic * size * size
        order = np.argsort(seq, kind="stable")
        start = np.flatnonzero(np.r_[True, seq[order][1:] != seq[order][:-1]])
        slot = np.empty(len(seq), np.int64)
        slot[order] = np.arange(len(seq)) - np.repeat(start, np.diff(np.r_[start, len(seq)]))
        total = lambda x: np.bincount(seq, weights=x)[seq]
        new = {"seq": seq, "slot": slot, "cost": cost, "seq_tokens": total(size), "seq_cost": total(cost)}
        return pa.Table.from_arrays([t[n] if n not in new else pa.array(new[n].astype(kind)) for n, kind in _KINDS], [n for n, _ in _KINDS])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: its shard and sequence, its place there, document, chunk, first token, tokens and cost, and its sequence's tokens and cost."""
    sized = docs.select(F.col("doc_id").cast("long"), n_tokens(F.col("text")).alias("_n")).where("_n > 0")
    # Rows that nothing tells apart are counted, and numbered as they are drawn out again, so that no shard gets all of them.
    sized = cut(sized.groupBy("doc_id", "_n").agg(F.count("*").alias("_times")))
    total, most = sized.agg(F.sum(F.expr("_n * _times")), F.max("_times")).first()
    shards = max(1, -(-(total or 0) // shard_tokens))
    times = sized.select("doc_id", "_n", "_times", F.explode(F.expr(f"sequence(0L, (_times - 1) div {BLOCK})")).alias("_b"))
    if (most or 0) > BLOCK:
        times = times.repartition("doc_id", "_n", "_b")
    times = times.select("doc_id", "_n", F.explode(F.expr(f"sequence(_b * {BLOCK}, least(_times, (_b + 1) * {BLOCK}) - 1)")).alias("_t"))
    pieces = times.select("doc_id", "_n", "_t", F.explode(F.expr(f"sequence(0L, (_n - 1) div {capacity})")).alias("_c"))
    pieces = pieces.selectExpr("doc_id", "cast(_c AS int) AS chunk", f"_c * {capacity} AS first", f"cast(least(_n - _c * {capacity}, {capacity}) AS int) AS n_tokens", f"cast(pmod(xxhash64(doc_id, _c, _n, _t), {shards}) AS int) AS shard")
    return pieces.groupBy("shard").applyInArrow(_packer(capacity, linear, quadratic), SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
