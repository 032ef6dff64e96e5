"""Quality rules: hashed n-gram log-likelihood ratio of every document.

Two multinomials over hashed n-grams are counted, one over the trusted documents and one over the whole
corpus. A document's score is the mean, over its n-grams, of the log of their smoothed ratio, so that its
length doesn't matter; a fixed threshold decides about every document, without sampling.

The n-grams of a text are its words and punctuation runs, their pairs, and triples of their *shapes*
(upper, title, lower, number, mixed, a repeat of the token before, or the punctuation run itself).

Defined results:
- a null or empty text, or one of white space only: no n-grams, score null, rejected;
- very long texts: scored whole;
- repeated rows and doc_ids: each row is counted and decided for itself;
- labels: a doc_id is trusted if its quality is 1 in all its non-null rows; null doc_ids match nothing;
- no trusted document: there is nothing to compare with, every ratio is 0, all non-empty texts stay;
- an empty table gives an empty result; further columns pass through `filter_quality` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textgrid import PUNCT, chunks, mix, tokenise

BUCKETS = 1 << 15
THRESHOLD = -0.4
#: Added to the seen and the expected count of each bucket.
SMOOTHING = 5.0
#: Scores are sums of whole millionths, so no order of addition changes a decision.
SCALE = 1_000_000
#: Trusted ids are broadcast, as one sorted array of 8 bytes each, up to this many; beyond it their documents are found by a shuffled semi join.
BROADCAST_IDS = 5_000_000


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and the index of its text."""
    t = tokenise(texts)
    n = len(t.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = t.hashes()
    same_doc = np.empty(n, bool)
    same_doc[0] = False
    np.equal(t.doc[1:], t.doc[:-1], out=same_doc[1:])
    again = np.zeros(n, bool)
    again[1:] = same_doc[1:] & (h[1:] == h[:-1])
    kinds = np.bitwise_or.reduceat(t.case, t.start)
    first, longer = t.case[t.start], t.end - t.start > 1
    title = (first == 1) & (kinds == 3)
    shape = np.where(t.cls == PUNCT, h, np.where(title, 16, np.where((kinds == 1) & ~longer, 17, kinds)).astype(np.uint64))
    shape[again] = 18
    uni = mix(h)
    second = np.where(again, np.uint64(7), uni)
    at = np.flatnonzero(same_doc)
    bi = mix(uni[at - 1] * np.uint64(3) + second[at] + np.uint64(1))
    both = at[same_doc[at - 1]]
    s = mix(shape + np.uint64(11))
    tri = mix(s[both - 2] * np.uint64(5) + s[both - 1] * np.uint64(3) + s[both] + np.uint64(2))
    return (np.concatenate([uni, bi, tri]) % np.uint64(buckets)).astype(np.int64), np.concatenate([t.doc, t.doc[at], t.doc[both]])


def _counter(buckets: int, flag):
    """Counts of a batch's texts (column 0); flag: from column 1 to whether each row is trusted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            texts, flags = b.column(0).to_pylist(), flag(b.column(1))
            for lo, hi in chunks(texts):
                at, doc = ngrams(texts[lo:hi], buckets)
                raw += np.bincount(at, minlength=buckets)
                trusted += np.bincount(at[flags[lo:hi][doc]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), pa.array(trusted[seen])], ["bucket", "raw", "trusted"])

    return count


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_trusted_id")).agg(F.min("quality").alias("q")).where("q = 1").select(F.col("_trusted_id").cast("long"))


def among(spark: SparkSession, ids: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Whether each id of a column is one of `ids`, which go out as one sorted array; for a checked number of them."""
    known = spark.sparkContext.broadcast(np.sort(ids.select(F.col(ids.columns[0]).cast("long").alias("_id")).toArrow()["_id"].to_numpy()))

    def test(column: pa.Array) -> np.ndarray:
        own, wanted = known.value, column.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(own):
            return np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return (own[at] == wanted) & column.is_valid().to_numpy(zero_copy_only=False)

    return test


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """Log ratio of each bucket in millionths. What comes to the driver is one row a bucket, whatever the input."""
    ids = trusted_ids(labels)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    schema = "bucket int, raw long, trusted long"
    if ids.count() <= broadcast_ids:
        counted = texts.select("text", F.col("doc_id").cast("long")).mapInArrow(_counter(buckets, among(docs.sparkSession, ids)), schema)
    else:
        whole = texts.select("text", F.lit(0)).mapInArrow(_counter(buckets, lambda c: np.zeros(len(c), bool)), schema)
        semi = texts.join(ids.hint("merge"), F.col("doc_id") == F.col("_trusted_id"), "left_semi")
        part = semi.select("text", F.lit(1)).mapInArrow(_counter(buckets, lambda c: np.ones(len(c), bool)), schema).withColumn("raw", F.lit(0).cast("long"))
        counted = whole.unionByName(part)
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toLocalIterator():
        raw[r.bucket], good[r.bucket] = r.raw, r.trusted
    if not good.sum():
        return np.zeros(buckets, np.int64)
    expected = raw * (good.sum() / raw.sum())
    return np.rint(np.log((good + smoothing) / (expected + smoothing)) * SCALE).astype(np.int64)


def _scores(texts: list[str | None], llr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for lo, hi in chunks(texts):
        at, doc = ngrams(texts[lo:hi], len(llr))
        n[lo:hi] = np.bincount(doc, minlength=hi - lo)
        # Sums of whole numbers below 2**53 are exact in a double.
        total[lo:hi] = np.bincount(doc, weights=llr[at], minlength=hi - lo).astype(np.int64)
    return n, total


def decide(df: DataFrame, llr: np.ndarray, threshold: float, keep_columns: bool) -> DataFrame:
    spark, llr = df.sparkSession, llr.astype(np.int64)
    sent = spark.sparkContext.broadcast(llr)
    limit = int(round(threshold * SCALE))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = _scores(b.column(b.schema.get_field_index("text")).to_pylist(), sent.value)
            keep = (n > 0) & (total >= limit * n)
            if keep_columns:
                yield b.filter(pa.array(keep))
            else:
                mean = total / np.maximum(n, 1) / SCALE
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.round(mean, 6), mask=n == 0), pa.array(keep)], ["doc_id", "n_grams", "score", "keep"])

    if keep_columns:
        return df.mapInArrow(score, df.schema)
    return df.select("doc_id", "text").mapInArrow(score, "doc_id long, n_grams long, score double, keep boolean")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """doc_id, n_grams, score, keep for every row of docs."""
    return decide(docs, fit(docs, labels, **fitting), threshold, False)


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return decide(docs, fit(docs, labels, **fitting), threshold, True)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
