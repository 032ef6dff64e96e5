"""Toxicity: a classifier learned from confirmed toxic examples and unlabelled text.

Non-negative positive-unlabelled learning: with class prior p, positives P and unlabelled U, a linear model
minimises  p R_P(+) + max(0, R_U(-) - p R_P(-)).  Where the second part falls below zero, the step goes
the other way, which is what keeps the model from fitting the positives by heart.

A text's features are its distinct words and the first four, five and six letters of its longer words,
hashed. One rule says which of them the model weighs, at every size: those that have a posterior of one half at
least (by the share of all confirmed and of all documents that hold them), and whose number among the unlike
confirmed texts exceeds what all documents let expect, at the level that chance gives to `BY_CHANCE` of the features tested, and to `SHARE` of them at most. Near copies
of a text are one piece of evidence.

Nothing is sampled. U is all documents and P all confirmed ones: both enter the risk as counts of the distinct sets of
weighed features, of which most documents have none. These counts are fitted on the driver where they are few
(`LOCAL_FEATURES`), else each step is a job over them; both are the same sums.

Defined results:
- a null or empty text has no features: its score is the model's intercept, it isn't toxic;
- a very long text is read whole; its features count once each, so length by itself adds nothing;
- a score of exactly 0 isn't toxic; repeated rows: each counts and is scored for itself;
- labels: a doc_id is confirmed if toxic is 1 in all its non-null rows; null ids match nothing;
- no confirmed example, or no feature that tells them apart: nothing is toxic, every score is -1;
- an empty table gives an empty result; further columns pass through `filter_toxic` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut
from .quality import BROADCAST_IDS, among
from .textgrid import WORD, chunks, mix, tokenise

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
STEPS, RATE, DECAY = 300, 0.05, 1e-7
#: Features among all that confirmed texts have which chance alone may let in, and the share of them at most.
BY_CHANCE, SHARE = 1.0, 1e-3
#: Features in all distinct sets, up to which the driver takes the sets (4 bytes each).
LOCAL_FEATURES = 4_000_000


@dataclass
class Model:
    weights: np.ndarray  # float32, one a bucket, nearly all 0
    bias: float
    prior: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and word beginning, and the index of its text."""
    t = tokenise(texts)
    word = t.cls == WORD
    t.start, t.end, t.doc = t.start[word], t.end[word], t.doc[word]
    found, docs, end = [t.hashes()], [t.doc], t.end
    for k in PREFIXES:
        longer = end - t.start > k
        t.end = np.minimum(end, t.start + k)
        found.append(t.hashes()[longer] + np.uint64(k))
        docs.append(t.doc[longer])
    return (mix(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(docs)


def confirmed_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("t")).where("t = 1").select("doc_id")


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of all texts, and where each text's begin, and the last one's end."""
    at, doc = features(texts)
    key = np.sort(doc * BUCKETS + at)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key % BUCKETS, np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)


def _confirmed(docs: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """text of each confirmed document."""
    texts = docs.select("text", F.col("doc_id").cast("long").alias("_id"))
    if ids.count() > broadcast_ids:
        known = ids.select(F.col(ids.columns[0]).alias("_known")).hint("merge")
        return texts.join(known, F.col("_id") == F.col("_known"), "left_semi").select("text")
    known = among(docs.sparkSession, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(known(b.column(1))))], ["text"])

    return texts.mapInArrow(run, "text string")


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: its features, and three keys, one at least of which it shares with most of its near copies."""
    odd = mix(np.arange(1, 10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in chunks(texts):
            at, cut_at = bags(texts[lo:hi])
            has = np.flatnonzero(np.diff(cut_at))
            keys = np.zeros((3, hi - lo), np.int64)
            if len(has):
                h = mix(at.astype(np.uint64))
                mins = [np.minimum.reduceat(mix(h * a), cut_at[has]) for a in odd]
                for k in range(3):
                    keys[k, has] = mix(mins[3 * k] + mix(mins[3 * k + 1] + mix(mins[3 * k + 2]))).astype(np.int64)
            low = at.astype("<i4").tobytes()
            sets = [low[4 * x : 4 * y] for x, y in zip(cut_at[:-1], cut_at[1:])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(sets, pa.binary())], ["k0", "k1", "k2", "set"])


def _tally(places: bytes, width: int) -> np.ndarray:
    return np.bincount(np.frombuffer(places, "<i4"), minlength=width)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # One place more for the number of texts.
    n = np.zeros(BUCKETS + 1, np.int64)
    for b in batches:
        n[-1] += b.num_rows
        for lo in range(0, b.num_rows, 200):
            n[:-1] += _tally(b"".join(b.column(0).slice(lo, 200).to_pylist()), BUCKETS)
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen])], ["bucket", "n"])


def _counts(sets: DataFrame) -> np.ndarray:
    """Texts that have each feature, and their number. A row a bucket at most comes to the driver, whatever the input."""
    t = sets.select("set").mapInArrow(_unpack, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[t["bucket"].to_numpy()] = t["n"].to_numpy()
    return out


def _sets(chosen: np.ndarray):
    """doc_id and the chosen features of each text: their places, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for b in batches:
            texts = b.column(1).to_pylist()
            sets: list[bytes] = []
            for lo, hi in chunks(texts):
                at, doc = features(texts[lo:hi])
                at = place[at]
                hit = at >= 0
                key = np.unique(doc[hit] * BUCKETS + at[hit])
                low = (key % BUCKETS).astype("<i4").tobytes()
                cut_at = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
                sets += [low[4 * x : 4 * y] for x, y in zip(cut_at[:-1], cut_at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return run


def _count(wanted: np.ndarray):
    """How many of the texts hold each of the wanted features, counted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(wanted)
        place, total = np.full(BUCKETS, -1, np.int32), np.zeros(n, np.int64)
        place[wanted] = np.arange(n)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in chunks(texts):
                at, doc = features(texts[lo:hi])
                at = place[at]
                hit = at >= 0
                key = np.sort(doc[hit] * n + at[hit])
                if len(key):
                    total += np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % n, minlength=n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["at", "n"])

    return run


def _ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of a Poisson rate of its own against that of all documents; 0 where it isn't higher."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(seen > expected, 2 * (np.where(seen, seen * np.log(seen / expected), 0) - seen + expected), 0)


def select(docs: DataFrame, confirmed: DataFrame, prior: float) -> np.ndarray:
    """The features that the model weighs, ascending; confirmed as _evidence has them."""
    kp = _counts(confirmed)
    unlike = confirmed.where("length(set) > 0")
    for k in ("k0", "k1", "k2"):
        unlike = unlike.groupBy(k).agg(F.min(F.struct("k0", "k1", "k2", "set")).alias("_row")).select("_row.*")
    seen = _counts(unlike)
    at, n_u = np.flatnonzero(kp[:-1]), docs.count()
    least = least_ratio(len(at))
    # A feature is in as many documents as in confirmed ones at least; those that can't be significant even so aren't counted.
    at = at[_ratio(seen[at], seen[-1] * (kp[at] / max(n_u, 1))) >= least]
    if not len(at):
        return at
    t = docs.select("text").mapInArrow(_count(at), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    ku = np.zeros(len(at), np.int64)
    ku[t["at"].to_numpy()] = t["n"].to_numpy()
    # As U holds its share of positives, a feature of toxic texts only has prior * share_p = share_u.
    fits = 2 * prior * (kp[at] / kp[-1]) >= ku / n_u
    return at[fits & (_ratio(seen[at], seen[-1] * (ku / n_u)) >= least)]


def least_ratio(tested: int) -> float:
    """The doubled log-likelihood ratio that chance gives to as many as may get in: a quantile of chi squared with one degree of freedom."""
    lo, hi, level = 0.0, 100.0, min(SHARE, BY_CHANCE / max(tested, 1))
    while hi - lo > 1e-6:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > level else (lo, mid)
    return hi


@dataclass
class Sums:
    """Of rows of sets: what a step of the fit needs, not yet divided by the numbers of documents."""

    loss_u: float
    loss_p: float
    up: np.ndarray  # a place for each feature and one for the intercept
    pp: np.ndarray


class Part:
    """Some of the sets, as one list of places."""

    def __init__(self, sets: list[bytes], u: np.ndarray, p: np.ndarray, width: int):
        size = np.array([len(x) // 4 for x in sets], np.int64)
        self.at, self.row = np.frombuffer(b"".join(sets), "<i4"), np.repeat(np.arange(len(sets)), size)
        self.u, self.p, self.width = u.astype(float), p.astype(float), width

    def total(self, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.at, weights=by_row[self.row], minlength=self.width), by_row.sum())

    def sums(self, w: np.ndarray) -> Sums:
        z = np.bincount(self.row, weights=w[self.at], minlength=len(self.u)) + w[-1]
        soft, sig = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return Sums(float(self.u @ soft), float(self.p @ soft), self.total(self.u * sig), self.total(self.p * sig))


def _job(table: DataFrame, width: int) -> Callable[[np.ndarray], Sums]:
    """The same sums by a job over the table of sets."""

    def sums(w: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width + 2))
            for b in batches:
                s = Part(b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy(), width).sums(w)
                total += np.array([np.append(s.up, s.loss_u), np.append(s.pp, s.loss_p)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 2)), pa.array(total[0]), pa.array(total[1])], ["at", "u", "p"])

        t = table.mapInArrow(run, "at long, u double, p double").groupBy("at").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).orderBy("at").toArrow()
        u, p = t["u"].to_numpy(), t["p"].to_numpy()
        return Sums(u[-1], p[-1], u[:-1], p[:-1])

    return sums


def descend(sums: Callable[[np.ndarray], Sums], mean_p: np.ndarray, n_u: int, n_p: int, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights, the intercept last. loss(+) of a score z is log(1 + exp(-z)), loss(-) is log(1 + exp(z))."""
    w = np.append(np.zeros(len(mean_p) - 1), -1.0)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        s = sums(w)
        if s.loss_u / n_u - prior * s.loss_p / n_p >= 0:
            g = s.up / n_u - prior * mean_p
        else:
            g = prior * s.pp / n_p - s.up / n_u
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Fitted:
    model: Model
    chosen: np.ndarray
    sets: DataFrame | None  # doc_id, set of each document, where the model weighs anything


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None, broadcast_ids: int = BROADCAST_IDS, local_features: int = LOCAL_FEATURES, steps: int = STEPS) -> Fitted:
    if prior is None:
        prior = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("t")).agg(F.avg("t")).first()[0] or 0.0
    prior = float(prior)
    none = Fitted(Model(np.zeros(BUCKETS, np.float32), -1.0, prior), np.zeros(0, np.int64), None)
    if not 0 < prior < 1:
        return none
    confirmed = cut(_confirmed(docs, confirmed_ids(labels), broadcast_ids).mapInArrow(_evidence, "k0 long, k1 long, k2 long, set binary"))
    chosen = select(docs, confirmed, prior)
    if not len(chosen):
        return none
    width = len(chosen)
    sets = cut(docs.select("doc_id", "text").mapInArrow(_sets(chosen), "doc_id long, set binary"))
    table = sets.groupBy("set").agg(F.count("*").alias("u")).select("set", "u", F.lit(0).cast("long").alias("p"))
    of_p = confirmed.select("set").mapInArrow(_places(chosen), "set binary").groupBy("set").agg(F.count("*").alias("p")).select("set", F.lit(0).cast("long").alias("u"), "p")
    table = cut(table.unionByName(of_p).groupBy("set").agg(F.sum("u").alias("u"), F.sum("p").alias("p")))
    n_u, n_p, size = table.agg(F.sum("u"), F.sum("p"), F.sum(F.expr("length(set) div 4 + 4"))).first()
    mean_p = np.append(_counts(confirmed)[chosen], n_p) / n_p
    if size <= local_features:
        rows = table.orderBy("set").toArrow()
        sums = Part(rows["set"].to_pylist(), rows["u"].to_numpy(), rows["p"].to_numpy(), width).sums
    else:
        sums = _job(table, width)
    w = descend(sums, mean_p, n_u, n_p, prior, steps)
    out = np.zeros(BUCKETS, np.float32)
    out[chosen] = np.round(w[:-1], 4)
    # A text without any of the features isn't toxic, whatever the prior.
    return Fitted(Model(out, min(round(float(w[-1]), 4), 0.0), prior), chosen, sets)


def _places(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for b in batches:
            found = (place[np.frombuffer(x, "<i4")] for x in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(x[x >= 0]).astype("<i4").tobytes() for x in found], pa.binary())], ["set"])

    return run


def fit(docs: DataFrame, labels: DataFrame, **fitting) -> Model:
    """prior: the share of toxic documents; by default that among all labelled ones."""
    return learn(docs, labels, **fitting).model


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for lo, hi in chunks(texts):
        at, doc = features(texts[lo:hi])
        w = model.weights[at]
        hit = w != 0
        key = np.unique(doc[hit] * BUCKETS + at[hit])
        out[lo:hi] += np.bincount(key // BUCKETS, weights=model.weights[key % BUCKETS], minlength=hi - lo)
    return out


def keep_clean(df: DataFrame, model: Model) -> DataFrame:
    """The rows of df whose text isn't toxic, with all their columns."""
    chosen = np.flatnonzero(model.weights)
    small = df.sparkSession.sparkContext.broadcast((chosen, model.weights[chosen], model.bias, model.prior))
    cache: dict[int, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in cache:
            at, w, bias, prior = small.value
            full = np.zeros(BUCKETS, np.float32)
            full[at] = w
            cache[0] = Model(full, bias, prior)
        for b in batches:
            s = scores(b.column(b.schema.get_field_index("text")).to_pylist(), cache[0])
            yield b.filter(pa.array(s <= 0))

    return df.mapInArrow(run, df.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """doc_id, score, toxic for every row of docs."""
    f = learn(docs, labels, **fitting)
    if f.sets is None:
        return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", f"{f.model.bias}D AS score", "false AS toxic")
    small = docs.sparkSession.sparkContext.broadcast((f.model.weights[f.chosen], f.model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = small.value
        for b in batches:
            sets = b.column(1).to_pylist()
            row = np.repeat(np.arange(len(sets)), [len(x) // 4 for x in sets])
            s = bias + np.bincount(row, weights=w[np.frombuffer(b"".join(sets), "<i4")], minlength=len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 4)), pa.array(s > 0)], ["doc_id", "score", "toxic"])

    return f.sets.mapInArrow(run, "doc_id long, score double, toxic boolean")


def filter_toxic(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    return keep_clean(docs, fit(docs, labels, **fitting))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
