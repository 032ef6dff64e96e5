"""Approximate nearest neighbours by learned partitions.

On a sample, the graph of nearest neighbours is built by brute force and cut into parts of equal size that
sever few of its edges: balanced k-means gives the first cut, then nodes move to the part that most of their
neighbours are in, within the parts' capacity. A small classifier (one hidden layer, numpy) learns, for each
sample vector, the parts of itself and its neighbours. It routes all rows: a row is stored in its most
probable part, and as a query it visits its most probable parts, as many as it takes to reach a total
probability. That total is set on held-out rows of the sample, so that `TARGET` of their true neighbours lie
in the parts visited: queries that are easy to route visit few parts, hard ones many. In the parts visited a
query is compared with every row; the best `K` are its neighbours, by cosine.

The number of parts grows with the square root of the rows, up to the sample's `ROWS_A_PART`. A part is
compared in slabs of about `SLAB` rows on either side, each pair of slabs in a task of its own.

Defined results:
- a vector that is null, empty, of another length than most, all zeros, or with a null, NaN or infinite
  element has no neighbours and is nobody's neighbour;
- rows with a null vec_id likewise, as they can't be named;
- repeated rows: of rows with one vec_id and vector one counts; rows with one vec_id and several vectors each
  ask and answer, and the id's best `K` count; an id is never its own neighbour;
- ties, at five digits: the lesser id is nearer; fewer than K others give fewer neighbours; an empty table an empty result;
- further columns are left out. Vectors of any length are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut

K = 10
#: Rows that the classifier is fitted on, at most; taken in the order of a hash of the id.
SAMPLE = 20_000
#: Share of the held-out rows' neighbours that the parts visited hold.
TARGET = 0.93
#: Of the sample, in each part at least.
ROWS_A_PART = 32
#: Rows of the sample that the total probability is set on, one in so many.
HELD = 10
HIDDEN, EPOCHS, NEAR = 64, 12, 10
BLOCK, SLAB = 4096, 65_536


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by dot product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, m: int, slack: float = 1.1, rounds: int = 15) -> np.ndarray:
    """The part, of m, of each node of the neighbour graph; no part has more than slack times its share."""
    n, room = len(x), math.ceil(slack * len(x) / m)
    rng = np.random.default_rng(7)
    centre = x[rng.choice(n, m, replace=False)]
    for _ in range(10):
        part = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, part, x)
        size = np.bincount(part, minlength=m)
        lost = np.flatnonzero(size == 0)
        total[lost] = x[rng.choice(n, len(lost), replace=False)]
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    # Who is surest of its part goes first; a full part sends the rest to their next.
    s = x @ centre.T
    wish = np.argsort(-s, 1)[:, : min(m, 64)]
    part, free = np.full(n, -1), np.full(m, room)
    for i in np.argsort(-s.max(1), kind="stable"):
        for p in wish[i]:
            if free[p]:
                break
        else:
            p = int(free.argmax())
        part[i] = p
        free[p] -= 1
    for _ in range(rounds):
        votes = np.zeros((n, m), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        own, best = votes[np.arange(n), part], votes.argmax(1)
        gain = votes[np.arange(n), best] - own
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if free[best[i]]:
                free[part[i]] += 1
                free[best[i]] -= 1
                part[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer; probabilities of the parts."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray):
        self.w, self.mass = (w1, b1, w2, b2), 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of each row, the most probable first, and the total probability before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, 1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(p, 1) - p

    def calibrate(self, x: np.ndarray, parts: np.ndarray, target: float) -> None:
        """parts: those of the true neighbours of each row of x."""
        order, before = self.ranked(x)
        place = np.argsort(order, 1)
        need = np.take_along_axis(before, np.take_along_axis(place, parts, 1), 1)
        self.mass = float(np.quantile(need, target, method="higher")) + 1e-9


def train_router(x: np.ndarray, part: np.ndarray, near: np.ndarray, m: int, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Router:
    """Cross entropy against the parts of a row and of its neighbours, by Adam."""
    rng = np.random.default_rng(11)
    n, d = x.shape
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, m)), np.zeros(m)]
    w = [a.astype(np.float32) for a in w]
    first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    goal = np.zeros((n, m), np.float32)
    k = near.shape[1]
    np.add.at(goal, (np.repeat(np.arange(n), k), part[near].ravel()), np.float32(0.5 / k))
    goal[np.arange(n), part] += np.float32(0.5)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            xb = x[rows]
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - goal[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for a, grad in enumerate((xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                first[a] = 0.9 * first[a] + 0.1 * grad
                second[a] = 0.999 * second[a] + 0.001 * grad * grad
                w[a] = (w[a] - 0.003 * (first[a] / (1 - 0.9**step)) / (np.sqrt(second[a] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Router(*w)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), d)


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the vectors that can be compared, of length 1."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND size(x) > 0 AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))")
    usual = v.groupBy(F.size("x").alias("_n")).count().orderBy(F.desc("count"), "_n").limit(1).select("_n")
    v = v.join(F.broadcast(usual), F.size("x") == F.col("_n")).select("vec_id", "x", F.expr("sqrt(aggregate(x, 0D, (s, e) -> s + e * e))").alias("_l"))
    return v.where("_l > 0 AND _l < double('infinity')").selectExpr("vec_id", "transform(x, e -> cast(e / _l AS float)) AS x").distinct()


def learn(x: np.ndarray, m: int, target: float = TARGET) -> Router:
    """The router of the sample x, its rows in no order, into m parts."""
    held = max(1, len(x) // HELD)
    seen, asked = x[held:], x[:held]
    near = _graph(seen, min(NEAR, len(seen) - 1))
    router = train_router(seen, balanced_parts(seen, near, m), near, m)
    stored = router.probabilities(seen).argmax(1)
    found = np.concatenate([np.argpartition(-(asked[a : a + 512] @ seen.T), near.shape[1] - 1, 1)[:, : near.shape[1]] for a in range(0, held, 512)])
    router.calibrate(asked, stored[found], target)
    return router


def fit(v: DataFrame, n: int, sample: int = SAMPLE, target: float = TARGET) -> Router | None:
    """None where there are too few rows for two parts: all are then compared."""
    t = v.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).toArrow()
    x = _matrix(t["x"].combine_chunks(), len(t["x"][0]))
    m = min(max(1, math.isqrt(n) // 8), len(x) // ROWS_A_PART)
    return learn(x, m, target) if m > 1 else None


def best(x: np.ndarray, mine: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and cosine of the k best of each x; ids ascending, equal cosines in their order."""
    rows, found, score = [], [], []
    for a in range(0, len(x), BLOCK):
        q = x[a : a + BLOCK]
        keys = np.zeros((len(q), 0), np.int64)
        for b in range(0, len(y), BLOCK):
            c = y[b : b + BLOCK]
            s = np.rint(q @ c.T * np.float32(1e5)).astype(np.int32)
            s[mine[a : a + BLOCK, None] == ids[None, b : b + BLOCK]] = -300_000
            key = (s + 300_000) * np.int32(BLOCK) + np.arange(len(c) - 1, -1, -1, dtype=np.int32)
            if len(c) > k:
                key = -np.partition(-key, k - 1, 1)[:, :k]
            s, at = key // BLOCK, b + len(c) - 1 - key % BLOCK
            keys = np.concatenate([keys, s.astype(np.int64) << 32 | (len(y) - at)], 1)
            if keys.shape[1] > k:
                keys = -np.partition(-keys, k - 1, 1)[:, :k]
        r, w = np.nonzero(keys >> 32)
        rows.append(a + r)
        found.append(len(y) - (keys[r, w] & 0xFFFFFFFF))
        score.append(((keys[r, w] >> 32) - 300_000) / 1e5)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(score)


def best_ids(x: np.ndarray, mine: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best, but of the k best ids of each x, each at its best row of y: who finds repeated ids is asked for more."""
    if not (ids[1:] == ids[:-1]).any():
        return best(x, mine, y, ids, k)
    todo, wide, parts = np.arange(len(x)), k, []
    while len(todo):
        r, at, s = best(x[todo], mine[todo], y, ids, wide)
        order = np.lexsort((ids[at], -s, r))
        r, at, s = r[order], at[order], s[order]
        full = np.bincount(r, minlength=len(todo)) >= wide
        first = np.sort(np.unique(np.stack([r, ids[at]]), axis=1, return_index=True)[1])
        r, at, s = r[first], at[first], s[first]
        n = np.bincount(r, minlength=len(todo))
        more = full & (n < k)
        keep = ~more[r] & (np.arange(len(r)) - (np.cumsum(n) - n)[r] < k)
        parts.append((todo[r[keep]], at[keep], s[keep]))
        todo, wide = todo[more], 2 * wide
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(3))


def _rank(k: int):
    def run(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "found": [], "cosine": []})
        c = c.sort_values("vec_id", kind="stable", ignore_index=True)
        ids, mine = c["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        r, at, s = best_ids(np.stack(q["x"].to_numpy()), mine, np.stack(c["x"].to_numpy()), ids, k)
        order = np.argsort(r, kind="stable")
        r, at, s = r[order], ids[at[order]], s[order]
        cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
        return pd.DataFrame({"vec_id": mine[r[cuts]], "found": np.split(at, cuts[1:]) if len(r) else [], "cosine": np.split(s, cuts[1:]) if len(r) else []})

    return run


def neighbours(vectors: DataFrame, k: int = K, sample: int = SAMPLE, target: float = TARGET, slab: int = SLAB) -> DataFrame:
    """vec_id, rank (from 1), neighbour, cosine (5 digits): up to k rows for each vec_id."""
    v = cut(clean(vectors))
    n = v.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, neighbour long, cosine double")
    router = fit(v, n, sample, target)
    d = len(v.select("x").first()[0])
    sent = v.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for b in batches:
            if b.num_rows:
                order, before = r.ranked(_matrix(b.column(1), d)) if r else (np.zeros((b.num_rows, 1), np.int64), np.zeros((b.num_rows, 1)))
                visit = before < (r.mass if r else 1)
                offsets = np.r_[0, np.cumsum(visit.sum(1))]
                parts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(order[visit].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, parts], ["vec_id", "x", "parts"])

    routed = cut(v.mapInArrow(route, "vec_id long, x array<float>, parts array<int>"))
    use = routed.agg(F.sum(F.size("parts")).alias("asks")).first()["asks"]
    m = len(router.w[3]) if router else 1
    qs, cs = max(1, -(-use // (m * slab))), max(1, -(-n // (m * slab)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, seed: F.expr(f"cast(pmod(xxhash64(vec_id, {seed}), {n}) AS int)")
    stored = routed.select(F.col("parts")[0].alias("part"), "vec_id", "x", own(cs, 1).alias("c"), every(qs).alias("q"))
    asked = routed.select(F.explode("parts").alias("part"), "vec_id", "x", own(qs, 2).alias("q")).select("*", every(cs).alias("c"))
    at = ["part", "q", "c"]
    found = asked.groupBy(at).cogroup(stored.groupBy(at)).applyInPandas(_rank(k), "vec_id long, found array<long>, cosine array<double>")
    pairs = found.select("vec_id", F.explode(F.arrays_zip("found", "cosine")).alias("p")).select("vec_id", F.col("p.found").alias("neighbour"), F.col("p.cosine").alias("cosine"))
    one = pairs.repartition("vec_id").groupBy("vec_id", "neighbour").agg(F.max("cosine").alias("cosine"))
    # A query has at most k rows from each part it visits.
    top = one.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour"))).alias("a"))
    rows = top.select("vec_id", F.posexplode(F.slice("a", 1, k)).alias("rank", "s"))
    return rows.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("s.neighbour").alias("neighbour"), (-F.col("s.c")).alias("cosine"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
