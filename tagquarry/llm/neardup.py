"""MinHash near-duplicates by an LSH forest.

A document is the set of its word triples. `TREES` trees each order all documents by a label of `DEPTH`
min-hashes. Next to each other in such an order stand documents whose labels share the longest prefixes:
these are the candidates. The depth follows the region: where few share a prefix, all are compared at that
shallow depth; where many do, a document meets its nearest neighbours in the order, and the first document
of each longer prefix that it is in, as deep as the region's density asks for. No document is left out and
none has a limit of partners: whoever reaches a group's first document or a neighbour in it is in the group.

Each candidate pair is tested at once on a sketch, four bits of each of the TREES * DEPTH min-hashes, that
travels with the label; only pairs whose estimate comes within MARGIN of the threshold leave the task, and a pair
saves others their test only where its estimate is as far above. The distinct pairs that are left meet
the documents' sets of triples, and those whose exact similarity reaches the threshold link. Groups are the connected
components of these links, after documents with the same min-hashes (exact copies among them) have been collapsed into one.

Defined results:
- a text of one or two words is one short shingle; a null text, or one without a word, is in no group;
- very long texts are read whole;
- repeated rows: rows of one doc_id are one document (a group, if their texts differ); `drop_near_duplicates` keeps one row
  of it, by a hash of all its columns, so that their order doesn't matter;
- a null doc_id can't be named: such rows are returned with a null group, and stay;
- ties: the least doc_id of a group stays; an empty table gives an empty result;
- further columns pass through `drop_near_duplicates` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, cut
from .textgrid import WORD, chunks, mix, tokenise

TREES, DEPTH, SHINGLE = 16, 8, 3
HASHES = TREES * DEPTH
THRESHOLD = 0.5
#: Of an estimate, about four standard deviations of it at the threshold.
MARGIN = 0.2
#: Elements of a label that candidates share at least; rows that share them meet in one task.
ROOT = 2
#: Rows of the order that each row is compared with; a region of up to so many and one more is compared whole.
NEIGHBOURS = 4
#: Ids to drop are broadcast up to this many (8 bytes each); beyond it they are found by a shuffled anti join.
BROADCAST_IDS = 500_000


def _constants() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of each run of SHINGLE words, and the index of its text, ascending."""
    t = tokenise(texts)
    word = t.cls == WORD
    t.start, t.end, doc = t.start[word], t.end[word], t.doc[word]
    n = len(doc)
    if not n:
        return np.zeros(0, np.uint32), doc
    h = mix(t.hashes())
    size = np.bincount(doc, minlength=t.n_docs)
    left = np.cumsum(size)[doc] - np.arange(n)  # words from here to the end of the text
    s, end = h.copy(), np.minimum(left, SHINGLE)
    for k in range(1, SHINGLE):
        ok = np.flatnonzero(end > k)
        s[ok] = mix(s[ok] * np.uint64(3) + h[ok + k])
    whole = (left >= SHINGLE) | (left == size[doc])
    return (mix(s[whole]) >> np.uint64(32)).astype(np.uint32), doc[whole]


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """uint16 (texts, HASHES), and whether a text has any word."""
    a, b = _constants()
    out, has = np.zeros((len(texts), HASHES), np.uint16), np.zeros(len(texts), bool)
    for lo, hi in chunks(texts):
        s, doc = shingles(texts[lo:hi])
        if not len(s):
            continue
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows = lo + doc[at]
        has[rows] = True
        v = np.empty_like(s)
        for k in range(HASHES):
            np.multiply(s, a[k], out=v)
            np.add(v, b[k], out=v)
            # The least value is spread again: of long texts all would be near 0.
            out[rows, k] = mix(np.minimum.reduceat(v, at).astype(np.uint64)) >> np.uint64(48)
    return out, has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, has = signatures(b.column(1).to_pylist())
        sig = np.ascontiguousarray(sig.astype(">u2")[has])
        low = (sig & 15).astype(np.uint8)
        fixed = lambda x, n: pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), fixed(sig, 2 * HASHES), fixed(low[:, ::2] << 4 | low[:, 1::2], HASHES // 2)], ["doc_id", "sig", "sketch"])


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the rows of two sketches of four-bit values, chance agreement taken out."""
    return ((x == y).sum(1) / x.shape[1] - 1 / 16) / (1 - 1 / 16)


def _estimate(i: np.ndarray, j: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for at in range(0, len(i), 20_000):
        s = slice(at, at + 20_000)
        out[s] = similarity(sketch[i[s]], sketch[j[s]])
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, set: the distinct shingles of each text that has a word, ascending, four bytes each."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for lo, hi in chunks(texts):
            s, doc = shingles(texts[lo:hi])
            key = np.unique(doc.astype(np.uint64) << np.uint64(32) | s)
            at = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
            low = key.astype("<u4").tobytes()
            has = at[1:] > at[:-1]
            sets = [low[4 * x : 4 * y] for x, y in zip(at[:-1][has], at[1:][has])]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(has)), pa.array(sets, pa.binary())], ["id", "set"])


def shared(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Exact Jaccard similarity of each set of x and the set of y at its place."""
    sizes = [np.array([len(v) // 4 for v in z], np.int64) for z in (x, y)]
    rows = (np.repeat(np.arange(len(z), dtype=np.uint64), n) << np.uint64(32) | np.frombuffer(b"".join(z), "<u4") for z, n in zip((x, y), sizes))
    key = np.sort(np.concatenate([*rows]), kind="stable")  # two ascending runs, merged
    both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(x))
    return both / np.maximum(sizes[0] + sizes[1] - both, 1)


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                ok = shared(c.column(2).to_pylist(), c.column(3).to_pylist()) >= threshold
                yield pa.RecordBatch.from_arrays([c.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs of which any texts have so much of their shingles in common."""
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    sets = docs.join(asked.hint("merge"), docs["doc_id"] == asked["_id"], "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, set binary")
    sets = cut(sets.repartition("id"))
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    return two.select("a", "b", "x", "y").mapInArrow(_exact(threshold), "a long, b long")


def _neighbours(threshold: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths = range(ROOT, DEPTH + 1)
        # Rows kept from earlier batches: the current head of each depth, then the last `window` rows.
        ids, lab, sk, n_heads = np.zeros(0, np.int64), np.zeros((0, DEPTH + 1), np.uint16), np.zeros((0, HASHES), np.uint8), 0
        for b in batches:
            if not b.num_rows:
                continue
            two = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, HASHES // 2)
            tree = np.asarray(b.column(0).to_numpy(), np.int64)
            own = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(b.num_rows, DEPTH)
            old = len(ids)
            ids = np.concatenate([ids, b.column(2).to_numpy()])
            lab = np.concatenate([lab, np.column_stack([tree.astype(np.uint16), own.astype(np.uint16)])])
            sk = np.concatenate([sk, np.stack([two >> 4, two & 15], 2).reshape(b.num_rows, HASHES)])
            n = len(ids)
            new = np.arange(old, n)

            def lcp(i, j):
                eq = lab[i] == lab[j]
                return np.where(eq.all(1), DEPTH, np.argmin(eq, 1) - 1)

            prev = np.full(n, -1)
            if old > n_heads:
                prev[old] = lcp(np.array([old]), np.array([old - 1]))[0]
            prev[old + 1 :] = lcp(new[1:], new[:-1])
            linked = np.full(n, -1)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            heads, last = [], None
            for k, d in enumerate(depths):
                h = np.maximum.accumulate(np.where(prev[old:] < d, new, k if n_heads else -1))
                heads.append(int(h[-1]))
                todo = np.flatnonzero((h != new) & (linked[old:] < 0) & ((h != last) if last is not None else True))
                e = _estimate(new[todo], h[todo], sk)
                sure, ok = todo[e >= threshold + MARGIN], todo[e >= threshold - MARGIN]
                linked[new[sure]] = h[sure]
                found.append((new[ok], h[ok]))
                last = h
            for k in range(1, window + 1):
                i = new[new - k >= n_heads]
                j = i - k
                near = (lcp(i, j) >= ROOT) & ~((linked[i] >= 0) & ((linked[i] == linked[j]) | (linked[i] == j)))
                i, j = i[near], j[near]
                ok = _estimate(i, j, sk) >= threshold - MARGIN
                found.append((i[ok], j[ok]))
            i, j = (np.concatenate([f[x] for f in found]) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])
            keep = np.r_[heads, np.arange(max(n - window, old if old <= n_heads else n_heads), n)]
            ids, lab, sk, n_heads = ids[keep], lab[keep], sk[keep], len(heads)

    return run


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, window: int = NEIGHBOURS) -> DataFrame:
    """doc_id, group_id (the least doc_id of the group), group_size, keep: for each distinct doc_id."""
    signed = cut(docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_sign, "doc_id long, sig binary, sketch binary"))
    reps = cut(signed.groupBy("sig", "sketch").agg(F.min("doc_id").alias("rep")))
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = reps.select(trees, "rep", "sig", "sketch").select("tree", F.expr(f"substring(sig, 1 + tree * {2 * DEPTH}, {2 * DEPTH})").alias("label"), "rep", "sketch")
    ordered = rows.repartition(F.col("tree"), F.expr(f"substring(label, 1, {2 * ROOT})")).sortWithinPartitions("tree", "label", "rep")
    pairs = ordered.mapInArrow(_neighbours(threshold, window), "a long, b long")
    # Copies of one sketch, and rows of one doc_id with several texts, hang on their representative.
    copies = signed.select("doc_id", "sig").join(reps.select("sig", "rep"), "sig").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(verified(pairs, docs, threshold).unionByName(copies))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    whole = ids.join(roots, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    sizes = whole.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return whole.join(sizes, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row of each group, with all its columns."""
    out = cut(near_duplicate_groups(docs, threshold).where("NOT keep").select(F.col("doc_id").alias("_drop")))
    hint = F.broadcast(out) if out.count() <= broadcast_ids else out.hint("merge")
    left = docs.join(hint, docs["doc_id"] == hint["_drop"], "left_anti")
    again = cut(docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return left
    hint = F.broadcast(again) if again.count() <= broadcast_ids else again.hint("merge")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_row")
    once = left.join(hint, left["doc_id"] == hint["_again"], "left_semi").groupBy("doc_id").agg(least).select("_row.*")
    return left.join(hint, left["doc_id"] == hint["_again"], "left_anti").unionByName(once)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
