"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: a sequence of tokens has a path if, and only if, it is what the merges make of
its text. It starts as one state with a loop for each byte. Each merge (u, v) -> w, in order, puts in a
gadget: the state after u loses its arc v; every state that has an arc u gets an arc w; the state after w
has, from then on, the arcs that the state after v has at that moment. So the state after a token depends
on that token alone, and the automaton is deterministic with one state a token. Its arcs are a table of
gadgets (`left`, `right`, and the merge of a pair); an arc is expanded from it when a word first asks for
it, and kept in the transition table of the worker.

A word is encoded by transitions only: its tokens are the one path whose arcs' labels make up its bytes. Every
beginning of a path is a path, and each beginning of the word has exactly one, so one pass from left to right finds for
each place the one arc that ends there; nothing is tried twice, no merge is ever replayed. Decoding emits the labels.
The driver compiles the automaton's tables once and broadcasts them. Spelt out, its transition table would be a bit for
each pair of tokens, 312 MB for 50,000, which is why the gadgets travel and an arc is read from them.

Defined results:
- a null text has null tokens; an empty one has an empty list; both decode to themselves;
- very long texts are encoded whole; special tokens in a text are ordinary text;
- repeated rows are encoded each for itself; null ids are carried; further columns are left out;
- unpaired surrogates can't occur in Spark strings; `decode` of an id outside the vocabulary raises ValueError;
- an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words, and arcs, kept by a worker; beyond it older ones go and are made again when asked for, with the same results.
KEPT_BYTES, KEPT_ARCS = 80_000_000, 1_000_000


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabulary files of this kind."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], str]:
    """Labels by id, the merges in order as (left id, right id, id), and the pattern that splits texts, PATTERN where the file names none."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    split = [x["pattern"]["Regex"] for x in before.get("pretokenizers", [before]) if x.get("type") == "Split"]
    to = _bytes_of()
    vocab = model["vocab"]
    labels = [b""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        if all(c in to for c in s):
            labels[i] = bytes(to[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], split[0] if split else PATTERN


class Automaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        n = len(labels)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.merge: dict[int, int] = {}  # pair -> its place in the order
        self.n = n
        for k, (u, v, w) in enumerate(merges):
            self.merge.setdefault(u * n + v, k)
            if self.born[w] < 0:
                self.left[w], self.right[w], self.born[w] = u, v, k
        made = {w for _, _, w in merges}
        self.arcs: dict[int, bool] = {}
        # A token that the merges never make of its own label is on no path.
        own: dict[int, bool] = {}
        for i in sorted(range(n), key=self.born.__getitem__):
            u, v, k = self.left[i], self.right[i], self.born[i]
            own[i] = k < 0 or (own[u] and own[v] and self._has(u, v, k))
        self.ids = {b: i for i, b in enumerate(labels) if b and (len(b) == 1 or i in made and own[i])}
        # All labels that end at a place are found in one pass; bytes stand as the characters of Latin-1.
        self.matcher = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.matcher.add_word(b.decode("latin-1"), (i, len(b)))
        self.matcher.make_automaton()
        self.found = self.matcher.iter

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "found"} | {"arcs": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.found = self.matcher.iter

    def _has(self, x: int, y: int, t: int) -> bool:
        """Whether the state after x has an arc y once the gadgets before t are in."""
        left, right, born, merge, n = self.left, self.right, self.born, self.merge, self.n
        while True:
            k = merge.get(x * n + y, t)
            if k < t and born[x] < k >= born[y]:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if by >= bx:
                # y's gadget came later: x got the arc y if it then had an arc left[y]. A gadget of u, u takes its arc first.
                y, t = left[y], by + (left[y] == right[y])
            else:
                # x's gadget came later: its state has the arcs that right[x] had just then.
                x, t = right[x], bx

    def arc(self, x: int, y: int) -> bool:
        key = x * self.n + y
        ok = self.arcs.get(key)
        if ok is None:
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            ok = self.arcs[key] = self._has(x, y, 1 << 60)
        return ok

    def word(self, b: bytes) -> tuple[int, ...]:
        if (whole := self.ids.get(b)) is not None:
            return (whole,)
        arcs, arc, size = self.arcs, self.arc, self.n
        # The state that each beginning of the word leads to, which is its last token; none at the front.
        state: list[int | None] = [None] * (len(b) + 1)
        for last, (y, length) in self.found(b.decode("latin-1")):
            end = last + 1
            if state[end] is None:
                x = state[end - length]
                if length == end or x is not None and (arc(x, y) if (ok := arcs.get(x * size + y)) is None else ok):
                    state[end] = y
        out, end = [], len(b)
        while end > 0:
            out.append(y := state[end])
            end -= len(self.labels[y])
        return tuple(reversed(out))


def _classes(pattern: str) -> str:
    """The pattern for `re`, its letters, numbers and white space spelt out, of the characters up to U+FFFF."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    spelt = lambda c: "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{c}+", every))
    inside = {c: spelt(c) for c in (r"\p{L}", r"\p{N}", r"\s")}
    out, within = [], False
    for m in re.finditer(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        if m[0] in inside:
            out.append(inside[m[0]] if within else f"[{inside[m[0]]}]")
        elif m[0] == r"\S" and not within:
            out.append(f"[^{inside[chr(92) + 's']}]")
        else:
            within = m[0] == "[" or within and m[0] != "]"
            out.append(m[0])
    return "".join(out)


class Codec:
    def __init__(self, automaton: Automaton, pattern: str = PATTERN):
        self.automaton = a = automaton
        self.labels = a.labels

        class Words(dict):
            """Tokens of a word, as the bytes of int32. The words before the last KEPT_BYTES go, unless they were asked for since."""

            old: dict = {}
            size = 0

            def __missing__(self, w: str) -> bytes:
                if self.size >= KEPT_BYTES:
                    self.old = dict(self)
                    self.clear()
                    self.size = 0
                out = self.old.get(w)
                if out is None:
                    out = array("i", a.word(w.encode())).tobytes()
                self.size += 200 + len(w) + len(out)
                self[w] = out
                return out

        self.words = Words()
        self.any = regex.compile(pattern).findall
        self.bmp = re.compile(_classes(pattern)).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def split(self, text: str) -> list[str]:
        return self.any(text) if not text.isascii() and self.beyond(text) else self.bmp(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), np.intc)

    def decode(self, ids) -> str:
        ids = list(ids)
        if ids and (min(ids) < 0 or max(ids) >= len(self.labels)):
            raise ValueError("an id outside the vocabulary")
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def _codec(spark: SparkSession, path: str):
    """A function that gives the worker's codec. The driver reads the file and compiles the automaton, once."""
    labels, merges, pattern = load(path)
    sent = spark.sparkContext.broadcast((Automaton(labels, merges), pattern))
    kept: list[Codec] = []

    def get() -> Codec:
        if not kept:
            kept.append(Codec(*sent.value))
        return kept[0]

    return get


def encode(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id, n_tokens, tokens, lossless (they decode to the text) for every row of docs."""
    get = _codec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        label = c.labels.__getitem__
        for b in batches:
            texts = b.column(1)
            for lo, hi in _slices(texts):
                at, same, parts = [0], [], []
                for t in texts.slice(lo, hi - lo).to_pylist():
                    ids = c.encode(t) if t else np.zeros(0, np.int32)
                    parts.append(ids)
                    at.append(at[-1] + len(ids))
                    same.append(None if t is None else b"".join(map(label, ids.tolist())) == t.encode())
                null = pa.array([x is None for x in same] + [False])
                offsets = pa.array(at, pa.int32())
                if null.true_count:
                    offsets = pa.array([None if m else x for m, x in zip(null.to_pylist(), at)], pa.int32())
                tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts)))
                n = pa.array([None if s is None else y - x for s, x, y in zip(same, at, at[1:])], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), n, tokens, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "tokens", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, lossless boolean")


def _slices(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Slices of about so many bytes, whole texts only."""
    n = np.cumsum(np.nan_to_num(np.asarray(_lengths(texts), float)))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(n, (n[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def decode(encoded: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id, text of rows with doc_id, tokens."""
    get = _codec(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for b in batches:
            texts = [None if t is None else c.decode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
