"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts. Within a page, a run of equal blocks becomes a repeated group
`(...)+`, blocks in blocks included; what is left is the page's *shape*, in which each text is a slot. A
wrapper starts as a host's most frequent shape, and is aligned with each other shape in turn, by a longest common
subsequence: tokens that agree stay; where they don't, the tokens of either side become an optional group `(...)?`; a
block that is repeated on one side and single on the other becomes a repeated group. There are no alternatives, so the
expression is free of unions, and each shape that it was aligned with matches it. A shape is aligned with the wrapper
that has most of its tokens; one of which no wrapper has half starts another.

A slot that holds the same text on all its pages is template text if these are ENOUGH distinct pages, or all
distinct pages of the host where it has fewer, and 2 at least; all others are fields. Pages of one shape with the same
texts are one page, however often they are published. Pages are read into tokens once: their texts and slots are written to
the shared folder, with the shapes, which each task counts for itself. Only shapes are gathered by host, with the
ENOUGH least hashes of their pages' texts; a host with more than BUCKET_TOKENS tokens of shapes is spread over tasks,
like shapes together where they fit, and each task makes wrappers of its own. Pages meet their wrappers by host and shape.

Defined results:
- a null html gives null text and no field; an empty one an empty text; very long pages are read whole;
- broken markup is no error: tags count as they stand, an unclosed tag at the end is text;
- scripts, styles, templates, comments and declarations are dropped; entities are resolved; white space is one blank;
- a host with one page only (or copies of one) has nothing to compare with: all its texts are fields;
- a null url, or one without a host: all such pages are one host with an empty name;
- repeated rows and null page_ids are each extracted for themselves; ties between shapes go by their text;
- an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut, scratch
from .reputation import host_of

#: Distinct pages on which a slot's only text is taken for template text.
ENOUGH = 5
#: The table of shapes is broadcast up to about this many bytes in the JVM; beyond it pages meet their wrappers by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Tokens of the shapes that one task aligns, on average.
BUCKET_TOKENS = 200_000

# Possessive, and stopped by the next `<`, so that broken markup costs no second pass over what follows.
_TOKEN = re.compile(r"""<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|(!--)|[!?][^<>]*+>)""")
_DROPPED = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "noscript")}
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'>\s]+)""", re.I)
_ITEM = re.compile(r"</?[^>]*>|#|\(|\)\+")
SLOT = "#"


def stream(page: str) -> tuple[list[str], list[str]]:
    """The page's tokens, tags and `#` for texts, and the texts in order."""
    tokens: list[str] = []
    texts: list[str] = []
    at = 0

    def text(s: str) -> None:
        if s and not s.isspace() and (s := " ".join((html.unescape(s) if "&" in s else s).split())):
            if tokens and tokens[-1] == SLOT:
                texts[-1] += " " + s
            else:
                tokens.append(SLOT)
                texts.append(s)

    open_ended: set[str] = set()  # what has no end from here on
    look = 0
    while m := _TOKEN.search(page, look):
        look, name, end = m.end(), m[2] and m[2].lower(), m.end()
        if m[4]:
            end = -1 if "!--" in open_ended else page.find("-->", look)
            if end < 0:
                open_ended.add("!--")
                continue  # text
            end += 3
        elif name in _DROPPED and not m[1] and name not in open_ended:
            if close := _DROPPED[name].search(page, look):
                end, name = close.end(), None
            else:
                open_ended.add(name)
        if m.start() > at:
            text(page[at : m.start()])
        at = look = end
        if name:
            if m[1]:
                tokens.append(f"</{name}>")
            else:
                c = _CLASS.search(m[3]) if m[3] else None
                tokens.append(f"<{name}.{c[1]}>" if c else f"<{name}>")
    text(page[at:])
    return tokens, texts


def fold(tokens: list[str]) -> tuple[list, list[int]]:
    """The shape: tokens and repeated groups (tuples); and for each text, in order, the number of its slot in the shape."""
    out: list = []  # [item, indices of the texts in each of its slots]
    spot: dict = {}  # last place of an item in out
    last_in: dict = {}  # last repeated group whose body ends in this item: its place
    n = 0
    for t in tokens:
        if t == SLOT:
            out.append([t, [[n]]])
            n += 1
        else:
            out.append([t, []])
        while True:
            k, item = len(out) - 1, out[-1][0]
            g = last_in.get(item, -1)
            if 0 <= g < k and isinstance(out[g][0], tuple) and out[g][0][-1] == item and k - g == len(out[g][0]) and all(out[g + 1 + i][0] == x for i, x in enumerate(out[g][0])):
                slots = [s for x in out[g + 1 :] for s in x[1]]
                for own, more in zip(out[g][1], slots):
                    own += more
                del out[g + 1 :]
                continue
            p = k - spot.get(item, -1)
            s = spot.get(item, -1)
            if 0 <= s < k and out[s][0] == item and k - 2 * p + 1 >= 0 and all(out[k - i][0] == out[s - i][0] for i in range(1, p)):
                first, second = out[s - p + 1 : s + 1], out[s + 1 :]
                slots = [[*a] for x in first for a in x[1]]
                for own, more in zip(slots, [b for x in second for b in x[1]]):
                    own += more
                body = tuple(x[0] for x in first)
                del out[s - p + 1 :]
                out.append([body, slots])
                last_in[body[-1]] = len(out) - 1
                continue
            spot[item] = k
            break
    where = [0] * n
    at = 0
    for _, slots in out:
        for s in slots:
            for i in s:
                where[i] = at
            at += 1
    return [x[0] for x in out], where


def render(items) -> str:
    """A shape or wrapper as a regular expression over tokens."""
    return "".join(x if isinstance(x, str) else f"({render(x)})+" for x in items)


def parse(shape: str) -> list:
    """The inverse of render for shapes."""
    stack: list[list] = [[]]
    for t in re.findall(_ITEM, shape):
        if t == "(":
            stack.append([])
        elif t == ")+":
            body = stack.pop()
            stack[-1].append(tuple(body))
        else:
            stack[-1].append(t)
    return stack[0]


def n_slots(x) -> int:
    return int(x == SLOT) if isinstance(x, str) else sum(map(n_slots, x))


def place(items: list, block: tuple, at: int = 0) -> int:
    """Where the block stands in items, from `at` on; -1 if nowhere."""
    try:
        while True:
            at = items.index(block[0], at)
            if tuple(items[at : at + len(block)]) == block:
                return at
            at += 1
    except ValueError:
        return -1


def common(x: list, y: list, rows_kept: int = 256) -> list[tuple[int, int]]:
    """A longest common subsequence, as places in x and y. A row of the table is one whole number, a bit for each place: of 20,000 unlike tokens on either side it takes some 50 ms."""
    n = min(len(x), len(y))
    front = next((k for k in range(n) if x[k] != y[k]), n)
    back = next((k for k in range(n - front) if x[-1 - k] != y[-1 - k]), n - front)
    a, b = x[front : len(x) - back], y[front : len(y) - back]
    middle = [(j, i) for i, j in _common(b, a, rows_kept)] if len(a) > len(b) else _common(a, b, rows_kept)
    return [*((k, k) for k in range(front)), *((front + i, front + j) for i, j in middle), *((len(x) - k, len(y) - k) for k in range(back, 0, -1))]


def _common(a: list, b: list, rows_kept: int) -> list[tuple[int, int]]:
    if not a:
        return []
    masks = dict.fromkeys(a, 0)
    for j, t in enumerate(b):
        if t in masks:
            masks[t] |= 1 << j
    full = (1 << len(b)) - 1
    step = lambda v, t: ((v + (u := v & masks[t])) | (v - u)) & full
    # After a row, the places of b at which the length grows have the bit 0. Every rows_kept-th row is kept, the others are made again.
    v, kept = full, [full]
    for i, t in enumerate(a):
        v = step(v, t)
        if (i + 1) % rows_kept == 0:
            kept.append(v)
    rows: list[int] = []
    first, out, i, j = len(a) + 1, [], len(a), len(b)

    def grows(i: int, j: int) -> bool:
        nonlocal first, rows
        if not first <= i < first + len(rows):
            first = i // rows_kept * rows_kept
            rows = [kept[i // rows_kept]]
            for t in a[first : min(first + rows_kept, len(a))]:
                rows.append(step(rows[-1], t))
        return not rows[i - first] >> (j - 1) & 1

    while i and j:
        if not grows(i, j):
            j -= 1
        else:
            i -= 1
            if not grows(i, j):
                j -= 1
                out.append((i, j))
    return out[::-1]


class Wrapper:
    """Items in order, each `[item, group]`: group 0 is required, others are optional groups."""

    def __init__(self, shape: list):
        self.items = [[x, 0] for x in shape]
        self.ids: list[list[int]] = []
        self.n = 0
        for x in shape:
            self.ids.append(self._new(n_slots(x)))
        self.groups = 0

    def _new(self, k: int) -> list[int]:
        self.n += k
        return [*range(self.n - k, self.n)]

    def align(self, shape: list) -> list[int]:
        """Generalises the wrapper by a shape; returns the wrapper's slot of each of the shape's slots."""
        mine = [x for x, _ in self.items]
        shape = self._repeat(shape, mine)
        self._adopt(shape)
        mine = [x for x, _ in self.items]
        a, b = len(mine), len(shape)
        items, ids, of, met, missed = [], [], [], set(), set()
        i = j = 0
        for p, q in (*common(mine, shape), (a, b)):
            self.groups += p > i
            for x in range(i, p):
                missed.add(self.items[x][1])
                items.append([mine[x], self.items[x][1] or self.groups, True])
                ids.append(self.ids[x])
            self.groups += q > j
            for y in range(j, q):
                new = self._new(n_slots(shape[y]))
                items.append([shape[y], self.groups])
                ids.append(new)
                of += new
            if p < a:
                met.add(self.items[p][1])
                items.append(self.items[p])
                ids.append(self.ids[p])
                of += self.ids[p]
            i, j = p + 1, q + 1
        # A group of which only a part is there falls into two.
        split = {k: self.groups + n + 1 for n, k in enumerate(sorted((met & missed) - {0}))}
        self.groups += len(split)
        self.items = [[x[0], split.get(x[1], x[1]) if len(x) > 2 else x[1]] for x in items]
        self.ids = ids
        return of

    @staticmethod
    def _repeat(shape: list, mine: list) -> list:
        """Single blocks of the shape that are the body of a repeated group of the wrapper become that group."""
        for g in sorted({x for x in mine if isinstance(x, tuple)} - {x for x in shape if isinstance(x, tuple)}, key=repr):
            if (i := place(shape, g)) >= 0:
                shape = [*shape[:i], g, *shape[i + len(g) :]]
        return shape

    def _adopt(self, shape: list) -> None:
        """The same, the other way round."""
        mine = [x for x, _ in self.items]
        for g in sorted({x for x in shape if isinstance(x, tuple)} - {x for x in mine if isinstance(x, tuple)}, key=repr):
            i = place(mine, g)
            while i >= 0:
                own = self.items[i : i + len(g)]
                if len({k for _, k in own}) == 1:
                    self.items[i : i + len(g)] = [[g, own[0][1]]]
                    self.ids[i : i + len(g)] = [[s for x in self.ids[i : i + len(g)] for s in x]]
                    mine = [x for x, _ in self.items]
                    break
                i = place(mine, g, i + 1)

    def render(self) -> str:
        out, open_group = [], 0
        for x, k in self.items:
            if k != open_group:
                out.append(")?" * bool(open_group) + "(" * bool(k))
                open_group = k
            out.append(x if isinstance(x, str) else f"({render(x)})+")
        return "".join(out) + ")?" * bool(open_group)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _merged(x: list, y: list) -> list:
    """Pages, least and greatest text hashes, and least hashes of distinct pages, of one shape in two places."""
    distinct = x[3] if len(y[3]) == 1 and y[3][0] in x[3] else sorted({*x[3], *y[3]})[:ENOUGH]
    return [x[0] + y[0], [*map(min, x[1], y[1])], [*map(max, x[2], y[2])], distinct]


_READ = "page_id long, url string, host string, shape long, slots array<int>, texts array<string>, tokens string, size long, sketch long, part int, pages long, lo array<long>, hi array<long>, distinct array<long>"


def _sketch(items: list[str]) -> int:
    """The same for most shapes that are nearly alike."""
    return min((_hash(" ".join(items[i : i + 3])) for i in range(max(1, len(items) - 2))), default=0)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page, with its shape's hash, texts, and their slots; and rows of shapes, counted within the task: pages, least and greatest text hash of each slot, least hashes of distinct pages."""
    from pyspark import TaskContext

    fields = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(k) or pa.list_({"array<int>": pa.int32(), "array<long>": pa.int64(), "array<string>": pa.string()}[k])) for n, k in (x.split() for x in _READ.split(", "))])
    part = TaskContext.get().partitionId()
    seen: dict = {}
    size = 0
    batch = lambda columns: pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(columns["host"]), f.type) for f in fields], schema=fields)

    def shapes() -> pa.RecordBatch:
        hosts, said = ([k[n] for k in seen] for n in (0, 1))
        rows, read = list(seen.values()), [re.findall(_ITEM, x) for x in said]
        numbers = {"shape": [_hash(x) for x in said], "size": [len(x) for x in read], "sketch": [_sketch(x) for x in read], "pages": [r[0] for r in rows]}
        lists = {n: [r[k] for r in rows] for k, n in ((1, "lo"), (2, "hi"), (3, "distinct"))}
        return batch({"host": pa.array(hosts, pa.string()), "tokens": pa.array(said, pa.string()), "part": pa.array([part] * len(rows), pa.int32())} | {n: pa.array(x, pa.int64()) for n, x in numbers.items()} | {n: pa.array(x, pa.list_(pa.int64())) for n, x in lists.items()})

    for b in batches:
        made: list[tuple] = []
        for host, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if page is None:
                made.append((None, None, None))
                continue
            tokens, texts = stream(page)
            shape, where = fold(tokens)
            key = (host, render(shape))
            made.append((_hash(key[1]), where, texts))
            k = sum(map(n_slots, shape))
            lo, hi = [None] * k, [None] * k
            for i, t in zip(where, map(_hash, texts)):
                if lo[i] is None or t < lo[i]:
                    lo[i] = t
                if hi[i] is None or t > hi[i]:
                    hi[i] = t
            own = [_hash("\n".join(texts))]  # a text has no line break
            old = seen.get(key)
            if old is None:
                seen[key] = [1, lo, hi, own]
                size += len(key[1]) + 32 * k
            else:
                seen[key] = _merged(old, [1, lo, hi, own])
        columns = list(zip(*made)) if made else [[], [], []]
        yield batch({"page_id": b.column(0), "url": b.column(1), "host": b.column(2), "shape": pa.array(columns[0], pa.int64()), "slots": pa.array(columns[1], pa.list_(pa.int32())), "texts": pa.array(columns[2], pa.list_(pa.string()))})
        if size > 1 << 25:
            yield shapes()
            seen, size = {}, 0
    yield shapes()


def _gather(t: pa.Table) -> dict[str, list]:
    merged: dict = {}
    for shape, *row in zip(*(t[c].to_pylist() for c in ("tokens", "pages", "lo", "hi", "distinct"))):
        merged[shape] = _merged(merged[shape], row) if shape in merged else row
    return merged


def _fewer(t: pa.Table) -> pa.Table:
    """The rows of one shape from many tasks, as one."""
    row = next(iter(_gather(t).values()))
    one = t.slice(0, 1)
    for name, x in zip(("pages", "lo", "hi", "distinct"), row):
        one = one.set_column(one.schema.get_field_index(name), name, pa.array([x], t.schema.field(name).type))
    return one


def infer(t: pa.Table) -> pa.Table:
    """The wrappers of one host's shapes, or of some: for each shape, which of its slots are fields."""
    merged = _gather(t)
    order = sorted(merged, key=lambda s: (-merged[s][0], s))
    made: list[tuple[Wrapper, Counter, dict[str, list[int]]]] = []
    for s in order:
        shape = parse(s)
        tokens = Counter(shape)
        best, most = None, len(shape) / 2
        for w in made:
            if (n := sum((tokens & w[1]).values())) > most or n == most and best is None:
                best, most = w, n
        if best is None:
            w = Wrapper(shape)
            made.append((w, tokens, {s: [*range(w.n)]}))
        else:
            best[2][s] = best[0].align(shape)
            best[1].clear()
            best[1].update(x for x, _ in best[0].items)
    enough = max(2, min(ENOUGH, sum(len(m[3]) for m in merged.values())))
    rows = []
    for w, _, of in made:
        lo, hi, pages = [None] * w.n, [None] * w.n, [0] * w.n
        for s, slots in of.items():
            for i, x, y in zip(slots, merged[s][1], merged[s][2]):
                lo[i] = x if lo[i] is None else min(lo[i], x)
                hi[i] = y if hi[i] is None else max(hi[i], y)
                pages[i] += len(merged[s][3])
        field = [a != b or n < enough for a, b, n in zip(lo, hi, pages)]
        if not any(field):  # one text throughout, in several shapes
            field = [True] * len(field)
        said = w.render()
        rows += [(_hash(s), [field[i] for i in slots], _hash(said), said) for s, slots in of.items()]
    host = t["host"][0].as_py()
    columns = zip(("_shape", "_fields", "_wrapper", "_expression"), zip(*rows), (pa.int64(), pa.list_(pa.bool_()), pa.int64(), pa.string()))
    return pa.table({"_host": pa.array([host] * len(rows), pa.string())} | {n: pa.array(c, k) for n, c, k in columns})


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages and shapes as `_READ` has them, written to the shared folder."""
    folder = scratch(pages.sparkSession, "pages")
    pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(_read, _READ).write.parquet(folder)
    return pages.sparkSession.read.parquet(folder)


def learn_wrappers(read: DataFrame, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """_host, _shape (its hash), _fields, _wrapper (its hash), _expression: one row for each host and shape, of what read_pages gave."""
    shapes = read.where("tokens IS NOT NULL").select("host", "shape", "tokens", "size", "sketch", "part", "pages", "lo", "hi", "distinct")
    kind = shapes.schema
    if (shapes.agg(F.max("part")).first()[0] or 0) >= 1000:  # many tasks may have met the same shape
        shapes = cut(shapes.withColumn("part", F.col("part") % 32).groupBy("host", "shape", "part").applyInArrow(_fewer, kind))
    sizes = shapes.groupBy("host", "shape").agg(F.max("size").alias("size"), F.max("sketch").alias("sketch"))
    tasks = lambda df, *by: df.groupBy(*by).agg(F.expr(f"cast(ceil(sum(size) / {bucket_tokens}D) AS bigint)").alias("_n"))
    some = sizes.join(tasks(sizes, "host").withColumnRenamed("host", "_h"), F.col("host") == F.col("_h")).withColumn("_k", F.expr("pmod(sketch, greatest(_n, 1L))")).drop("_h", "_n")
    fine = tasks(some, "host", "_k").withColumnsRenamed({"host": "_h", "_k": "_j"})
    where = some.join(fine, (F.col("host") == F.col("_h")) & (F.col("_k") == F.col("_j"))).select(F.col("host").alias("_h"), F.col("shape").alias("_s"), "_k", F.expr("pmod(shape, greatest(_n, 1L))").alias("_l"))
    placed = shapes.join(where, (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s")))
    return placed.select("_k", "_l", *kind.names).groupBy("host", "_k", "_l").applyInArrow(infer, "_host string, _shape long, _fields array<boolean>, _wrapper long, _expression string")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """page_id, url, host, wrapper (its hash), n_fields, n_texts, text (the fields' texts, a line each) for every page."""
    read = read_pages(pages)
    rules = cut(learn_wrappers(read, bucket_tokens).select("_host", "_shape", "_fields", "_wrapper"))
    size = rules.agg(F.sum(F.size("_fields") + F.length("_host") + 200)).first()[0] or 0
    small = F.broadcast(rules) if size <= broadcast_bytes else rules.hint("merge")
    own = read.where("tokens IS NULL").select("page_id", "url", "host", "shape", "slots", "texts")
    met = own.where("shape IS NOT NULL").join(small, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left")
    kept = F.expr("filter(texts, (t, i) -> _fields[slots[i]])")
    fields = F.expr("size(array_distinct(filter(slots, s -> _fields[s])))")
    out = met.select("page_id", "url", "host", F.col("_wrapper").alias("wrapper"), fields.alias("n_fields"), kept.alias("_kept"))
    out = out.select("page_id", "url", "host", "wrapper", "n_fields", F.size("_kept").alias("n_texts"), F.array_join("_kept", "\n").alias("text"))
    none = own.where("shape IS NULL").selectExpr("page_id", "url", "host", "cast(NULL AS bigint) AS wrapper", "0 AS n_fields", "0 AS n_texts", "cast(NULL AS string) AS text")
    return out.unionByName(none)


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
