"""Secret scans: the guess cost of values in credential contexts.

A value is what stands after a credential's name and `=` or `:` (`password=...`, `api_key: "..."`), or after
`Bearer`, or a key that names its own kind by its prefix. Its cost is the least number of guesses, as log10,
over all its segmentations into words of a ranked list (with capitals, leet and reversal), dates, repeats of up to
`BASE` characters, keyboard walks and brute-force spans, found by dynamic programming over positions. Every part of a
walk or of a row of repeats is a segment of its own. The list is `WORDS`, followed by the words of a public
tokenizer's vocabulary. Values that cost
`THRESHOLD` or more are secrets; cheap ones (`changeme`, `xxxx`, a date) are placeholders, and stay.

Defined results:
- a null or empty text, or one without such a context, has no value; `redact_secrets` leaves it alone;
- very long texts and values are read whole; the time is about linear in a value's length;
- letters are folded one by one, those with a longer lower case (`\u0130`) are left as they are;
- a value in quotes ends at the quote that closes it on the same line (`\\"` doesn't); any other, or one whose quote isn't
  closed there, at white space, a quote, `<`, `>`, or at `&` or `;`; of overlapping contexts the first counts;
- blanks and tabs around `=` and `:` are as many as there are;
- an empty value (`password=`) is none; repeated values and rows are each found;
- `redact_secrets` puts `MARK` for each secret and sets n_chars, where there is such a column, to the new length;
- null ids are carried; an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .bpe import TOKENIZERS, VOCABULARY

THRESHOLD = 10.0
#: A public tokenizer's vocabulary file, of which the words are taken; None for WORDS alone.
DICTIONARY = f"{TOKENIZERS}/{VOCABULARY}"
#: Characters of a repeated base at most.
BASE = 8
MARK = "[SECRET]"
#: Of each segment beyond the first: the guesser must also find where it starts.
JOINT = math.log10(2)

_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|auth|secret|client)[_-]?key|credentials?|auth(?:orization)?)"
_PREFIXED = r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35}"
_SCHEME = r"(?:(?i:bearer|basic)[ \t]+)?"
_BARE = r"""[^\s"'`<>&;]+"""
#: Groups: the opening quote, what it quotes, a value without quotes, one after `Bearer`, one that names its kind.
CONTEXT = re.compile(rf"""(?i:{_NAME})["']?[ \t]*+(?::=|=>|=|:)[ \t]*+{_SCHEME}(?:(["'`]){_SCHEME}((?:\\[^\r\n]|(?!\1)[^\\\r\n])++)\1|["'`]?(?!["'`])({_BARE}))|(?i:\bbearer)[ \t]+({_BARE})|({_PREFIXED})""")
#: A cheap test in RE2: every text in which CONTEXT finds something passes it.
HINT = rf"""(?i:{_NAME})["']?[ \t]*[:=]|(?i:bearer)[ \t]|{_PREFIXED.replace("{10,}", "").replace("{20,}", "").replace("{35}", "").replace("{16}", "")}"""

WORDS = """password 123456 qwerty letmein welcome monkey dragon master admin login abc123 football baseball shadow sunshine princess iloveyou
trustno1 superman batman michael jordan hunter ranger harley buster soccer hockey killer george charlie andrew michelle jessica pepper
daniel access joshua maggie starwars silver william dallas yankees hello freedom whatever nicole secret summer winter spring autumn
computer internet server database default root user guest test testing example sample demo temp changeme change replace placeholder dummy
fake none null true false undefined your yours here insert value string token key pass passwd credential private public client api auth
xxx foo bar baz qux hidden redacted masked removed required optional enter type name email mail account company service system backup
production staging development prod dev local localhost manager support office oracle mysql postgres redis docker linux windows ubuntu
apple google amazon cloud azure orange banana cherry coffee cookie cheese flower garden house horse tiger eagle lion panda purple yellow
green blue black white red gold diamond crystal angel heaven devil magic power strong happy lucky love life time world peace music guitar
rock star moon earth fire water stone river ocean island london paris berlin madrid monday friday january february march april june july
august september october november december the and for you not this that with from have more will home page""".split()  # fmt: skip
KEYS = ("`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./")
LEET = str.maketrans("4@8361!0$5+7", "aabegiiosstt")


def _graph() -> dict[str, set[str]]:
    at = {c: (i, j) for i, row in enumerate(KEYS) for j, c in enumerate(row) if c != "\t"}
    place = {p: c for c, p in at.items()}
    near = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    return {c: {place[q] for a, b in near if (q := (i + a, j + b)) in place} for c, (i, j) in at.items()}


_NEAR = _graph()
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def pool(value: str) -> int:
    """How many characters a brute-force guesser tries at each place of this value."""
    if re.fullmatch(r"[0-9]*", value):
        return 10
    if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", value):
        return 16
    n = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 33 * bool(re.search(r"[^\w]|_", value))
    return (n or 0) + 100 * bool(re.search(r"[^\x00-\x7f]", value)) or 10


def fold(value: str) -> str:
    """Lower case, a character for each character."""
    return "".join(lo if len(lo := c.lower()) == 1 else c for c in value)


def date_cost(s: str) -> float:
    return math.log10(120 if len(s) == 4 else 120 * 366 * (4 if not s.isdigit() else 1))


class Guesser:
    """Guess costs by a ranked list of words, the likeliest first."""

    def __init__(self, words: Iterable[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)
        self.short = lru_cache(maxsize=100_000)(self._cost)

    def word_cost(self, s: str) -> float | None:
        """log10 guesses of s as one word of the list, None if it is none."""
        low, best = fold(s), None
        for form, extra in ((low, 0.0), (low.translate(LEET), math.log10(4)), (low[::-1], math.log10(2))):
            if (rank := self.rank.get(form)) is not None:
                case = 0.0 if s == low else math.log10(2) if s[1:] == low[1:] or s.isupper() else math.log10(2 ** min(len(s), 8))
                cost = math.log10(rank) + extra + case
                best = cost if best is None else min(best, cost)
        return best

    def words(self, value: str) -> Iterator[tuple[int, int, float]]:
        """start, end, cost of each word of three letters at least."""
        low, rank = fold(value), self.rank
        plain = low.translate(LEET)
        for i in range(len(value) - 2):
            for j in range(i + 3, min(len(value), i + self.longest) + 1):
                if low[i:j] in rank or plain[i:j] in rank or low[i:j][::-1] in rank:
                    yield i, j, self.word_cost(value[i:j])

    def cost(self, value: str) -> float:
        """log10 of the least guesses over all segmentations; 0 for an empty value."""
        return self.short(value) if len(value) <= 64 else self._cost(value)

    def _cost(self, value: str) -> float:
        n, one = len(value), math.log10(pool(value))
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        runs = []
        if n > 1:
            for i, j, c in self.words(value):
                ends[j].append((i, c))
            for i, j, c in dates(value):
                ends[j].append((i, c))
            runs = [walks(value), *(repeats(value, p, self.cost) for p in range(1, min(BASE, n // 2) + 1))]
        # best[k]: any segmentation of the first k; brute[k]: one that ends in a brute-force span.
        best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
        joint = lambda i: JOINT if i else 0.0
        for k in range(1, n + 1):
            brute[k] = min(brute[k - 1], best[k - 1] + joint(k - 1)) + one
            top = min([brute[k], *(best[i] + joint(i) + c for i, c in ends[k])])
            for r in runs:
                top = min(top, r.ending(k, best))
            best[k] = top
        return best[n]


class Runs:
    """Segments within runs in which every part is a segment: its cost is `own[start] + by_end[end] + log10(its length / step)`.

    Of the starts of a run only those are kept that may still win: as an end moves on, the logarithm of a longer
    segment grows slower, so a start that a lower one has once beaten is beaten for good. No start is lost, and a
    run of any length takes a few comparisons an end.
    """

    def __init__(self, step: int, least: int, first: list[int], own: list[float], by_end: list[float]):
        # first[k]: the least start of a segment that ends in k (k itself: there is none).
        self.step, self.least, self.first, self.own, self.by_end = step, least, first, own, by_end
        self.kept: dict[int, tuple[list[tuple[int, float]], int]] = {}  # and the last start seen

    def ending(self, k: int, best: list[float]) -> float:
        first, i = self.first[k], k - self.least
        if i < first or first == k:
            return math.inf
        kept, seen = self.kept.get(k % self.step, ([], -1))
        if seen < first:
            kept, seen = [], first - self.step  # another run
        for s in range(seen + self.step, i + 1, self.step):
            c = best[s] + (JOINT if s else 0.0) + self.own[s]
            while kept and kept[-1][1] >= c:
                kept.pop()  # longer, and not cheaper to begin with
            kept.append((s, c))
        low, left = math.inf, []
        for s, c in kept:
            now = c + math.log10((k - s) // self.step)
            if now < low:
                low = now
                left.append((s, c))
        self.kept[k % self.step] = left, i
        return low + self.by_end[k]


def walks(value: str) -> Runs:
    """Keyboard walks of three keys at least: each key lies next to the one before; a turn is a step in another direction than the last."""
    low, n = fold(value), len(value)
    first, turns = [*range(n + 1)], [0.0] * (n + 1)
    start = 0
    for k in range(1, n):
        if low[k] not in _NEAR.get(low[k - 1], ()):
            start = k
        # turns[k]: changes of direction up to the step from k - 1 to k, of which a walk's own come after its first step.
        turns[k] = turns[k - 1] + (k - 1 > start and _way(low[k - 2], low[k - 1]) != _way(low[k - 1], low[k]))
        first[k + 1] = start if k - start >= 2 else k + 1
    turn = math.log10(4.6)
    own = [math.log10(47) + turn * (1 - (turns[i + 1] if i + 1 < n else 0)) for i in range(n + 1)]
    return Runs(1, 3, first, own, [0.0, *(turn * turns[k - 1] for k in range(1, n + 1))])


def repeats(value: str, p: int, cost: Callable[[str], float]) -> Runs:
    """Two or more copies of p characters, which cost what one costs and their number."""
    n = len(value)
    first, own, same = [*range(n + 1)], [math.inf] * (n + 1), 0
    for k in range(1, n + 1):
        same = same + 1 if k > p and value[k - 1] == value[k - 1 - p] else 0
        if same >= p:
            first[k] = k - (same // p + 1) * p
            own[k - 2 * p] = cost(value[k - 2 * p : k - p])
    return Runs(p, 2 * p, first, own, [0.0] * (n + 1))


def dates(value: str) -> Iterator[tuple[int, int, float]]:
    for i in range(len(value)):
        if value[i].isdigit():
            for n in (4, 6, 7, 8, 9, 10):
                if i + n <= len(value) and _DATE.fullmatch(value, i, i + n):
                    yield i, i + n, date_cost(value[i : i + n])


@lru_cache(maxsize=None)
def _way(a: str, b: str) -> tuple[int, int]:
    at = {c: (i, j) for i, row in enumerate(KEYS) for j, c in enumerate(row)}
    return at[b][0] - at[a][0], at[b][1] - at[a][1]


@lru_cache(maxsize=4)
def ranked_words(path: str | None = DICTIONARY) -> tuple[str, ...]:
    """WORDS, then the words of three letters or more of a public tokenizer's vocabulary, in its order, which is that of their frequency."""
    if path is None:
        return tuple(WORDS)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    found = (t[1:].lower() for t in sorted(vocab, key=vocab.get) if t[0] == "\u0120" and len(t) > 3 and t[1:].isascii() and t[1:].isalpha())
    return tuple(dict.fromkeys([*WORDS, *found]))


@lru_cache(maxsize=4)
def _guesser(words: tuple[str, ...]) -> Guesser:
    return Guesser(words)


def guess_cost(value: str, words: tuple[str, ...] | None = None) -> float:
    return _guesser(words or ranked_words()).cost(value)


def scan(text: str, cost: Callable[[str], float] = guess_cost) -> list[tuple[int, int, float]]:
    """start, end, cost of each value in a credential context."""
    out = []
    for m in CONTEXT.finditer(text):
        k = m.lastindex if m[2] is None else 2
        value = m[k].rstrip(".,:!?)]}") if k in (3, 4) else m[k]
        if value:
            out.append((m.start(k), m.start(k) + len(value), cost(value)))
    return out


def _hit(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False))


def _sent(spark: SparkSession, dictionary: str | None) -> Callable[[str], float]:
    """The cost of a value, by the list that the driver reads and sends: some 20,000 words, whatever the input."""
    words = spark.sparkContext.broadcast(ranked_words(dictionary))
    return lambda value: _guesser(words.value).cost(value)


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, dictionary: str | None = DICTIONARY) -> DataFrame:
    """doc_id, n_values, n_secrets, max_log10_guesses (null without a value), findings (`start:length:log10` of each secret, in characters) for every row of docs."""

    cost = _sent(docs.sparkSession, dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            n = np.zeros(b.num_rows, np.int32)
            s, top, said = n.copy(), np.full(b.num_rows, np.nan), [""] * b.num_rows
            for i in _hit(texts):
                found = scan(texts[i].as_py(), cost)
                bad = [x for x in found if x[2] >= threshold]
                n[i], s[i] = len(found), len(bad)
                if found:
                    top[i] = round(max(x[2] for x in found), 3)
                said[i] = ";".join(f"{a}:{e - a}:{c:.3f}" for a, e, c in bad)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s), pa.array(top, mask=n == 0), pa.array(said)], ["doc_id", "n_values", "n_secrets", "max_log10_guesses", "findings"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_values int, n_secrets int, max_log10_guesses double, findings string")


def redact_secrets(docs: DataFrame, threshold: float = THRESHOLD, dictionary: str | None = DICTIONARY) -> DataFrame:
    """All rows and columns of docs, each secret in text replaced by MARK."""

    cost = _sent(docs.sparkSession, dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            new = {}
            for i in _hit(b.column(at)):
                text = b.column(at)[int(i)].as_py()
                parts, last = [], 0
                for a, e, c in scan(text, cost):
                    if c >= threshold:
                        parts += [text[last:a], MARK]
                        last = e
                if parts:
                    new[int(i)] = "".join([*parts, text[last:]])
            if new:
                mask = np.zeros(b.num_rows, bool)
                mask[list(new)] = True
                columns = list(b.columns)
                put = lambda k, values: pc.replace_with_mask(columns[k], pa.array(mask), pa.array(values, columns[k].type))  # noqa: B023, E731
                columns[at] = put(at, [new[i] for i in sorted(new)])
                if (k := b.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(b.schema.field(k).type):
                    columns[k] = put(k, [len(new[i]) for i in sorted(new)])
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
