"""Chapters and timed lyrics: neighbour-dependent rules, as array expressions or windows over (doc, position).

A chapter is a struct start_ns, end_ns, title, language, hidden, disabled; end 0 means open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LINES = 65_536
MAX_MS = (1 << 21) * 60_000
TOLERANCE_NS = 500_000_000


def _next_start(chapters: Column, i: Column) -> Column:
    return F.get(chapters, i + 1)["start_ns"]


def fill_interior_ends(chapters: Column) -> Column:
    """An open chapter ends where the next one starts, if that is later; the last stays open."""
    end = lambda c, i: F.when((c["end_ns"] == 0) & (_next_start(chapters, i) > c["start_ns"]), _next_start(chapters, i)).otherwise(c["end_ns"])
    return F.transform(chapters, lambda c, i: c.withField("end_ns", end(c, i)))


def fill_interior_ends_rows(df: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """The same over rows, for documents with more chapters than a row should hold."""
    n = F.lead("start_ns").over(Window.partitionBy(doc).orderBy(pos))
    return df.withColumn("end_ns", F.when((F.col("end_ns") == 0) & (n > F.col("start_ns")), n).otherwise(F.col("end_ns")))


def gapless(chapters: Column) -> Column:
    """For each chapter, whether it ends exactly where the next starts; false for the last."""
    return F.transform(chapters, lambda c, i: F.coalesce(c["end_ns"] == _next_start(chapters, i), F.lit(False)))


def normalize_ends(chapters: Column, duration_ns: Column) -> Column:
    """Ends that a format without ends gives back become open: gapless inner ones, and a last one at or beyond the duration, in whole ms."""
    floor = F.floor(duration_ns / 1_000_000) * 1_000_000
    last = lambda i: i == F.size(chapters) - 1
    open_ = lambda c, i: F.coalesce(c["end_ns"] == _next_start(chapters, i), F.lit(False)) | (last(i) & (duration_ns > 0) & (c["end_ns"] >= floor))
    return F.transform(chapters, lambda c, i: c.withField("end_ns", F.when(open_(c, i), F.lit(0).cast("long")).otherwise(c["end_ns"])))


def reconcile_overlaps(chapters: Column, base: Column) -> Column:
    """A chapter that runs over the next one's start ends there, unless base has the same start and end."""
    old = lambda c: F.exists(base, lambda b: (b["start_ns"] == c["start_ns"]) & (b["end_ns"] == c["end_ns"]))
    over = lambda c, i: (c["end_ns"] > _next_start(chapters, i)) & (_next_start(chapters, i) > c["start_ns"]) & ~old(c)
    return F.transform(chapters, lambda c, i: c.withField("end_ns", F.when(F.coalesce(over(c, i), F.lit(False)), _next_start(chapters, i)).otherwise(c["end_ns"])))


def loses_metadata(chapters: Column, loss: str) -> Column:
    """For each chapter, whether a format of that loss model drops something of it.

    none: nothing; flags: language and flags; start-title: these, and every end that can't be had back from the next start.
    """
    extra = lambda c: (F.coalesce(c["language"], F.lit("")) != "") | c["hidden"] | c["disabled"]
    ends = lambda c, i: (c["end_ns"] != 0) & ~F.coalesce(c["end_ns"] == _next_start(chapters, i), F.lit(False))
    rule = {"none": lambda c, i: F.lit(False), "flags": lambda c, i: extra(c), "start-title": lambda c, i: extra(c) | ends(c, i)}[loss]
    return F.transform(chapters, rule)


def sort_by_start(chapters: Column) -> Column:
    """Stable."""
    keyed = F.transform(chapters, lambda c, i: F.struct(c["start_ns"].alias("s"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def equal_start_runs(df: DataFrame, doc: str = "doc_id", pos: str = "pos", new: str = "is_new") -> DataFrame:
    """doc, start_ns, n of each run of neighbouring chapters with one start that holds a new chapter and more than one in all: gaps and islands."""
    w = Window.partitionBy(doc).orderBy(pos)
    step = F.when(F.col("start_ns") == F.lag("start_ns").over(w), 0).otherwise(1)
    runs = df.withColumn("_step", step).withColumn("_run", F.sum("_step").over(w))
    return runs.groupBy(doc, "_run").agg(F.min("start_ns").alias("start_ns"), F.count("*").alias("n"), F.max(new).alias("_new")).where("n > 1 AND _new").select(doc, "start_ns", "n")


def sources_agree(a: Column, b: Column, tolerance_ns: int = TOLERANCE_NS) -> Column:
    """Two chapter lists of one file: as many, with the same titles, starts within the tolerance."""
    ok = F.zip_with(a, b, lambda x, y: (x["title"] == y["title"]) & (F.abs(x["start_ns"] - y["start_ns"]) <= tolerance_ns))
    return (F.size(a) == F.size(b)) & F.forall(ok, lambda x: F.coalesce(x, F.lit(False)))


_STAMP = r"\[([0-9]{1,7}):([0-9]{1,2})(?::([0-9]{1,2}))?(?:[.:]([0-9]{1,9}))?\]"


def parse_lrc(text: Column) -> Column:
    """array<struct<time_ms, text>> of a timed lyric: each of a line's leading stamps gives an entry; the first [offset:] is subtracted, within bounds; stable order by time."""
    text = F.regexp_replace(text, "^﻿", "")
    lines = F.split(text, "\r\n|\n|\r")
    lead = rf"^(?:{_STAMP.replace('(', '(?:').replace('(?:?:', '(?:')})+"
    offset = F.coalesce(F.regexp_extract(text, r"(?im)^\[offset:\s*([+-]?[0-9]{1,12})\s*\]", 1).try_cast("long"), F.lit(0))

    def stamps(line: Column) -> Column:
        head = F.regexp_extract(line, lead, 0)
        rest = F.regexp_replace(F.substring(line, F.length(head) + 1, F.length(line)), "^ ", "")
        each = F.regexp_extract_all(head, F.lit(r"\[[^\]]*\]"), F.lit(0))

        def ms(s: Column) -> Column:
            g = lambda k: F.regexp_extract(s, _STAMP, k)
            n = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("long"), F.lit(0))
            three = g(3) != ""
            sec = F.when(three, n(g(1)) * 3600 + n(g(2)) * 60 + n(g(3))).otherwise(n(g(1)) * 60 + n(g(2)))
            bad = F.when(three, (n(g(2)) >= 60) | (n(g(3)) >= 60)).otherwise(n(g(2)) >= 60)
            return F.when(~bad, sec * 1000 + n(F.substring(F.rpad(g(4), 3, "0"), 1, 3)))

        times = F.filter(F.transform(each, ms), lambda x: x.isNotNull())
        return F.transform(times, lambda t: F.struct(F.least(F.greatest(t - offset, F.lit(0)), F.lit(MAX_MS)).alias("time_ms"), rest.alias("text")))

    flat = F.flatten(F.transform(lines, stamps))
    keyed = F.transform(flat, lambda x, i: F.struct(x["time_ms"].alias("t"), i.alias("i"), x["text"].alias("x")))
    return F.slice(F.transform(F.array_sort(keyed), lambda k: F.struct(k["t"].alias("time_ms"), k["x"].alias("text"))), 1, MAX_LINES)


def format_lrc(lines: Column) -> Column:
    """One stamped line each; line breaks within a text become blanks."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    stamp = lambda t: F.concat(F.lit("["), F.when(t >= 6_000_000, F.floor(t / 60_000).cast("string")).otherwise(two(F.floor(t / 60_000))), F.lit(":"), two(F.floor(t / 1000) % 60), F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"), F.lit("]"))
    return F.array_join(F.transform(lines, lambda x: F.concat(stamp(x["time_ms"]), F.regexp_replace(x["text"], "\r\n|\r|\n", " "))), "\n")


def truncate_lines(lines: Column) -> tuple[Column, Column]:
    """The lines up to the cap, and whether any were cut."""
    return F.slice(lines, 1, MAX_LINES), F.size(lines) > MAX_LINES
