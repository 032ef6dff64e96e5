"""Functions for display: elision, runs of invalid bytes, audio lines, file names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LONGEST = 4096


def human_size(n: int) -> str:
    """Bytes in the largest unit that leaves at least one."""
    if n < 1024:
        return f"{n} B"
    v, k = n / 1024, 0
    while float(f"{v:.1f}") >= 1024:
        v, k = v / 1024, k + 1
    return f"{v:.1f} {'KMGTPE'[k]}iB"


def elide_text(v: str | None, most: int = LONGEST) -> str | None:
    """At most so many bytes, cut between characters, with the whole size said."""
    b = (v or "").encode()
    return v if len(b) <= most else f"{b[:most].decode('utf-8', 'ignore')}… ({human_size(len(b))})"


@F.pandas_udf(StringType())
def elide(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(elide_text, na_action="ignore")


def repair_text(b: bytes | None) -> str | None:
    """UTF-8; each run of invalid bytes becomes one replacement character."""
    if b is None:
        return None
    marked = bytes(b).decode("utf-8", "surrogateescape")
    return re.sub("[\udc80-\udcff]+", "�", marked)


@F.pandas_udf(StringType())
def repair_utf8(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(repair_text, na_action="ignore")


def audio_line(track: Column) -> Column:
    """`FLAC, 44100 Hz, 2 ch, 16 bit, 0:03:00.000` of a track, what is 0 left out; bits only where the codec has them."""
    from .text import format_chapter_time

    lossless = track["codec"].isin("PCM", "PCM float", "FLAC", "ALAC")
    n = lambda c, unit, also=F.lit(True): F.when((c > 0) & also, F.concat(c.cast("string"), F.lit(unit)))  # noqa: B008, E731
    return F.concat_ws(", ", F.nullif(track["codec"], F.lit("")), n(track["sample_rate"], " Hz"), n(track["channels"], " ch"), n(track["bits_per_sample"], " bit", lossless), F.when(track["duration_ns"] > 0, format_chapter_time(track["duration_ns"])))


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def is_cover_name(name: Column) -> Column:
    """Names that Matroska gives to covers."""
    return name.rlike(r"(?i)^(small_)?cover(_land)?\.(jpe?g|png)$")
