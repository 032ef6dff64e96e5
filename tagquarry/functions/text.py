"""Scalar functions over strings and keys; all are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import ALIASES, KEYS


#: The white space that `utrim` takes, for code outside Catalyst.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def utrim(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    return F.lower(utrim(c))


def parse_key(c: Column) -> Column:
    """The canonical form of a key's spelling; null if it is none: only printable ASCII without `=`."""
    t = utrim(c)
    return F.when(t.rlike(r"^[\x20-\x3C\x3E-\x7E]+$"), F.upper(t))


def is_known(c: Column) -> Column:
    return c.isin(*KEYS)


def resolve_alias(c: Column) -> Column:
    """The canonical key that an alternative spelling stands for, or the key itself."""
    table = F.create_map(*(F.lit(x) for a, k in ALIASES.items() for x in (a, k)))
    return F.coalesce(F.try_element_at(table, c), c)


def is_transcoder_stamp(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("lavf") | low.contains("libavformat")


def _hms(ns: Column) -> tuple[Column, Column, Column, Column]:
    total = F.floor(F.greatest(ns, F.lit(0).cast("long")) / 1_000_000)
    part = lambda by, mod: F.floor(total / by) % mod if mod else F.floor(total / by)
    return part(3_600_000, 0), part(60_000, 60), part(1000, 60), total % 1000


def format_chapter_time(ns: Column) -> Column:
    """H:MM:SS.mmm; a negative time is 0."""
    return F.format_string("%d:%02d:%02d.%03d", *_hms(ns))


def format_lrc_time(ns: Column) -> Column:
    """MM:SS.mmm with unbounded minutes."""
    h, m, s, ms = _hms(ns)
    return F.format_string("%02d:%02d.%03d", h * 60 + m, s, ms)


def performer_name(v: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_credit(v), r"(?s)^(.*\S)\s*\(\s*([^(]*[^(\s])\s*\)$", 1), F.lit("")), _credit(v))


def performer_role(v: Column) -> Column:
    """Of `Name (Role)`; empty where either is missing."""
    return F.regexp_extract(_credit(v), r"(?s)^(.*\S)\s*\(\s*([^(]*[^(\s])\s*\)$", 2)


def _credit(v: Column) -> Column:
    return utrim(v)


def indefinite_article(name: Column) -> Column:
    """`an` before a vowel, and before names in MP, which are spelt out."""
    return F.when(utrim(name).rlike("(?i)^(mp|[aeiou])"), "an").otherwise("a")


def writable_reason(c: Column) -> Column:
    """Why a text can't be written; null if it can."""
    return F.when(F.instr(c, "\x00") > 0, "contains NUL").when(~F.is_valid_utf8(c.cast("binary").cast("string")), "invalid UTF-8")


def escape_control(c: Column) -> Column:
    r"""Control characters as \xNN, for one-line display. Each of the 33 is replaced where any is there."""
    out = c
    for b in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(b)), F.lit(f"\\x{b:02x}"))
    return F.when(c.rlike(r"[\x00-\x1f\x7f]"), out).otherwise(c)


def canonical_codec(raw: Column) -> Column:
    """The one name for a codec's spellings; other names stay."""
    up = F.upper(raw)
    layer = F.regexp_extract(up, r"^MPEG-(?:1|2|2\.5) LAYER ([123])$", 1)
    return (
        F.when((up == "MP4A") | up.startswith("AAC"), "AAC").when(up.isin("ALAC", "FLAC", "AC-3"), up).when(up.isin("EC-3", "EAC3"), "E-AC-3")
        .when(layer != "", F.concat(F.lit("MP"), layer)).otherwise(raw)
    )


def human_bytes(n: Column) -> Column:
    """B, KiB, MiB, GiB with one decimal; a tie goes to the even digit, which the JVM's own format doesn't do."""
    unit = lambda k, name: F.format_string("%.1f " + name, F.bround(n / float(1 << k), 1))
    return F.when(n < 1 << 10, F.format_string("%d B", n)).when(n < 1 << 20, unit(10, "KiB")).when(n < 1 << 30, unit(20, "MiB")).otherwise(unit(30, "GiB"))
