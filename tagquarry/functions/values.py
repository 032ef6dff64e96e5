"""The value contracts: numbers, dates, booleans, media types, gains, countries. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utrim
from .vocabulary import DATES, GAINS, NUMERIC, PEAKS, TRIMMABLE

_INT = r"^[+-]?[0-9]+$"
PAIRED = ("TRACKNUMBER", "DISCNUMBER")


def integer(c: Column) -> Column:
    """A trimmed 64-bit integer; null for anything else."""
    t = utrim(c)
    return F.when(t.rlike(_INT), t.try_cast("long"))


def number_side(v: Column) -> Column:
    """What stands before the first slash."""
    return F.substring_index(v, "/", 1)


def total_side(v: Column) -> Column:
    """What stands after the first slash; null without one."""
    return F.when(F.instr(v, "/") > 0, F.regexp_replace(v, r"(?s)^[^/]*/", ""))


def parse_pair(number: Column, total: Column) -> tuple[Column, Column]:
    """Number and total; 0 for what is no integer. A total of its own wins."""
    own = F.coalesce(total, F.lit(""))
    n = F.coalesce(integer(number_side(F.coalesce(number, F.lit("")))), F.lit(0))
    t = F.when(own != "", F.coalesce(integer(own), F.lit(0))).otherwise(F.coalesce(integer(total_side(number)), F.lit(0)))
    return n, t


def is_number(key: Column, v: Column) -> Column:
    """Whether a numeric key accepts v; `n/total` on the two number keys, where one side may be blank."""
    n, t = utrim(number_side(v)), utrim(total_side(v))
    side = lambda raw, s: (s == "") | integer(raw).isNotNull()
    pair = ((n != "") | (t != "")) & side(number_side(v), n) & side(total_side(v), t)
    return F.when(key.isin(*PAIRED) & (F.instr(v, "/") > 0), pair).otherwise(integer(v).isNotNull())


def is_negative(key: Column, v: Column) -> Column:
    neg = lambda s: F.coalesce(integer(s) < 0, F.lit(False))
    return key.isin(*NUMERIC) & F.when(key.isin(*PAIRED) & (F.instr(v, "/") > 0), neg(number_side(v)) | neg(total_side(v))).otherwise(neg(v))


def splits(key: Column, v: Column) -> Column:
    """Whether v is a pair to be split into number and total."""
    return key.isin(*PAIRED) & (F.instr(v, "/") > 0) & is_number(key, v)


def empty_number_with_total(key: Column, v: Column) -> Column:
    return key.isin(*PAIRED) & (utrim(number_side(v)) == "") & integer(total_side(v)).isNotNull()


def canonical_number(c: Column) -> Column:
    """Without plus sign and leading zeros, of any length; other text trimmed."""
    t = utrim(c)
    digits = F.regexp_replace(F.regexp_replace(t, r"^[+-]", ""), r"^0+(?=[0-9])", "")
    sign = F.when(t.startswith("-") & (digits != "0"), "-").otherwise("")
    return F.when(t.rlike(_INT), F.concat(sign, digits)).otherwise(t)


def same_number(a: Column, b: Column) -> Column:
    """Equal by number on both sides of a slash."""
    side = lambda f, x: canonical_number(F.coalesce(f(x), F.lit("")))
    return (side(number_side, a) == side(number_side, b)) & (side(total_side, a) == side(total_side, b))


def boolean(v: Column) -> Column:
    """1/true/yes and 0/false/no; null for anything else."""
    t = F.lower(utrim(v))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False)


def is_partial_date(v: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of the calendar, without a year 0."""
    t = utrim(v)
    full = F.when(F.length(t) == 4, F.concat(t, F.lit("-01-01"))).when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(t)
    ok = t.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$") & ~t.startswith("0000")
    return F.when(ok, F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).isNotNull()).otherwise(False)


def is_media_type(v: Column) -> Column:
    t = utrim(v)
    return F.when(t.rlike("^[0-9]+$"), F.coalesce(t.try_cast("decimal(38,0)") <= 255, F.lit(False))).otherwise(False)


def is_country(v: Column) -> Column:
    return utrim(v).rlike("^[A-Za-z]{2}$")


def is_gain(key: Column, v: Column) -> Column:
    """A plain decimal with an optional sign and unit; a peak never has a minus."""
    t = utrim(F.regexp_replace(utrim(v), r"(?i)dB$", ""))
    return t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$") & ~(key.isin(*PEAKS) & t.startswith("-"))


def trim_token(key: Column, v: Column) -> Column:
    return F.when(key.isin(*TRIMMABLE), utrim(v)).otherwise(v)


def is_valid(key: Column, v: Column) -> Column:
    """By the key's contract; true for keys without one."""
    return (
        F.when(key.isin(*NUMERIC), is_number(key, v)).when(key.isin(*DATES), is_partial_date(v)).when(key == "COMPILATION", boolean(v).isNotNull())
        .when(key == "MEDIATYPE", is_media_type(v)).when(key.isin(*GAINS), is_gain(key, v)).when(key == "RELEASECOUNTRY", is_country(v)).otherwise(True)
    )


def malformed_code(key: Column) -> Column:
    """The finding that a value against the contract of the key gives."""
    return (
        F.when(key.isin(*NUMERIC), "malformed-number").when(key.isin(*DATES), "malformed-date").when(key == "COMPILATION", "malformed-boolean")
        .when(key.isin("MEDIATYPE", *GAINS), "malformed-number").when(key == "RELEASECOUNTRY", "malformed-country")
    )


def clock_ms(v: Column) -> Column:
    """Milliseconds of [[h:]m:]s[.fff]; null for anything else; seconds below 60 if there is a colon, minutes if there are two."""
    t = F.regexp_extract_all(v, F.lit(r"^(?:(?:([0-9]{1,7}):)?([0-9]{1,9}):)?([0-9]{1,9})(?:\.([0-9]{1,3}))?$"), F.lit(0))
    g = lambda k: F.regexp_extract(v, r"^(?:(?:([0-9]{1,7}):)?([0-9]{1,9}):)?([0-9]{1,9})(?:\.([0-9]{1,3}))?$", k)
    n = lambda s: F.coalesce(F.nullif(s, F.lit("")).try_cast("long"), F.lit(0))
    h, m, s, f = (g(k) for k in (1, 2, 3, 4))
    bad = ((m != "") & (n(s) >= 60)) | ((h != "") & (n(m) >= 60))
    return F.when((F.size(t) == 1) & ~bad, (n(h) * 3600 + n(m) * 60 + n(s)) * 1000 + n(F.rpad(f, 3, "0")))


def average_bitrate(n_bytes: Column, duration_ns: Column) -> Column:
    bps = n_bytes * 8.0 / (duration_ns / 1e9)
    return F.when((n_bytes <= 0) | (duration_ns <= 0), 0).when(bps < 2147483647, bps.cast("int")).otherwise(0)


def samples_ns(samples: Column, rate: Column) -> Column:
    ns = samples.cast("double") / rate * 1e9
    return F.when((rate <= 0) | (samples <= 0), F.lit(0).cast("long")).when(ns < 9.2e18, ns.cast("long")).otherwise(F.lit(0).cast("long"))
