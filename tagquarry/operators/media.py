"""Operators over whole media rows: comparison, identity, errors, pictures, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from . import tags as T

#: The classes of failure, the worst last; an aggregate takes the worst by this order, not by exit code.
ERROR_RANK = ("ok", "unsupported-format", "no-audio", "malformed", "too-large", "io")
ROLES = ("other", "file-icon", "other-icon", "front-cover", "back-cover", "leaflet", "media", "lead-artist", "artist", "conductor", "band", "composer", "lyricist", "location", "recording", "performance", "screen-capture", "fish", "illustration", "band-logo", "publisher-logo")


def duration_ns(tracks: Column) -> Column:
    """The longest track's; 0 without one."""
    return F.coalesce(F.array_max(F.transform(tracks, lambda t: t["duration_ns"])), F.lit(0).cast("long"))


def padding(native: Column) -> Column:
    return F.aggregate(F.filter(native, lambda n: n["kind"] == "PADDING"), F.lit(0).cast("long"), lambda a, n: a + n["size"])


def opaque(native: Column) -> Column:
    """Whether a legacy block holds what no tag stands for."""
    return F.exists(native, lambda n: n["kind"] == "LEGACY-OPAQUE")


def worst_error(code: Column) -> Column:
    """An aggregate: the worst class; of equals the first by name."""
    rank = F.create_map(*(F.lit(x) for i, c in enumerate(ERROR_RANK) for x in (c, i)))
    return F.max(F.struct(F.coalesce(F.try_element_at(rank, code), F.lit(len(ERROR_RANK))).alias("rank"), code.alias("code")))["code"]


def same_identity(a: Column, b: Column) -> Column:
    """Size, time and fingerprint agree; 0 or null on either side says nothing."""
    ok = lambda f: F.coalesce((a[f] == b[f]) | (a[f] == 0) | (b[f] == 0), F.lit(True))
    return ok("size") & ok("mtime_ns") & F.coalesce(a["fingerprint"] == b["fingerprint"], F.lit(True))


def diff_media(a: DataFrame, b: DataFrame, on: str = "name") -> DataFrame:
    """The differences of two libraries' files by name: presence, tag changes, and whether pictures, chapters and lyrics differ. Numbers are compared by value where a side is MP4."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col(f"x.{on}") == F.col(f"y.{on}"), "full")
    side = lambda s, c: F.col(f"{s}.{c}")
    tags = lambda s: F.coalesce(side(s, "tags"), T.no_tags())
    mp4 = F.coalesce((side("x", "format") == "MP4") | (side("y", "format") == "MP4"), F.lit(False))
    other = lambda c: ~side("x", c).eqNullSafe(side("y", c))
    return both.select(
        F.coalesce(side("x", on), side("y", on)).alias(on), F.when(side("x", on).isNull(), "added").when(side("y", on).isNull(), "removed").otherwise("both").alias("presence"),
        T.diff(tags("x"), tags("y"), mp4).alias("changes"), other("pictures").alias("pictures"), other("chapters").alias("chapters"), other("synced_lyrics").alias("lyrics"),
    )


def select_picture(pics: Column, selector: str = "") -> Column:
    """A picture by role name or number from 1; without a selector the front cover, else the only one. Null where none or several answer."""
    if selector.isdigit():
        return F.get(pics, F.lit(int(selector) - 1))
    if selector:
        role = F.filter(pics, lambda p: p["type"] == (ROLES.index(selector) if selector in ROLES else -1))
        return F.when(F.size(role) == 1, F.get(role, F.lit(0)))
    fronts = F.filter(pics, lambda p: p["type"] == 3)
    return F.when(F.size(fronts) > 0, F.get(fronts, F.lit(0))).when(F.size(pics) == 1, F.get(pics, F.lit(0)))


def remove_pictures(pics: Column, match) -> Column:
    """match: from a picture Column to a boolean Column."""
    return F.filter(pics, lambda p: ~match(p))


def subtract_fold(values: Column, covered: Column) -> Column:
    """The values that `covered` doesn't hold, folded; of a value that is there n times, as many as covered has go."""
    n = lambda arr, f: F.size(F.filter(arr, lambda x: x == f))
    keep = lambda x: F.filter(values, lambda v, i: n(F.slice(x["f"], 1, i + 1), F.get(x["f"], i)) > n(x["h"], F.get(x["f"], i)))
    return T.let(F.struct(F.transform(values, fold).alias("f"), F.transform(covered, fold).alias("h")), keep)


def to_json(media: DataFrame) -> DataFrame:
    """path, json: the document of each file, without picture bytes; absent optionals are left out."""
    pics = F.transform("pictures", lambda p: p.dropFields("data"))
    fields = [F.lit(1).alias("schemaVersion"), *(F.col(c) for c in ("path", "format", "container", "tracks", "tags")), pics.alias("pictures"), *(F.col(c) for c in ("chapters", "families", "warnings", "essence", "error"))]
    return media.select("path", F.to_json(F.struct(*fields)).alias("json"))
