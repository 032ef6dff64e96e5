"""Lint rules over a media row; each gives findings severity, code, key, detail, in the fixed order of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import is_negative, is_valid, malformed_code, trim_token
from ..functions.vocabulary import KEYS, NUMERIC
from . import tags as T

FINDINGS = "array<struct<severity:string,code:string,key:string,detail:string>>"
#: Severity of the parse warnings that lint takes over.
PROMOTED = {
    **dict.fromkeys(("truncated-audio", "invalid-tag-key", "invalid-picture", "inherited-encoder", "legacy-ape", "trailing-id3v1", "stray-leading-id3"), "warning"),
    **dict.fromkeys(("multiple-vorbis-comment", "duplicate-tag-block", "no-audio"), "error"), "numeric-genre": "info",
}
RANK = {"info": 0, "warning": 1, "error": 2}


def finding(severity, code, key=None, detail=None) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(severity).alias("severity"), c(code).alias("code"), c(key).cast("string").alias("key"), c(detail).cast("string").alias("detail"))


def _some(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull()).cast(FINDINGS)


def warnings(ws: Column) -> Column:
    table = F.create_map(*(F.lit(x) for p in PROMOTED.items() for x in p))
    return _some(F.transform(ws, lambda w: F.when(w["code"].isin(*PROMOTED), finding(F.try_element_at(table, w["code"]), w["code"], None, w["message"]))))


def families(fams: Column) -> Column:
    bad = F.array_distinct(F.transform(F.filter(fams, lambda f: ~f["selected"]), lambda f: f["key"]))
    return F.transform(bad, lambda k: finding("warning", "conflicting-families", k)).cast(FINDINGS)


def legacy(tags: Column, fams: Column, opaque: Column) -> Column:
    n = F.size(T.legacy_only(tags, fams))
    one = F.when(n > 0, F.array(finding("info", "legacy-only-tags", None, n.cast("string")))).otherwise(F.array()).cast(FINDINGS)
    two = F.when(opaque, F.array(finding("info", "legacy-opaque-content"))).otherwise(F.array()).cast(FINDINGS)
    return F.concat(one, two)


def values(tags: Column) -> Column:
    """A value against its key's contract; values that are empty once trimmed are passed over."""

    def one(t: Column) -> Column:
        key = t["key"]
        trimmed = F.transform(t["values"], lambda v: trim_token(key, v))
        bad = F.filter(trimmed, lambda v: (v != "") & ~F.coalesce(is_valid(key, v), F.lit(False)))
        return F.transform(bad, lambda v: finding("warning", malformed_code(key), key, v))

    return F.flatten(F.transform(tags, one)).cast(FINDINGS)


def negatives(tags: Column) -> Column:
    one = lambda t: F.transform(F.filter(t["values"], lambda v: is_negative(t["key"], v)), lambda v: finding("info", "negative-numeric", t["key"], v))
    return F.flatten(F.transform(F.filter(tags, lambda t: t["key"].isin(*NUMERIC)), one)).cast(FINDINGS)


def cardinality(tags: Column) -> Column:
    many = F.filter(tags, lambda t: T.single_valued_multi(t["key"], t["values"]))
    return F.transform(many, lambda t: finding("warning", "single-valued-multi", t["key"], F.size(t["values"]).cast("string"))).cast(FINDINGS)


def custom(tags: Column) -> Column:
    return F.transform(F.filter(tags, lambda t: ~t["key"].isin(*KEYS)), lambda t: finding("info", "custom-key", t["key"])).cast(FINDINGS)


def pictures(pics: Column) -> Column:
    """Unrecognised images, each repeat of an image, several front covers, icons that aren't unique. pics: structs with type, mime, data."""
    hashed = F.transform(pics, lambda p: F.struct(F.sha2(p["data"], 256).alias("h"), p["type"].cast("int").alias("type")))
    bad = _some(F.transform(pics, lambda p: F.when(p["mime"] == "application/octet-stream", finding("warning", "invalid-picture", None, p["mime"]))))
    types = lambda hs, x: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(hs, lambda y: y["h"] == x["h"]), lambda y: y["type"]))).cast("array<string>"), ",")
    again = T.let(hashed, lambda hs: _some(F.transform(hs, lambda x, i: F.when(F.array_position(hs["h"], x["h"]) < i + 1, finding("warning", "duplicate-picture", None, types(hs, x))))))
    of = lambda k: F.size(F.filter(pics, lambda p: p["type"] == k))
    fronts = F.when(of(3) > 1, F.array(finding("warning", "multiple-front-covers", None, of(3).cast("string")))).otherwise(F.array()).cast(FINDINGS)
    icons = F.when((of(1) > 1) | (of(2) > 1), F.array(finding("error", "duplicate-icon"))).otherwise(F.array()).cast(FINDINGS)
    return F.concat(bad, again, fronts, icons)


def tag_rules(tags: Column) -> Column:
    """The rules that need the tags alone."""
    return F.concat(values(tags), negatives(tags), cardinality(tags), custom(tags))


def lint(media_tags: Column, ws: Column, fams: Column, opaque: Column, pics: Column) -> Column:
    return F.concat(warnings(ws), families(fams), legacy(media_tags, fams, opaque), pictures(pics), tag_rules(media_tags))


def worst(findings: Column) -> Column:
    """The worst severity; null without a finding."""
    rank = F.create_map(*(F.lit(x) for p in RANK.items() for x in p))
    top = F.array_max(F.transform(findings, lambda f: F.try_element_at(rank, f["severity"])))
    return F.when(top == 2, "error").when(top == 1, "warning").when(top == 0, "info")


def exit_code(findings: Column) -> Column:
    """0 where nothing is worse than info, 1 for warnings, 4 for errors."""
    w = worst(findings)
    return F.when(w == "error", 4).when(w == "warning", 1).otherwise(0)


def safe_fix(tags: Column, fams: Column, opaque: Column | None = None) -> Column:
    """What a fix may do by itself: drop transcoder stamps, and strip legacy blocks that hold nothing else."""
    from ..functions.text import is_transcoder_stamp

    stamps = F.coalesce(F.exists(T.values_of(tags, "ENCODER"), is_transcoder_stamp), F.lit(False))
    return F.struct(stamps.alias("drop_encoder"), (F.exists(fams, lambda f: f["legacy"]) & (F.size(T.legacy_only(tags, fams)) == 0) & ~(F.lit(False) if opaque is None else opaque)).alias("strip_legacy"))
