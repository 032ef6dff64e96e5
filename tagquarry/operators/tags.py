"""The tag multimap: an ordered ARRAY<STRUCT<key, values>>, absent, present-but-empty and present keys apart.

All are expressions over one row's arrays, so none needs a shuffle; only the operators that gather rows
(`build_tags`, `family_conflicts`) group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, utrim
from ..functions.values import number_side, same_number, splits, total_side, trim_token
from ..functions.vocabulary import CANONICAL_NUMBERS, KEYS, MULTIVALUED, NUMBER_PAIR

TAGS = "array<struct<key:string,values:array<string>>>"
OPS = "array<struct<kind:string,key:string,values:array<string>>>"


def entry(key, values: Column) -> Column:
    return F.struct((key if isinstance(key, Column) else F.lit(key)).alias("key"), values.alias("values"))


def no_tags() -> Column:
    return F.array().cast(TAGS)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has(tags: Column, key) -> Column:
    return F.array_contains(tags["key"], key)


def values_of(tags: Column, key) -> Column:
    """Null for an absent key."""
    return F.get(tags, F.array_position(tags["key"], key) - 1)["values"]


def first(tags: Column, key) -> Column:
    return F.get(values_of(tags, key), F.lit(0))


def value_count(tags: Column, key) -> Column:
    return F.coalesce(F.size(values_of(tags, key)), F.lit(0))


def keys(tags: Column) -> Column:
    return tags["key"]


def set_(tags: Column, key, values: Column) -> Column:
    """A key that is there keeps its place; a new one comes last."""
    put = entry(key, values)
    at = lambda ts: F.when(has(ts, key), F.transform(ts, lambda t: F.when(t["key"] == key, put).otherwise(t))).otherwise(F.concat(ts, F.array(put)))
    return let(tags, at)


def delete(tags: Column, key) -> Column:
    return F.filter(tags, lambda t: t["key"] != key)


def add(tags: Column, key, values: Column) -> Column:
    return let(tags, lambda ts: set_(ts, key, F.concat(F.coalesce(values_of(ts, key), F.array().cast("array<string>")), values)))


def drop_empty(tags: Column) -> Column:
    return F.filter(tags, lambda t: F.size(t["values"]) > 0)


def project(tags: Column) -> list[Column]:
    """The typed view: one column for each known key, an array for multivalued ones, else the first value."""
    return [(values_of(tags, k) if k in MULTIVALUED else first(tags, k)).alias(k.lower()) for k in KEYS]


def unproject(df: DataFrame, by: dict[str, str]) -> Column:
    """The inverse: set operations for the columns (by name: key) that hold something."""
    ops = []
    for name, key in by.items():
        c = F.col(name)
        values = c if df.schema[name].dataType.typeName() == "array" else F.array(c.cast("string"))
        ops.append(F.when(c.isNotNull() & (F.size(F.filter(values, lambda v: v != "")) > 0), F.struct(F.lit("set").alias("kind"), F.lit(key).alias("key"), values.alias("values"))))
    return F.array_compact(F.array(*ops)).cast(OPS)


def equal(a: Column, b: Column) -> Column:
    """Key order doesn't count, value order does."""
    return F.array_sort(a) == F.array_sort(b)


def diff(base: Column, edited: Column, numeric: Column | None = None) -> Column:
    """Removed and changed keys in base's order, then added ones in edited's. Where `numeric` holds, numbers are compared by value."""
    kind = "array<struct<kind:string,key:string,before:array<string>,after:array<string>>>"
    none = F.lit(None).cast("array<string>")
    make = lambda what, key, b, a: F.struct(F.lit(what).alias("kind"), key.alias("key"), b.alias("before"), a.alias("after"))

    def old(t: Column) -> Column:
        def met(new: Column) -> Column:
            same = t["values"] == new
            if numeric is not None:
                by_number = (F.size(t["values"]) == F.size(new)) & F.forall(F.zip_with(t["values"], new, same_number), lambda x: x)
                same = same | (numeric & t["key"].isin(*CANONICAL_NUMBERS) & by_number)
            return F.when(new.isNull(), make("removed", t["key"], t["values"], none)).when(~same, make("changed", t["key"], t["values"], new))

        return let(values_of(edited, t["key"]), met)

    one = F.filter(F.transform(base, old), lambda c: c.isNotNull())
    two = F.transform(F.filter(edited, lambda t: ~has(base, t["key"])), lambda t: make("added", t["key"], none, t["values"]))
    return F.concat(one.cast(kind), two.cast(kind))


def change_line(c: Column) -> Column:
    """One line for a change."""
    say = lambda v: F.array_join(v, " | ")
    return (
        F.when(c["kind"] == "added", F.concat(F.lit("+ "), c["key"], F.lit(": "), say(c["after"])))
        .when(c["kind"] == "removed", F.concat(F.lit("- "), c["key"], F.lit(": "), say(c["before"])))
        .otherwise(F.concat(F.lit("~ "), c["key"], F.lit(": "), say(c["before"]), F.lit(" -> "), say(c["after"])))
    )


def union_values(a: Column, b: Column) -> Column:
    """a then b; of values that fold alike the first spelling stays."""
    return let(F.concat(a, b), lambda both: let(F.transform(both, fold), lambda f: F.filter(both, lambda v, i: F.array_position(f, F.get(f, i)) == i + 1)))


def rejected(selected: Column, base: Column, incoming: Column) -> Column:
    return let(F.transform(selected, fold), lambda kept: F.filter(F.concat(base, incoming), lambda v: ~F.array_contains(kept, fold(v))))


def distinct_values(values: Column) -> Column:
    return F.size(F.array_distinct(F.transform(values, fold)))


def single_valued_multi(key: Column, values: Column) -> Column:
    return key.isin(*KEYS) & ~key.isin(*MULTIVALUED) & (F.size(values) > 1)


def cardinality(key: Column, values: Column) -> Column:
    """conflict or duplicate for a single-valued key with several values; null otherwise."""
    return F.when(single_valued_multi(key, values), F.when(distinct_values(values) > 1, "conflict").otherwise("duplicate"))


STRATEGIES = ("prefer-incoming", "prefer-base", "fill-empty", "union")


def merge(base: Column, incoming: Column, strategy: str) -> Column:
    """key, values, source, capped, rejected for each key: base's order, then those of incoming alone."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    none = F.array().cast("array<string>")

    def choice(b: Column, i: Column, bv: Column, iv: Column) -> Column:
        from_ = lambda v, source: F.struct(v.alias("v"), F.lit(source).alias("s"))
        if strategy == "prefer-incoming":
            return F.when(i.isNotNull(), from_(iv, "incoming")).otherwise(from_(bv, "base"))
        if strategy == "prefer-base":
            return F.when(b.isNotNull(), from_(bv, "base")).otherwise(from_(iv, "incoming"))
        if strategy == "fill-empty":
            return F.when(F.exists(bv, lambda v: utrim(v) != ""), from_(bv, "base")).when(i.isNotNull(), from_(iv, "incoming")).otherwise(from_(bv, "base"))
        source = F.when(b.isNotNull() & i.isNotNull(), "union").when(b.isNotNull(), "base").otherwise("incoming")
        return F.struct(union_values(bv, iv).alias("v"), source.alias("s"))

    def outcome(key: Column, bv: Column, iv: Column, c: Column) -> Column:
        capped = single_valued_multi(key, c["v"])
        return let(
            F.when(capped, F.slice(c["v"], 1, 1)).otherwise(c["v"]),
            lambda out: F.struct(key.alias("key"), out.alias("values"), c["s"].alias("source"), capped.alias("capped"), rejected(out, bv, iv).alias("rejected")),
        )

    def one(key: Column) -> Column:
        sides = F.struct(values_of(base, key).alias("b"), values_of(incoming, key).alias("i"))
        full = lambda x: F.struct(x["b"].alias("b"), x["i"].alias("i"), F.coalesce(x["b"], none).alias("bv"), F.coalesce(x["i"], none).alias("iv"))
        return let(let(sides, full), lambda x: let(choice(x["b"], x["i"], x["bv"], x["iv"]), lambda c: outcome(key, x["bv"], x["iv"], c)))

    every = F.concat(keys(base), keys(F.filter(incoming, lambda t: ~has(base, t["key"]))))
    return F.transform(every, one)


def merged_tags(merged: Column) -> Column:
    return F.transform(merged, lambda m: entry(m["key"], m["values"]))


def overlay(authoritative: Column, other: Column) -> Column:
    """The authoritative keys, then those that only other has."""
    return F.concat(authoritative, F.filter(other, lambda t: ~has(authoritative, t["key"])))


def patch(tags: Column, ops: Column) -> Column:
    """Ops in order: set, add, clear. A key that was cleared and is set again comes last."""
    step = lambda acc, op: F.when(op["kind"] == "clear", delete(acc, op["key"])).when(op["kind"] == "add", add(acc, op["key"], op["values"])).otherwise(set_(acc, op["key"], op["values"]))
    return F.aggregate(ops, tags.cast(TAGS), lambda acc, op: step(acc, op).cast(TAGS))


def touches(ops: Column, key) -> Column:
    return F.exists(ops, lambda o: o["key"] == key)


def touched_keys(ops: Column) -> Column:
    return F.array_distinct(F.transform(ops, lambda o: o["key"]))


def map_keys(ops: Column, fn) -> Column:
    """fn: from a key Column to a key Column."""
    return F.transform(ops, lambda o: F.struct(o["kind"].alias("kind"), fn(o["key"]).alias("key"), o["values"].alias("values")))


def split_pairs(tags: Column, set_total=None) -> Column:
    """`3/12` on a number key becomes number and total. A total that is there wins, unless set_total (a Column of the total key) says otherwise."""
    def one(ts: Column, key: str, total: str) -> Column:
        def split(v: Column) -> Column:
            n, t = utrim(number_side(v)), utrim(total_side(v))
            to = (~has(ts, total)) if set_total is None else set_total(F.lit(total))
            without = F.when(n != "", set_(ts, key, F.array(n))).otherwise(delete(ts, key))
            return F.when(F.coalesce(splits(F.lit(key), v), F.lit(False)), let(without, lambda w: F.when((t != "") & to, set_(w, total, F.array(t))).otherwise(w))).otherwise(ts)

        return F.when(value_count(ts, key) == 1, let(first(ts, key), split)).otherwise(ts)

    return let(let(tags, lambda ts: one(ts, "TRACKNUMBER", "TRACKTOTAL")), lambda ts: one(ts, "DISCNUMBER", "DISCTOTAL"))


def trim_tokens(tags: Column) -> Column:
    return F.transform(tags, lambda t: entry(t["key"], F.transform(t["values"], lambda v: trim_token(t["key"], v))))


def total_conflict(base: Column, ops: Column) -> Column:
    """Whether a slashed number in the ops meets a total that they set to something else."""

    def bad(now: Column, key: str, total: str) -> Column:
        met = let(first(now, key), lambda v: splits(F.lit(key), v) & (utrim(total_side(v)) != "") & ~same_number(utrim(total_side(v)), first(now, total)))
        return F.coalesce(touches(ops, total) & met, F.lit(False))

    return let(patch(base, ops), lambda now: bad(now, "TRACKNUMBER", "TRACKTOTAL") | bad(now, "DISCNUMBER", "DISCTOTAL"))


def prepare(base: Column, ops: Column) -> Column:
    """An edit's outcome: ops applied, tokens trimmed, pairs split (a slash wins unless the ops touch the total), empty keys dropped."""
    now = trim_tokens(patch(base, ops))
    return drop_empty(split_pairs(now, lambda total: ~touches(ops, total)))


def build_tags(contributions: DataFrame) -> DataFrame:
    """doc_id, tags from rows doc_id, pos, key, value: keys by their first position, values by position; a second value of a number pair is left out."""
    per = contributions.groupBy("doc_id", "key").agg(F.min("pos").alias("p"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    vals = F.transform("v", lambda x: x["value"])
    per = per.select("doc_id", "p", "key", F.when(F.col("key").isin(*NUMBER_PAIR), F.slice(vals, 1, 1)).otherwise(vals).alias("values"))
    gathered = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "key", "values"))).alias("t"))
    return gathered.select("doc_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["values"].alias("values"))).alias("tags"))


def family_conflicts(contributions: DataFrame, source: str = "source", scope: str | None = None) -> DataFrame:
    """doc_id, key (, scope), values, conflict: several sources with several folded values. With a scope the conflict is a key's, over its scopes."""
    by = ["doc_id", "key"]
    at = [*by, scope] if scope else by
    f = fold(F.col("value"))
    per = contributions.groupBy(at).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"), F.collect_set(source).alias("s"), F.collect_set(f).alias("f"))
    if not scope:
        return per.select(*at, F.transform("v", lambda x: x["value"]).alias("values"), ((F.size("s") > 1) & (F.size("f") > 1)).alias("conflict"))
    wide = per.groupBy(by).agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("f")))).alias("m"))
    return per.join(wide, by).select(*at, F.transform("v", lambda x: x["value"]).alias("values"), ((F.col("n") > 1) & (F.col("m") > 1)).alias("conflict"))


def legacy_only(tags: Column, families: Column) -> Column:
    """Keys that only legacy families have, first seen first. families: array of structs with key and legacy."""
    return F.array_distinct(F.transform(F.filter(families, lambda f: f["legacy"] & ~has(tags, f["key"])), lambda f: f["key"]))


def family_selected(authoritative: Column, key, value: Column) -> Column:
    """Whether a secondary container's value agrees with the authoritative set: the key is absent there, or has the value, folded."""
    own = values_of(authoritative, key)
    return own.isNull() | F.exists(own, lambda v: fold(v) == fold(value))


def explode_tags(df: DataFrame, doc: str = "doc_id", tags: str = "tags") -> DataFrame:
    """The long relation doc_id, key, key_pos, val_pos, value; keys without values have null val_pos and value."""
    per = df.select(F.col(doc).alias("doc_id"), F.posexplode(tags).alias("key_pos", "t"))
    return per.select("doc_id", F.col("t.key").alias("key"), "key_pos", F.posexplode_outer("t.values").alias("val_pos", "value"))
