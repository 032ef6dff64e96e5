"""Every query against its SQL in DuckDB, at the smallest scale, and the scalar functions' cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagquarry import catalog
from tagquarry.functions import text as X
from tagquarry.functions import values as V
from tagquarry.functions import vocabulary as K
from tagquarry.operators import chapters as C
from tagquarry.operators import lint as L
from tagquarry.operators import tags as T
from tagquarry.operators import transfer as R

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(name, spark, duck, sf):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    cursor = duck.execute(catalog.SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    order = [theirs.index(n) for n in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    assert a == b and a


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, a string" + (", b string" if isinstance(values[0], tuple) else ""))
    return [r[0] for r in df.orderBy("i").select(f(*(F.col(c) for c in df.columns[1:]))).collect()]


def test_vocabulary():
    assert len(K.KEYS) == len(set(K.KEYS)) == 68 and len(K.MULTIVALUED) == 15 and len(K.ALIASES) == 18 and set(K.MULTIVALUED) | set(K.TRIMMABLE) | set(K.OWN_AUDIO) <= set(K.KEYS)


def test_value_cases(spark):
    num = [("TRACKNUMBER", "3"), ("TRACKNUMBER", " 3 "), ("TRACKNUMBER", "3/4"), ("TRACKNUMBER", "-1"), ("TRACKNUMBER", "3/"), ("TRACKNUMBER", "/2"), ("TRACKNUMBER", "abc"), ("TRACKNUMBER", "3/x"), ("TRACKTOTAL", "3/4"), ("TRACKNUMBER", "/"), ("TRACKNUMBER", "1/2/3"), ("TRACKNUMBER", "\x013"), ("TRACKNUMBER", "99999999999999999999")]
    assert column(spark, num, V.is_number) == [True] * 6 + [False] * 7
    dates = ["1999", "1987-12", "2024-02-29", "2021-13", "0000", "2023-02-29", "2021-7-4", "1900-04-31", ""]
    assert column(spark, dates, V.is_partial_date) == [True] * 3 + [False] * 6
    g = "REPLAYGAIN_TRACK_GAIN"
    gains = [(g, "-6.5 dB"), (g, "-6.5dB"), (g, "+2.34"), (g, ".5"), (g, "5."), (g, "1e3"), (g, "0x1p-2"), (g, "1_0.5"), (g, "."), (g, "1.2.3"), (g, "nan"), (g, ""), ("REPLAYGAIN_TRACK_PEAK", "-0.0"), ("REPLAYGAIN_TRACK_PEAK", "+0.5")]
    assert column(spark, gains, V.is_gain) == [True] * 5 + [False] * 8 + [True]
    assert column(spark, ["GB", "gb", " GB ", "XW", "", "GBR", "G1", "G-"], V.is_country) == [True] * 4 + [False] * 4
    assert column(spark, ["0", "255", "256", "-1", "+1", "x", "9" * 50], V.is_media_type) == [True, True, False, False, False, False, False]
    assert column(spark, ["03", "+3", "-03", "-0", "00", "", "x1", "9" * 30, " 7 "], V.canonical_number) == ["3", "3", "-3", "0", "0", "", "x1", "9" * 30, "7"]
    assert column(spark, ["1", "TRUE", " yes ", "0", "No", "maybe"], V.boolean) == [True, True, True, False, False, None]
    assert column(spark, ["1:02:03.5", "90", "1:60", "90:00", "x", "1:60:00"], V.clock_ms) == [3723500, 90000, None, 5400000, None, None]


def test_text_cases(spark):
    assert column(spark, [" title ", "my key", "a=b", "é", "", " X\u0085", "T\tB"], X.parse_key) == ["TITLE", "MY KEY", None, None, None, "X", None]
    assert column(spark, ["Name (guitar)", "Name", "(note)", "()", "Name ()", "A (b) (c) "], lambda c: F.concat_ws("|", X.performer_name(c), X.performer_role(c))) == ["Name|guitar", "Name|", "(note)|", "()|", "Name ()|", "A (b)|c"]
    assert column(spark, ["FLAC", "AIFF", "MP3", "mp4", "Ogg", ""], X.indefinite_article) == ["a", "an", "an", "an", "an", "a"]
    assert column(spark, ["a\nb\x1bc", "ok"], X.escape_control) == ["a\\x0ab\\x1bc", "ok"]


def tags(*pairs):
    return F.array(*(F.struct(F.lit(k).alias("key"), (F.array(*map(F.lit, v)) if v else F.array()).cast("array<string>").alias("values")) for k, v in pairs)).cast(T.TAGS)


def got(spark, c):
    return [(t["key"], t["values"]) for t in spark.range(1).select(c).first()[0]]


def test_tag_cases(spark):
    base = tags(("A", ["1"]), ("B", []), ("C", ["x", "y"]))
    ops = lambda *o: F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("key"), (F.array(*map(F.lit, v)) if v else F.array()).cast("array<string>").alias("values")) for k, n, v in o)).cast(T.OPS)
    assert got(spark, T.patch(base, ops(("set", "A", ["2"]), ("clear", "C", []), ("set", "C", ["z"]), ("add", "B", ["b"])))) == [("A", ["2"]), ("B", ["b"]), ("C", ["z"])]
    assert got(spark, T.patch(base, ops(("clear", "A", []), ("set", "A", ["n"])))) == [("B", []), ("C", ["x", "y"]), ("A", ["n"])]
    assert got(spark, T.prepare(tags(("TRACKTOTAL", ["9"])), ops(("set", "TRACKNUMBER", [" 3/12 "]), ("set", "X", [])))) == [("TRACKTOTAL", ["12"]), ("TRACKNUMBER", ["3"])]
    assert got(spark, T.prepare(tags(), ops(("set", "TRACKNUMBER", ["3/12"]), ("set", "TRACKTOTAL", ["8"])))) == [("TRACKNUMBER", ["3"]), ("TRACKTOTAL", ["8"])]
    assert spark.range(1).select(T.total_conflict(tags(), ops(("set", "TRACKNUMBER", ["3/12"]), ("set", "TRACKTOTAL", ["8"]))), T.total_conflict(tags(), ops(("set", "TRACKNUMBER", ["3/12"]), ("set", "TRACKTOTAL", ["012"])))).first()[:] == (True, False)
    assert got(spark, T.split_pairs(tags(("TRACKNUMBER", ["/12"]), ("DISCNUMBER", ["1/2/3"])))) == [("DISCNUMBER", ["1/2/3"]), ("TRACKTOTAL", ["12"])]
    assert got(spark, T.drop_empty(base)) == [("A", ["1"]), ("C", ["x", "y"])]
    same = spark.range(1).select(T.equal(base, F.reverse(base)), T.equal(base, tags(("A", ["1"]), ("B", []), ("C", ["y", "x"])))).first()
    assert same[:] == (True, False)
    with pytest.raises(ValueError):
        T.merge(base, base, "best")


def test_lrc_cases(spark):
    parse = lambda s: [(x["time_ms"], x["text"]) for x in spark.createDataFrame([(s,)], "t string").select(C.parse_lrc(F.col("t"))).first()[0]]
    assert parse("[00:02.00][00:01.5]two\n[00:01.00] one\n[ti:x]\nplain\n[00:03.00]") == [(1000, "one"), (1500, "two"), (2000, "two"), (3000, "")]
    assert parse("﻿[offset:500]\n[00:00.200]a\n[01:02:03.4567]b\n[00:99.00]bad") == [(0, "a"), (3722956, "b")]
    text = "[00:01.000]a\n[100:00.250]b c"
    assert spark.createDataFrame([(text,)], "t string").select(C.format_lrc(C.parse_lrc(F.col("t")))).first()[0] == text


def test_lint_and_transfer_cases(spark):
    fams = F.array(F.struct(F.lit("A").alias("key"), F.lit(False).alias("selected"), F.lit(True).alias("legacy")))
    ws = F.array(*(F.struct(F.lit(c).alias("code"), F.lit("m").alias("message")) for c in ("no-audio", "chained-stream", "numeric-genre")))
    pics = F.array().cast("array<struct<type:int,mime:string,data:binary>>")
    f = spark.range(1).select(L.lint(tags(("TITLE", ["a", "b"])), ws, fams, F.lit(True), pics).alias("f")).select("f", L.worst(F.col("f")), L.exit_code(F.col("f"))).first()
    assert [x["code"] for x in f[0]] == ["no-audio", "numeric-genre", "conflicting-families", "legacy-only-tags", "legacy-opaque-content", "single-valued-multi"] and f[1:] == ("error", 4)
    fix = spark.range(1).select(L.safe_fix(tags(("ENCODER", ["Lavf60"]), ("A", ["x"])), fams)).first()[0]
    assert fix["drop_encoder"] and fix["strip_legacy"]
    one = lambda **k: R.dispose(F.lit(k.get("write", "full")), F.lit(k.get("ro", False)), F.lit(k.get("n", 1)), F.lit(k.get("most", 0)), F.lit(k.get("drops", False)), F.lit(k["reduces"]) if "reduces" in k else None, F.lit(k.get("c", "carried")))
    cases = [dict(), dict(ro=True), dict(write="none"), dict(n=256, most=255), dict(drops=True), dict(reduces=True), dict(reduces=False, write="partial"), dict(write="partial"), dict(c="dropped")]
    assert list(spark.range(1).select(*(one(**c).alias(str(i)) for i, c in enumerate(cases))).first()) == ["carried", "dropped", "dropped", "dropped", "dropped", "lossy", "carried", "lossy", "dropped"]
