"""What must not grow with the tables: rows a task, what Python holds at once, passes over a file."""

import builders as B
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagquarry import catalog
from tagquarry.functions import text as X
from tagquarry.operators import tags as T
from tagquarry.operators import transfer as R
from tagquarry.plans import views
from tagquarry.sources import edit, media


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["edit_preserves", "edit_sets", "media_roundtrip", *(f"read_{k}" for k in catalog._READ)])
def test_a_file_goes_through_python_once(name, spark, sf):
    """One Python step, which no file leaves; nothing is joined or computed twice."""
    p = plan(catalog.QUERIES[name](spark, sf)).split("Initial Plan")[-1]
    assert p.count("MapInArrow") == 1 and "ArrowEvalPython" not in p and "Join" not in p


def test_pieces_are_bounded():
    sizes = [media.PIECE_BYTES // 3] * 10 + [media.PIECE_BYTES * 2] + [1] * 2500
    got = list(media.pieces(sizes, lambda x: x))
    assert [x for p in got for x in p] == sizes and max(map(len, got)) <= media.PIECE_ROWS and all(sum(p[:-1]) < media.PIECE_BYTES for p in got)


VALUES = st.sampled_from(["3/12", " 3 / 12\u00a0", "/7", "3/", "/", "x/3", "1/2/3", "", " ", "+3/-4", "9223372036854775807/9223372036854775808", "9223372036854775807/1", "\u20284", "\x1c5/6", "é", "5\n/6", "0000000000000000000000003/4"])
OPS = st.lists(st.tuples(st.sampled_from(["set", "add", "clear"]), st.sampled_from(["TRACKNUMBER", "TRACKTOTAL", "DISCNUMBER", "DISCTOTAL", "TITLE", "X-A"]), st.lists(VALUES, max_size=2)), max_size=5)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.sampled_from(["TRACKNUMBER", "TRACKTOTAL", "DISCNUMBER", "TITLE"]), st.lists(VALUES, min_size=1, max_size=2)), OPS), min_size=200, max_size=200))
def test_edits_in_python_are_those_of_catalyst(spark, cases):
    rows = [(i, [(k, v) for k, v in t.items()], ops) for i, (t, ops) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, tags {T.TAGS}, ops {T.OPS}")
    got = {r.i: [(x["key"], x["values"]) for x in r.t] for r in df.select("i", T.prepare(F.col("tags"), F.col("ops")).alias("t")).collect()}
    for i, (t, ops) in enumerate(cases):
        assert list(edit.prepared(t, ops).items()) == got[i], (t, ops)


def test_operations_come_whole_from_arrow(spark):
    """Null and empty lists, and a slice of a batch, keep each row's own operations."""
    rows = [(0, None), (1, []), (2, [("set", "TITLE", ["a", "b"]), ("clear", "X", None)]), (3, [("add", "A", [])]), (4, [("set", "B", ["c"])])]
    column = spark.createDataFrame(rows, f"i int, ops {T.OPS}").orderBy("i").coalesce(1).toArrow().combine_chunks().to_batches()[0].column(1)
    assert list(edit._ops(column)) == [x for _, x in rows] and list(edit._ops(column.slice(2, 2))) == [x for _, x in rows[2:4]]


def test_an_outcome_that_was_checked_is_the_one_that_is_read():
    for b in (B.flac([("TITLE", "x")], [(3,)]), B.id3(B.text("TIT2", "x")) + B.mpeg(), B.opus([("a", "b")])):
        e = edit.edited(b, [("set", "TITLE", ["new"])])
        assert e.changed and media.row("x", e.content, e.media) == media.row("x", e.content)
    assert edit.edited(b"junk", []).error and edit.edited(None, []).content is None


def test_sizes_at_a_tie_go_to_the_even_digit(spark):
    """As C, Go and DuckDB print them."""
    sizes = [1280, 1331, 1408, 1536, 2432, 5 << 18, 1023]
    rows = spark.createDataFrame([(x,) for x in sizes], "n long").select(X.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1.2 KiB", "1.3 KiB", "1.4 KiB", "1.5 KiB", "2.4 KiB", "1.2 MiB", "1023 B"]


def test_transfer_binds_its_map_once(spark):
    """The map of dispositions stood in a lambda's body, so it was made for every pair of entries."""
    e = lambda *ks: F.array(*(F.struct(F.lit(k).alias("key"), F.array(F.lit(k.lower())).alias("values")) for k in ks))
    made = F.map_from_entries(F.transform(F.col("source"), lambda t: F.struct(t["key"], F.when(t["key"] == "B", "dropped").otherwise("carried"))))
    df = spark.range(1).select(e("A", "B", "C").alias("source"), F.transform(e("C", "B", "D"), lambda t: F.struct(t["key"].alias("key"), F.array(F.lit("old")).alias("values"))).alias("destination"))
    out = df.select(R.transfer(F.col("source"), F.col("destination"), made).alias("t"))
    assert [(x["key"], x["values"]) for x in out.first().t] == [("C", ["c"]), ("B", ["old"]), ("D", ["old"]), ("A", ["a"])]
    assert R.transfer(F.col("source"), F.col("destination"), made)._jc.toString().count("map_from_entries") == 1


def test_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """A file of many splits and one row group is read by one task: its rows must still reach all."""
    monkeypatch.setattr(views, "ROWS_A_TASK", 1000, raising=False)
    spark.range(10_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        sizes = [r["count"] for r in views.spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 10_000 and len(sizes) == 10 and max(sizes) < 1500
