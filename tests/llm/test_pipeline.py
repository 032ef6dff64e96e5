"""The pipeline on the small tables: each stage against its operator, and run() against the stages by hand."""

from pyspark.sql import functions as F

import corpus_pipeline
from tagquarry.llm import neardup, packing, quality, secrets, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "secrets", "packing"]
    keep = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.keep}
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        stage(spark, now, SF).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        if k < 4:
            assert now.columns == docs.columns
        if name == "quality rules":
            assert ids == keep
        if name == "toxicity":
            assert ids == {r.doc_id for r in toxicity.score_toxicity(before, labels).collect() if not r.toxic}
        if name == "near duplicates":
            assert ids == {r.group_id for r in neardup.near_duplicate_groups(before).collect()}
        if name == "secrets":
            assert now.count() == before.count() and secrets.scan_secrets(now).where("n_secrets > 0").count() == 0
            n = before.join(now.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").count()
            assert n == secrets.scan_secrets(before).where("n_secrets > 0").count() > 0
    want = sorted(map(tuple, now.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want
    assert sorted(map(tuple, packing.pack(spark.read.parquet(str(tmp_path / "3"))).collect())) == want


def test_odd_rows_through_run(spark, tmp_path):
    """Nulls, repeated ids, a very long text, an id beyond 2**53, and a further column of a name the operators use."""
    big = 1152921504606846977
    plain = "The committee met on Tuesday to discuss the plan, and nobody objected to it. "
    texts = [(1, None), (2, ""), (3, plain), (3, plain), (3, "Another text of the same id, which is not like the first one at all."), (None, "A text without an id, of some words."), (None, "A text without an id, of some words."), (big, "A text with a very large id and a few more words."), (7, "Many words stand in a row, again and again, without an end. " * 20_000), (8, "password=\u0130\u0130\u0130\u0130qwerty and password=Xk29fjqpZZ81hd82"), (9, "\U00030000\U00030001 \U00030002")]
    spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, shard double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert big in tokens and None in tokens and tokens[7] == 300_000 and tokens[8] > 3 and {1, 2}.isdisjoint(tokens)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
