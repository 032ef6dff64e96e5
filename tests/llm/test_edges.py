"""Nulls, empty and very long texts, repeated rows, empty tables, and further columns, through every operator."""

import pytest
from pyspark.sql import functions as F

from tagquarry.llm import ann, bpe, neardup, packing, quality, reputation, secrets, toxicity, warc, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, _drop int, shard int, bucket int, id long"
LONG = "many words in a row, again and again. " * 8000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   \n", "one", LONG, "Some plain text here, for all.", "Some plain text here, for all.", "password=Xk29fjqpZZ81hd82", "\U0001f600 é ñ"]
    rows = [(i, t, None, "s", None if t is None else len(t), 0.5, "k", 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [(None, "A row without an id.", "en", None, 3, None, None, None, None, None, None), rows[5], (5, "Another text of the same id.", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, None), (None, 1, 1), (3, 0, 1), (99, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.where("false")


@pytest.mark.parametrize("name", ["quality", "toxicity", "neardup", "secrets"])
def test_filters_keep_columns_and_rows(name, spark, docs, labels):
    f = {"quality": lambda d: quality.filter_quality(d, labels), "toxicity": lambda d: toxicity.filter_toxic(d, labels), "neardup": neardup.drop_near_duplicates, "secrets": secrets.redact_secrets}[name]
    out = f(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert f(empty(docs)).count() == 0
    texts = [r.text for r in rows]
    if name == "quality":
        assert None not in texts and "" not in texts and LONG in texts
        assert quality.filter_quality(docs, empty(labels)).count() == 9
    if name == "toxicity":
        assert len(rows) == docs.count()
    if name == "neardup":
        again = f(docs.orderBy(F.desc("n_chars"), "text")).where("doc_id = 5").collect()
        assert again == [r for r in rows if r.doc_id == 5]
        ids = [r.doc_id for r in rows]
        assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 1 and {0, 1, 2, 3, 4} <= set(ids)
    if name == "secrets":
        assert len(rows) == docs.count() and "password=[SECRET]" in texts
        assert next(r.n_chars for r in rows if r.doc_id == 7) == len("password=[SECRET]")
        assert next(r.n_chars for r in rows if r.doc_id == 0) is None


def test_scores_have_a_row_for_each_row(docs, labels):
    n = docs.count()
    q = quality.score_quality(docs, labels).collect()
    assert len(q) == n and all(r.score is None and not r.keep for r in q if r.doc_id in (0, 1, 2))
    t = toxicity.score_toxicity(docs, labels).collect()
    assert len(t) == n and not any(r.toxic for r in t)
    s = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert s[0].n_values == 0 and s[0].max_log10_guesses is None and s[7].n_secrets == 1
    e = {r.doc_id: r for r in bpe.encode(docs).collect()}
    assert e[0].tokens is None and e[0].n_tokens is None and e[0].lossless is None and e[1].tokens == [] and e[4].lossless
    for f in (lambda d: quality.score_quality(d, labels), lambda d: toxicity.score_toxicity(d, labels), secrets.scan_secrets, bpe.encode, packing.pack, neardup.near_duplicate_groups):
        assert f(empty(docs)).count() == 0


def test_groups(docs):
    g = {r.doc_id: r for r in neardup.near_duplicate_groups(docs).collect()}
    assert sorted(g) == list(range(9))
    assert g[5].group_id == g[6].group_id == 5 and g[5].group_size == 2 and g[5].keep and not g[6].keep
    assert all(g[i].group_id == i for i in (0, 1, 2, 3, 4))


def test_packing(docs):
    rows = packing.pack(docs, capacity=100).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert 0 < r.n_tokens <= 100 and r.seq_tokens <= 100
    want = {}
    for r in docs.select("doc_id", packing.n_tokens(F.col("text")).alias("n")).collect():
        if r.n:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.n
    assert got == want and want[4] == 80000


def test_pages(spark, labels):
    schema = "page_id long, url string, html string, host string, _host string, n long, domain string, digest string"
    x = (None, None, 1, None, "d")
    rows = [(1, "http://a.b.com/x", "<p>one</p>", *x), (1, "http://a.b.com/x", "<p>one</p>", *x), (2, None, None, *x), (None, "nonsense", "", *x), (3, "http://a.b.com/y", "<p>" + LONG, *x), (5, "HTTPS://u@10.0.0.1:80/", "no markup <b", *x)]
    pages = spark.createDataFrame(rows, schema)
    out = wrappers.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in out if r.text is not None) == [(0, ""), (1, "one"), (1, "one"), (3, " ".join(LONG.split())), (5, "no markup <b")]
    assert len(out) == 6 and wrappers.extract(empty(pages)).count() == 0
    assert sorted((r.page_id or 0, r.text or "") for r in wrappers.extract(pages, broadcast_bytes=0).collect()) == sorted((r.page_id or 0, r.text or "") for r in out)
    judged = reputation.judge_pages(pages, labels).collect()
    assert len(judged) == 6 and all(r.keep for r in judged)
    assert {r.host: (r.domain, r.suffix) for r in judged} == {"a.b.com": ("b.com", "com"), "": ("", ""), "10.0.0.1": ("10.0.0.1", "10.0.0.1")}
    none = reputation.judge_pages(pages, empty(labels)).collect()
    assert len(none) == 6 and {r["mean"] for r in none} == {0.5} and all(r.keep for r in none)
    assert reputation.judge_pages(empty(pages), labels).count() == 0
    records = warc.resolve_revisits(warc.page_records(pages)).collect()
    # Four captures of each distinct page; page 2 (null) and the empty page have the same, empty payload, so 4 originals.
    assert len(records) == 20 and sum(r.warc_type == "response" for r in records) == 4 and sum(r.resolved is True for r in records) == 11
    assert warc.resolve_revisits(warc.page_records(empty(pages))).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (2, [1.0, 0.1], 1), (3, None, 1), (4, [], 1), (5, [1.0], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [0.0, 1.0], 1)]
    v = spark.createDataFrame([(a, b, 0, 0) for a, b, _ in rows], "vec_id long, embedding array<float>, part int, x int")
    got = {}
    for r in sorted(ann.neighbours(v, k=2).collect()):
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert got == {1: [9, 2], 2: [1, 9], 9: [1, 2]}
    assert ann.neighbours(v.where("false")).count() == 0
