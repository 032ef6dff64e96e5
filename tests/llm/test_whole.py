"""The whole job, where a part of it was done before."""

import random

import numpy as np
import pyarrow as pa

from tagquarry.llm import ann, neardup, secrets, wrappers


def _family(first, n, common, own):
    """n texts that share `common` words and have `own` words each of their own."""
    rng = random.Random(first)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    passage = [word() for _ in range(common)]
    return [(first + i, " ".join(passage + [word() for _ in range(own)])) for i in range(n)]


def test_a_family_below_the_threshold_is_no_group(spark):
    # Pairwise similarity 98 / 248 = 0.395 and 98 / 148 = 0.66.
    rows = _family(0, 700, 100, 75) + _family(1000, 40, 100, 25)
    out = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_size for r in out} == {i: 1 if i < 1000 else 40 for i, _ in rows}


def test_exact_similarity_of_sets():
    b = lambda *x: np.array(x, "<u4").tobytes()
    assert neardup.shared([b(1, 2, 3), b(5), b(1, 2)], [b(2, 3, 4), b(5), b(3, 2**32 - 1)]).tolist() == [0.5, 1.0, 0.0]


def test_quoted_secrets_and_runs_of_blanks():
    scan = lambda t: [(t[a:b], c >= secrets.THRESHOLD) for a, b, c in secrets.scan(t)]
    for value in ("correct horse battery staple", "aB3;x9Kq7LmZ&pT2", "tr0ub&4dor&3xKq9Lm2Z", "Zk8<1>pQx9!rT.,", r"a1\"b2 Xq9\"z"):
        text = f'{{"passphrase": "{value}", "n": "x"}}'
        assert scan(text) == [(value, True)] and secrets._hit(pa.array([text])).tolist() == [0]
    for text in ("password          =          Zk8$1pQx9!rT", "secret_key:\t\t\t\t\t\tZk8$1pQx9!rT", "Authorization: \"Bearer Zk8$1pQx9!rT\""):
        assert scan(text) == [("Zk8$1pQx9!rT", True)] and secrets._hit(pa.array([text])).tolist() == [0]
    assert scan("password='Zk8$1pQx9!rT and no end\nit's") == [("Zk8$1pQx9!rT", True)]


def test_redaction_leaves_nothing_of_a_quoted_secret(spark):
    d = spark.createDataFrame([(1, 'a password="aB3;x9Kq7LmZ&pT2 tail" b')], "doc_id long, text string")
    assert secrets.redact_secrets(d).first()["text"] == 'a password="[SECRET]" b'


def test_an_article_at_two_addresses_is_no_template(spark):
    rows = [(i, f"http://h/{i}", f"<html><h1>title {i}</h1><p>text {i}</p><footer>Shop</footer></html>") for i in range(40)]
    article = "<html><h1>A title</h1><p>text</p><table><tr><td>Its own</td></tr></table><b>words</b><footer>Shop</footer></html>"
    rows += [(100, "http://h/a", article), (101, "http://h/b", article)]
    out = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[100] == out[101] == "A title\ntext\nIts own\nwords" and out[0] == "title 0\ntext 0"


def test_an_id_with_many_vectors_takes_one_place():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[:60] = x[100] + rng.normal(size=(60, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.sort(np.r_[np.full(60, 0), np.arange(1, 241)])
    r, at, s = ann.best_ids(x[100:110], ids[100:110], x, ids, 10)
    cosine = np.rint(x[100:110] @ x.T * np.float32(1e5)).astype(int)
    for i in range(10):
        top = {}
        for j in np.flatnonzero(ids != ids[100 + i]):
            top[int(ids[j])] = max(top.get(int(ids[j]), -300_000), int(cosine[i, j]))
        want = sorted(top, key=lambda n: (-top[n], n))[:10]
        assert ids[at[r == i]].tolist() == want and np.rint(s[r == i] * 1e5).astype(int).tolist() == [top[n] for n in want]
    import pandas as pd

    c = pd.DataFrame({"vec_id": ids, "x": list(x)})
    out = ann._rank(10)((0, 0, 0), c[100:110], c)
    assert all(len(set(f)) == 10 for f in out["found"])
