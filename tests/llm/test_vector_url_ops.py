"""Embeddings, URLs and connected components against brute force."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F


def vectors(n=300, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and i % 3 == 0:
            j = int(rng.integers(len(rows)))
            v = (np.asarray(rows[j][1]) + rng.normal(0, rng.choice([0.0, 0.02, 0.05]), 16)).tolist()
            label = rows[j][2]
        else:
            v, label = rng.normal(size=16).tolist(), int(rng.integers(3))
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


def test_embeddings(spark):
    from spanlake.llm.op1_embeddings import near_duplicates
    good = vectors()
    bad = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, good[0][1], None), (1004, [None] * 16, 1),
           (1005, [float("inf")] + [0.0] * 15, 1), (1006, [], 1), (1007, [1.0, 2.0], 1), (None, good[0][1], good[0][2])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("vec", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    x = np.array([v for _, v, _ in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for *_, c in good])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(close, False)
    comp = brute.components(range(len(good)), [tuple(p) for p in np.argwhere(close).tolist()])
    assert close.sum() > 50
    assert all(got[i] == (close[i].sum(), comp[i], comp[i] == i) for i in range(len(good)))
    assert all(got[i][:2] == (0, i) for i in range(1000, 1008)) and got[None][0] == 0
    assert near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    from conftest import MEDIUM
    from spanlake.llm.op1_embeddings import near_duplicates
    e = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    rows = e.toPandas()
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # near copies of every vector, by noise that leaves a cosine around the threshold
    rng = np.random.default_rng(1)
    y = x + rng.normal(0, 0.042, x.shape)
    both = np.concatenate([x, y / np.linalg.norm(y, axis=1, keepdims=True)])
    label = np.concatenate([rows.label, rows.label])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(both, label))], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in near_duplicates(df).collect())
    close = (both @ both.T >= 0.93) & (label[:, None] == label[None])
    want = close.sum() - len(both)
    assert want > 200 and 0.9 * want <= found <= want


def test_blocks_of_long_lists(spark, monkeypatch):
    from spanlake.llm import op1_embeddings as E
    monkeypatch.setattr(E, "BLOCK", 7)
    rows = vectors(120, seed=5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    few = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    monkeypatch.setattr(E, "BLOCK", 2000)
    assert few == {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}


def test_components(spark):
    from spanlake.llm.store import components
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500 + i) for i in range(80)]
    edges += [(9, None), (None, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    want = brute.components({n for e in real for n in e}, real)
    size = {}
    for n, c in want.items():
        size[c] = size.get(c, 0) + 1
    assert got == {n: c for n, c in want.items() if size[c] > 1}


def test_urls(spark):
    from spanlake.llm.op7_urls import judge
    pages = [
        (1, "https://A.Example.COM/en/x?q=1", None), (2, "http://www.example.com/en/", ""), (3, "http://x.net/es/1#top", "<html>"),
        (4, "http://net/fr/", None), (5, "http://x.net/es", None), (6, "no scheme", None), (7, None, "<link rel=canonical href='http://x.net/es/1'>"),
        (8, "ftp://other.org/a", "<link rel=\"canonical\" href=\"http://x.net/es/1\">"), (9, "http://other.org/a/?utm_source=z", None),
        (10, "http://far.org/", "<meta http-equiv='refresh' content='0; url=http://other.org/a'>"), (11, "http://clean.org/", None),
        (12, "http://both.org/", "<link rel=canonical href='http://x.net/fr/2'>"), (13, "http://x.net/fr/2", None),
        (14, "http://both.org/p", "<link rel=canonical href='http://both.org/'>"), (15, "http://ok.com/z", "<link rel=canonical href='http://both.org/'>"),
        (16, "http://xnet/es/", None), (17, "http://example.com/en", None), (1, "https://A.Example.COM/en/x?q=1", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("verdict", F.lit("x"))
    rows = judge(df).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block") and got[4] == ("net", "/fr/", "net/fr/", "block")
    assert got[5] == ("x.net", "/es", None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][3] == got[9][3] == got[10][3] == "block"  # aliases of a blocked page, over two steps
    assert got[11][3] == "allow"
    assert got[13][3] == "block" and got[12][3] == got[14][3] == "allow"  # an allowed alias goes before a blocked one
    assert got[15] == ("ok.com", "/z", "com/", "allow") and got[16][2] is None and got[17][2] == "com/"
    assert judge(df.limit(0)).count() == 0


LINKED = [
    (1, "http://a.org/x/y", "<link href='/bad' rel=\"alternate canonical\">"), (2, "http://a.org/bad", "<link rel=canonical href=//x.net/es/1>"),
    (3, "http://x.net/es/1", None), (4, "http://b.org/d/e/f?q=1", "<META content=\"0; URL=../g/./h\" HTTP-EQUIV='Refresh'><link rel='canonical' href='http://x.net/fr/9'>"),
    (5, "http://b.org/d/g/h", None), (6, "http://x.net/fr/9", ""), (7, "http://c.org/k", "<link rel=canonical href='#top'><link rel=canonical href='mailto:x@y.z'>"),
    (8, "http://c.org/l/m", "<link rel=canonical href='?p=2'>"), (9, "http://c.org/l/m?p=2", "<link rel=canonical href='n'>"),
    (10, "http://c.org/l/n", "<link rel=canonical href='http://www.example.com/en/z'><link rel=canonical href='http://x.net/es/7'>"),
    (11, "http://x.net/es/7", None), (12, "http://d.org/", "<link data-rel=canonical href='http://x.net/es/1'><a rel=canonical href='http://x.net/es/1'>"),
    (13, "no scheme", "<link rel=canonical href='http://x.net/es/1'>"), (14, "http://e.org", "<link rel=canonical href='../../bad'>"),
    (15, "http://e.org/bad", "<link rel=canonical href='http://x.net/es/1'>"), (16, "http://www.example.com/en/z", None)]


def test_all_and_relative_links_lead_to_aliases(spark):
    import duckdb
    from spanlake.llm.op7_urls import judge
    from spanlake.llm.oracle import URL_FILTER
    df = spark.createDataFrame(LINKED, "page_id long, url string, html string")
    rows = judge(df).collect()
    got = {r.page_id: r.verdict for r in rows}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 11, 14, 15}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", LINKED)
    assert sorted(map(str, con.execute(URL_FILTER).fetchall())) == sorted(str(tuple(r)) for r in rows)


def test_vectors_of_many_lengths(spark):
    """Any number of different lengths; equal vectors of each link."""
    from spanlake.llm.op1_embeddings import near_duplicates
    rows = [(2 * n + c, [float(i % 7 + 1) for i in range(n)], 0) for n in range(1, 41) for c in (0, 1)]
    rows += [(1000 + n, [float(i % 7 + 1) for i in range(n)][:-1] + [9.0], 0) for n in range(2, 41)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert all(got[2 * n + 1].component_id == got[2 * n].component_id and got[2 * n].n_links >= 1 for n in range(1, 41))
    assert len(got) == len(rows)
