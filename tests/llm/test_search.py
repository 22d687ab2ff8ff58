import re

import numpy as np

from graphloom.llm import ann, licenses, pages, queries

SF = "/root/testdata/sf0.01"


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in queries.op1_nearest(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hits += len(best & set(got[int(ids[i])]))
        total += 20
    assert hits >= 0.9 * total


def test_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (20, [2.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert out == [(20, 1, 1, 2.0), (20, 2, 2, 2.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pages(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><div class=\"ad\">buy</div><article><h1>A &amp; b</h1><p><b>x<br>y<p>z</p><div class='comments'>no</div></article><footer>f</footer>"
    df = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_text(df).collect()}
    assert got == {1: "A & b\n\nx y\n\nz", 2: "", 3: ""}
    table = queries.op5_main_text(spark, SF)
    for r in table.join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", " " if False else "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_licenses(spark):
    long = licenses.TEMPLATES["gpl-notice"]
    df = spark.createDataFrame([(1, "x Released under the MIT License. y"), (2, "a b c " + long.upper() + " d"), (3, None), (4, ""), (5, "nothing of the kind stands here at all")], "doc_id long, text string")
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(df).collect()}
    assert got.pop((1, "mit-line")) == got.pop((2, "gpl-notice")) == 1.0
    assert all(i == 2 and name.endswith("-notice") and share < 1 for (i, name), share in got.items())  # its sisters of other versions
    lines = {"mit-line": "Released under the MIT License.", "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0."}
    got = {(r.doc_id, r.license) for r in queries.op4_licenses(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for name, line in lines.items():
            if line in r.text:
                assert (r.doc_id, name) in got


def test_lengths_and_repeated_ids(spark):
    data = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (20, [0.5, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 1.0, 1.0]), (40, [1.0, 0.0, 2.0]), (5, [1e200, 0.0]), (60, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, q int")
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect())
    one = [(1, 5, 1e200), (2, 3, 2.0), (3, 20, 0.5), (4, 20, 0.5)]
    two = [(1, 5, 5e199), (2, 3, 1.0), (3, 20, 0.5), (4, 20, 0.25)]
    assert got == sorted([(20, *x) for x in [*one, *two, *two]] + [(40, 1, 4, 3.0)])


def test_recall_over_shards(spark):
    """Several shards, norms that differ by far, clusters."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(300, 1, 24)) + 0.2 * rng.normal(size=(300, 60, 24))).reshape(-1, 24) * rng.lognormal(0, 0.7, (18_000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 300 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in range(0, len(x), 300):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[i])
        total += 20
    print("recall", hits / total)
    assert hits >= 0.9 * total


def test_the_search_ends_before_all_points_are_verified():
    """Clustered and spread vectors, in one shard: recall and the share of points that were verified."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 64))
    clustered = centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 64))
    spread = rng.normal(size=(3000, 64)) * rng.uniform(0.5, 1, (3000, 1))
    for x, most in ((clustered, 0.2), (spread, 0.95)):
        ids, looked, got = np.arange(len(x)), [], {}
        asked = ids[::50]
        for place, i, _ in ann.search(ids, x, asked, x[asked], 20, 0.93, looked):
            got.setdefault(place, set()).add(i)
        hits = 0
        for k, i in enumerate(asked):
            s = x @ x[i]
            s[i] = -np.inf
            hits += len(got[k] & set(np.argsort(-s)[:20].tolist()))
        print("recall", hits / len(asked) / 20, "verified", np.mean(looked) / len(x))
        assert hits >= 0.9 * 20 * len(asked) and np.mean(looked) < most * len(x)


def test_points_come_in_the_order_of_their_distance():
    rng = np.random.default_rng(13)
    points = rng.normal(size=(1000, 3))
    at = rng.normal(size=3)
    run = [(i, g) for held, gaps in ann.Tree(points).nearest(points, at) for i, g in zip(held.tolist(), gaps.tolist())]
    assert sorted(i for i, _ in run) == list(range(1000)) and [g for _, g in run] == sorted(g for _, g in run)
