import numpy as np
import pyarrow as pa
from test_core import brute

from graphloom.llm import neardup


def near_copies(n, words, most, seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(0, most)):
            w[at] = "".join(rng.choice(list("klmnopq"), 5))
        out.append(" ".join(w))
    return out


def test_a_doc_id_with_two_texts_keeps_its_links(spark):
    a = " ".join(f"a{i}" for i in range(13))
    b = " ".join(f"b{i}" for i in range(12))
    df = spark.createDataFrame([(1, a, 1), (1, b, 1), (2, b + " more", 1), (3, a + " more", 1), (None, a, 1), (4, a, 1), (4, a, 1)], "doc_id long, text string, rep int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, bool(r.kept)) for r in neardup.near_duplicates(df).collect())
    assert got == sorted([(1, 9, 1, True), (1, 8, 1, True), (2, 9, 1, False), (3, 10, 1, False), (0, 9, 0, False), (4, 9, 1, False), (4, 9, 1, False)])


def test_a_cluster_that_no_centre_links(spark):
    texts = [*near_copies(300, 120, 7, 3), *near_copies(60, 9, 2, 4), "", None, "x" * 100_000, "w " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    n, root = brute(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == root
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_tiles_against_all_pairs():
    texts = near_copies(150, 60, 6, 5)
    sign = next(neardup._sign(5)([pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts), pa.array([0] * 150)], names=["doc_id", "text", "text_hash"])])).to_pylist()
    held = [(r["doc_id"], r["doc_id"], r["n"], r["sig"], r["doc_id"] % 2, False, t) for r, t in zip(sign, texts)]
    links = list(neardup.tile_links(held, 5, 85, 0.6))
    for same in (0, 1):
        links += list(neardup.tile_links([(*h[:5], True, h[6]) for h in held if h[4] == same], 5, 85, 0.6))
    root = list(range(150))
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert root == brute(texts)[1]


def test_chains_come_to_an_end(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (103, 102), (7, 7)]
    got = {tuple(r) for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100), (102, 100), (103, 100)}
