import hashlib

import numpy as np

import pyarrow as pa

from graphloom.llm import repeats
from graphloom.llm.repeats import drop_repeats


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raws):
        for j in range(len(b) - 199):
            seen.setdefault(b[j : j + 200], []).append((i, j))
    gone = [np.zeros(len(b), bool) for b in raws]
    for at in seen.values():
        if len(at) > 1:
            for i, j in at:
                gone[i][j : j + 200] = True
    out = []
    for b, g in zip(raws, gone):
        d = np.diff(np.concatenate([[0], g.astype(int)]))
        out.append((len(b), int(g.sum()), int((d == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()))
    return out


def test_repeats(spark):
    rng = np.random.default_rng(3)
    say = lambda n: "".join(rng.choice(list("abcdé fgh"), n))
    passage, other = say(260), say(700)
    texts = [None, "", "short", "x" * 199, "x" * 200, "y" * 450, passage, say(300) + passage + say(300), say(150) + passage[20:240], other, other, other[:500] + say(40) + other[500:], say(5000), passage[:199] + "q", "ab" * 300, say(80) + other[100:600] + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in sorted(drop_repeats(df).collect())]
    assert got == brute(texts)
    assert [tuple(r)[1:] for r in sorted(drop_repeats(df, kinds=1).collect())] == got
    assert drop_repeats(df.limit(0)).count() == 0
    again = df.limit(8).unionByName(df.limit(8))
    assert sorted(r.n_removed for r in drop_repeats(again).collect())[-1] > 0


def test_near_copies(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefg h"), 1500))
    texts = []
    for _ in range(40):
        chars = list(base)
        for at in rng.integers(0, len(base), rng.integers(1, 6)):
            chars[at] = "Z"
        texts.append("".join(chars[rng.integers(0, 300) :]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kinds in (1, 3, 1000):
        assert [tuple(r)[1:] for r in sorted(drop_repeats(df, kinds=kinds).collect())] == brute(texts)


def test_odd_rows(spark):
    """Null and repeated ids, a long repetitive text beside others, a clashing column."""
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    one = say(300)
    texts = [one, one, say(250) + one, "ab" * 200_000, "ab" * 150, one + "é" * 300, say(400_000)]
    ids = [None, None, 7, 7, 8, 9, 10]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, key int, bucket int")
    for kinds in (1, 1000):
        got = sorted(tuple(r)[1:] for r in drop_repeats(df, kinds=kinds).collect())
        assert got == sorted(brute(texts))


def test_stretches(monkeypatch):
    """A document is looked at in stretches; every window is in one run, whatever their length."""
    rng = np.random.default_rng(7)
    text = "".join(rng.choice(list("abcdefgh "), 5000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([5])], names=["doc_id", "text", "key"])
    for stretch in (300, 1000, 1 << 22):
        monkeypatch.setattr(repeats, "STRETCH", stretch)
        runs = next(repeats._anchors([batch])).to_pylist()
        assert sorted(k for r in runs for k in range(r["first"], r["first"] + r["n"])) == list(range(4801))


def test_many_copies_of_one_row(spark):
    """Rows alike in doc_id and text, and rows alike in text without an id: as quick and as right as rows with ids of their own."""
    rng = np.random.default_rng(9)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    text, part = say(10_000), say(3_000)
    rows = [(5, text)] * 2000 + [(None, text)] * 1000 + [(6, say(99) + "#" + text[2000:6000] + "#" + say(699)), (7, part), (8, part[:2000] + "#" + say(49))]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in got) == [(0, 10_000, 10_000, 1, 1000), (5, 10_000, 10_000, 1, 2000), (6, 4800, 4000, 1, 1), (7, 3000, 2000, 1, 1), (8, 2050, 2000, 1, 1)]
