import itertools
import random

import corpus_pipeline

import numpy as np
from oracle import compare

from graphloom.llm import decontam, licenses, mixing, queries

SF = "/root/testdata/sf0.01"


def test_tiling_reordered():
    item = [b"%d" % i for i in range(20)]
    assert decontam.tile(item, item[10:] + [b"x"] + item[:10], 5) == 20
    assert decontam.tile(item, item[:4], 5) == 0


def test_contaminated(spark):
    schema = "doc_id long, text string"
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "pre " + text + " post"), (2, "six seven eight nine ten one two three four five"), (3, "other"), (4, None), (5, "")], schema)
    bench = spark.createDataFrame([(7, text.upper()), (8, None), (9, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.covered) for r in decontam.contaminated(docs, bench).collect()) == [(1, 7, 10), (2, 7, 10)]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def plain_tile(item, doc, least):
    """Greedy string tiling as it is defined: every round looks at every pair of places."""
    a, b, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best, at = least - 1, None
        for i, j in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and a[i + n] and b[j + n]:
                n += 1
            if n > best:
                best, at = n, (i, j)
        if at is None:
            return covered
        for x in range(best):
            a[at[0] + x] = b[at[1] + x] = False
        covered += best


def test_tiling_against_its_definition():
    rng = np.random.default_rng(2)
    for size, words in ((12, 2), (30, 3), (40, 8), (40, 30)):
        for _ in range(12):
            item, doc = ([b"%d" % x for x in rng.integers(0, words, size)] for _ in range(2))
            doc = doc[:10] + item[5 : 5 + rng.integers(0, 20)] + doc[10:] + item[: rng.integers(0, 12)]
            assert decontam.tile(item, doc, 3) == plain_tile(item, doc, 3)
    assert decontam.tile([b"w"] * 300, [b"w"] * 20_000, 5) == 300


def test_blocks(spark, monkeypatch):
    """Items in several blocks, repeated and null ids, the stage's filter, clashing columns."""
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 12)
    say = lambda x, n=10: " ".join(f"{x}{i}" for i in range(n))
    docs = spark.createDataFrame([(1, say("a"), "x"), (1, say("b"), "y"), (None, say("c"), "z"), (2, say("d", 4) + " " + say("a", 9), "x"), (3, "", None), (4, None, None), (5, say("e"), "f"), (5, say("e"), "f")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, say("a")), (7, say("b")), (8, say("c")), (None, say("q"))], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.covered) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, 8, 10), (1, 7, 10), (1, 7, 10), (2, 7, 9)]
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, ""), (4, ""), (5, say("e")), (5, say("e"))]
    assert sorted(map(str, decontam.drop_contaminated(docs, bench.limit(0)).collect())) == sorted(map(str, docs.collect()))


def test_contaminated_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").limit(150).collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = set()
    for r, b in itertools.product(rows, items):
        item, doc = decontam.words(b.text), decontam.words(r.text)
        if {tuple(item[i : i + 5]) for i in range(len(item) - 4)} & {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}:
            n = decontam.tile(item, doc, 5)
            if n >= 0.8 * len(item):
                want.add((r.doc_id, b.item_id, n))
    got = decontam.contaminated(spark.createDataFrame(rows), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id, r.covered) for r in got} == want and want


def test_sql(spark):
    sql = queries.llm_oracles()
    for name in ("op3_near_duplicates", "op4_licenses", "op6_format_chats"):
        compare(queries.llm_queries()[name](spark, SF), sql[name], SF)


def test_edited_licenses(spark):
    rng = np.random.default_rng(4)
    long = {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) > 50}
    rows, want = [], set()
    for n, (name, text) in enumerate(sorted(long.items()) * 12):
        w = text.split()
        for _ in range(rng.integers(0, 1 + len(w) // 25)):
            at, how = rng.integers(0, len(w)), rng.integers(0, 3)
            w[at : at + (how != 1)] = [] if how == 0 else ["changed"]
        rows.append((n, " ".join(["some", "words"] * 20 + w + ["and", "more"] * 9), "license"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    marks = str.maketrans("", "", licenses._MARKS)

    def grams(text):
        w = [x for x in text.lower().translate(marks).split() if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    known = {k: grams(v) for k, v in licenses.TEMPLATES.items()}
    for i, text, _ in rows:
        have = grams(text)
        want |= {(i, k) for k, g in known.items() if len(g & have) >= 0.8 * len(g)}
    assert len(want) > 100 and got == want
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_mix_is_the_sorted_total_cut_at_the_budget(spark):
    rng = np.random.default_rng(5)
    rows = [(i if i % 9 else None, "w " * int(rng.integers(0, 60)), [None, "b", "a", "c", "é"][int(rng.integers(0, 5)) if i % 3 else 1], "t") for i in range(900)]
    docs = spark.createDataFrame([*rows, *rows[:5], (1, None, "a", "t")], "doc_id long, text string, source string, target string")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == 906
    copies = []
    for turn in range(2):
        copies += [(r.virtual_finish + (turn * r.source_size / r.target if r.target else 0), r.size, i) for i, r in enumerate(out)]
    budget, run, took = 1.5 * sum(r.size for r in out), 0, [0] * len(out)
    for _, size, i in sorted(copies):
        took[i] += max(0, min(size, round(budget - run)))
        run += size
    by_source = {}
    for r, t in zip(out, took):
        x = by_source.setdefault(r.source, [0, 0, r.target])
        x[0] += r.taken
        x[1] += t
    # the queue's total is cut once; each source's own cut differs by less than a document
    assert abs(sum(took) - sum(r.taken for r in out)) <= len(by_source)
    assert all(abs(a - b) <= 60 and abs(a - target) <= 1 for a, b, target in by_source.values())
    assert sum(t != r.taken for r, t in zip(out, took)) <= 2 * len(by_source)


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 300 and len({r.doc_id for r in rows}) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)


def test_tiles_by_length_are_the_same():
    rng = random.Random(11)
    for _ in range(300):
        words = [bytes([97 + rng.randrange(rng.choice([1, 2, 4]))]) for _ in range(rng.randrange(1, 40))]
        doc = [bytes([97 + rng.randrange(rng.choice([1, 2, 4]))]) for _ in range(rng.randrange(1, 60))]
        for least in (1, 3, 5):
            assert decontam.tile_long(words, doc, least) == decontam.tile(words, doc, least)


def test_repetitive_texts_take_memory_by_their_length(spark):
    import time
    import tracemalloc

    item, doc = [b"w"] * 2000, [b"w"] * 100_000
    tracemalloc.start()
    began = time.time()
    assert decontam.tile_long(item, doc, 5) == 2000
    assert decontam.tile_long([b"a", b"b"] * 1000, [b"b", b"a", b"b"] * 30_000, 5) == decontam.tile_long([b"a", b"b"] * 1000, [b"b", b"a", b"b"] * 30_000, 5)
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    bench = spark.createDataFrame([(1, "w " * 2000), (2, "w " * 2000 + "end of it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "w " * 100_000), (2, "w " * 100)], "doc_id long, text string")
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == [(1, 1, 2000, 2000), (1, 2, 2000, 2003)]
