import random
import zlib
from collections import Counter, defaultdict

from graphloom.llm import shards
from graphloom.llm.queries import llm_queries

SF = "/root/testdata/sf0.01"


def lawful(rows, n):
    held, places = Counter({k: 0 for k in range(n)}), defaultdict(list)
    for r in rows:
        held[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(held) == set(range(n))
    return held


def test_query(spark):
    rows = llm_queries()["op12_virtual_slots"](spark, SF).collect()
    held = lawful(rows, 40)
    assert max(held.values()) - min(held.values()) <= 0.01 * sum(held.values()) / 40
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_order_and_partitions_play_no_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    runs = [sorted(map(tuple, shards.shard_documents(d, shards=7, slots=512).collect())) for d in (docs.coalesce(1), docs.repartition(9))]
    assert runs[0] == runs[1]


def test_copies_are_dealt(spark):
    """A third of all rows alike, in doc_id too, is no load for one shard; nulls, empty texts and other columns."""
    rows = [(5, "the same words " * 20, "a", 1)] * 1500 + [(i, f"text {i} " * (i % 50), "b", 2) for i in range(3000)] + [(None, None, None, 3), (None, "", "c", 4), (None, "", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(6)
    out = shards.shard_documents(docs, shards=10).collect()
    held = lawful(out, 10)
    assert len(out) == len(rows) and max(held.values()) <= 1.02 * sum(held.values()) / 10
    assert sorted((r.size, r.text_crc32) for r in out if r.doc_id is None) == [(16, 0)] * 3
    alike = Counter(r.shard for r in out if r.doc_id == 5 and r.size > 100)
    assert len(alike) == 10 and max(alike.values()) < 600
    assert shards.shard_documents(docs.limit(0), shards=10).collect() == []


def test_stored_map_keeps_versions_and_moves_little(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "w " * (i % 90)) for i in range(4000)], "doc_id long, text string")
    before = {r.doc_id: r.virtual_slot for r in shards.shard_documents(docs, 8, 1024, path).collect()}
    more = docs.unionByName(spark.createDataFrame([(9000 + i, "w " * 60) for i in range(500)], "doc_id long, text string"))
    after = {r.doc_id: r.virtual_slot for r in shards.shard_documents(more, 8, 1024, path).collect()}
    assert all(after[k] == v for k, v in before.items())
    maps = [shards.read_map(spark, path, v) for v in range(3)]
    assert shards.read_map(spark, path) == maps[2] and all(len(m) == 1024 for m in maps)
    moved = sum(a[2] != b[2] for a, b in zip(maps[1], maps[2], strict=True))
    assert moved < 300


def test_rebalance_and_grow():
    rng = random.Random(3)
    for n in (1, 2, 7, 40):
        rows = shards.first_map({s: int(rng.paretovariate(1.5) * 1000) for s in range(2000)}, 2000, n)
        new = shards.rebalance(rows, n)
        load = Counter()
        for _, _, k, b in new:
            load[k] += b
        assert [r[1] for r in new] == list(range(2000)) and {r[0] for r in new} == {1}
        top = max(b for *_, b in rows)
        assert max(load.values()) - min(load.values()) <= max(top, 50)
        grown = shards.grow(new, n)
        moved = [(a[2], b[2]) for a, b in zip(new, grown, strict=True) if a[2] != b[2]]
        assert moved and all(to == n for _, to in moved) and {r[0] for r in grown} == {2}
        got = sum(b for _, _, k, b in grown if k == n)
        assert 0.8 * sum(load.values()) / (n + 1) <= got <= sum(load.values()) / (n + 1)
        shrunk = shards.rebalance(grown, n)
        assert {k for _, _, k, _ in shrunk} == set(range(n))
    assert shards.rebalance(shards.first_map({}, 64, 5), 5)
