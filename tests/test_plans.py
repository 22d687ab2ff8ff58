import pytest
from oracle import compare

from graphloom.operators import codecs, molmetrics, pairs
from graphloom.operators import molecules as m
from graphloom.plans import datasets
from graphloom.plans.datasets import DATASETS

SF = "/root/testdata/sf0.001"
SMILES = ["CCO", "c1ccccc1O", "CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "C", "not one", None]


@pytest.mark.parametrize("name", sorted(k for k, (_, o) in DATASETS.items() if o))
def test_against_duckdb(spark, name):
    query, oracle = DATASETS[name]
    compare(query(spark, SF), oracle, SF)


@pytest.mark.parametrize("scheme", ["hsent", "hdt", "hdtc", "flat"])
def test_from_strings_to_a_cached_set_and_back(spark, tmp_path, scheme):
    mols = spark.createDataFrame(list(enumerate(SMILES)), "mol_id long, smiles string")
    graphs = datasets.molecule_graphs(mols)
    config = {"method": "affinity", "seed": 5}
    tokens, vocabulary = datasets.token_set(spark, str(tmp_path), "own", "train", scheme, graphs, 5, config)
    again, same = datasets.token_set(spark, str(tmp_path), "own", "train", scheme, graphs.limit(0), 5, {**config, "nodes": codecs.vocabulary(graphs)})
    assert vocabulary == same and sorted(map(str, tokens.collect())) == sorted(map(str, again.collect()))
    rows = {r.graph_id: r.tokens for r in tokens.collect()}
    assert set(rows) == {0, 1, 2, 3, 4} and all(0 <= t < vocabulary for x in rows.values() for t in x)
    if scheme == "flat":
        return
    read = {r.graph_id: r for r in codecs.decode(tokens, scheme, codecs.vocabulary(graphs)).collect()}
    for r in graphs.collect():
        assert [x.label for x in read[r.graph_id].labels] == r.labels
        assert [tuple(e) for e in read[r.graph_id].edges] == [tuple(e) for e in r.edges]
    strings = m.graphs_to_smiles(
        spark.createDataFrame([(k, x.node, x.label) for k, v in read.items() for x in v.labels], "mol_id long, idx int, label int"),
        spark.createDataFrame([(k, e.u, e.v, e.label) for k, v in read.items() for e in v.edges], "mol_id long, src int, dst int, label int"),
    )
    assert {r.mol_id: r.smiles for r in strings.collect()} == {r.mol_id: r.c for r in mols.select("mol_id", m.canonical("smiles").alias("c")).where("c IS NOT NULL").collect()}


def test_batches(spark):
    tokens = spark.createDataFrame([(i, [0, *range(6, 6 + i % 5), 1]) for i in range(103)], "graph_id long, tokens array<int>")
    rows = datasets.batches(tokens, 8, most=5).collect()
    assert sorted(r.graph_id for b in rows for r in b.rows) == list(range(103))
    for b in rows:
        assert {len(r.tokens) for r in b.rows} == {b.batch.length} and b.batch.length <= 5 and all(r.tokens[-1] == 1 for r in b.rows)
    assert datasets.batches(tokens.limit(0), 8).collect() == []


def test_evaluation(spark):
    mols = lambda *s: spark.createDataFrame(list(enumerate(s)), "mol_id long, smiles string")
    told = {r.metric: r.value for r in molmetrics.evaluation(mols(*SMILES), mols(*SMILES)).collect()}
    assert told["validity"] == pytest.approx(5 / 7) and told["uniqueness"] == 1 and told["novelty"] == 0
    assert all(told[k] == pytest.approx(1) for k in ("fragment_cosine", "scaffold_cosine", "scaffold_retention", "snn")) and 0 < told["internal_diversity"] < 1
    assert all(abs(told[f"motif_{k}_mmd"]) < 1e-9 for k in ("fg", "smarts", "ring", "brics"))
    apart = {r.metric: r.value for r in molmetrics.evaluation(mols("CCO", "CCN"), mols("c1ccccc1")).collect()}
    assert apart["novelty"] == 1 and apart["fragment_cosine"] == 0 and apart["scaffold_retention"] == 0 and apart["snn"] < 0.5
    none = {r.metric: r.value for r in molmetrics.evaluation(mols(None), mols("CCO")).collect()}
    assert none["validity"] == 0 and none["snn"] == 0 and none["motif_ring_mmd"] == float("inf")


def test_nearest_in_tiles(spark):
    import random

    rng = random.Random(5)
    a = [[rng.getrandbits(40), rng.getrandbits(40)] for _ in range(30)]
    b = [[rng.getrandbits(40), rng.getrandbits(40)] for _ in range(23)]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "v array<long>")
    similar = lambda x, y: sum(bin(p & q).count("1") for p, q in zip(x, y)) / sum(bin(p | q).count("1") for p, q in zip(x, y))
    for tile in (4, 1024):
        got = {tuple(r.v): (r.n, r.best) for r in pairs.nearest(df([*a, a[0]]), df(b), tile=tile).collect()}
        assert len(got) == 30 and got[tuple(a[0])][0] == 2
        assert all(got[tuple(x)][1] == pytest.approx(max(similar(x, y) for y in b)) for x in a)


def test_readers_references_and_json(spark, tmp_path):
    from graphloom.sources.molecules import read_qm9

    spark.createDataFrame([(1, "CCO"), (2, None), (3, ""), (4, "CN")], "id int, smiles string").coalesce(1).write.parquet(f"{tmp_path}/q.parquet")
    assert [r.smiles for r in read_qm9(spark, f"{tmp_path}/q.parquet").collect()] == ["CCO", "CN"] and read_qm9(spark, f"{tmp_path}/q.parquet", 1).count() == 1
    spark.createDataFrame([("C", 1)], "smiles string, n int").write.option("header", True).csv(f"{tmp_path}/q.csv")
    assert read_qm9(spark, f"{tmp_path}/q.csv").collect() == [("C",)]
    mols = spark.createDataFrame(list(enumerate(SMILES)), "mol_id long, smiles string")
    one = datasets.reference_graphs(spark, mols, f"{tmp_path}/ref", 4)
    assert sorted(map(str, one.collect())) == sorted(map(str, datasets.reference_graphs(spark, mols.limit(0), f"{tmp_path}/ref", 4).collect()))
    tokens = datasets.tokenise(datasets.molecule_graphs(mols), "hdt")
    datasets.export_json(mols, tokens, f"{tmp_path}/json")
    held = {r.mol_id: r for r in spark.read.json(f"{tmp_path}/json").collect()}
    assert set(held) == {0, 1, 2, 3, 4} and held[0].smiles == "CCO" and held[0].atoms == [0, 0, 2] and len(held[0].tokens) > 10


def test_motif_aware_communities(spark):
    from graphs import frame

    from graphloom.operators import levels

    cliques = [(a, b, 0) for k in range(3) for a in range(4 * k, 4 * k + 4) for b in range(a + 1, 4 * k + 4)]
    graphs = {0: (list(range(12)), [0] * 12, sorted([*cliques, (3, 4, 0), (7, 8, 0)])), 1: ([0, 1], [0, 0], [(0, 1, 0)])}
    df = frame(spark, graphs)
    matches = spark.createDataFrame([(0, [0, 1, 2, 3]), (0, [4, 5, 6, 7]), (0, [3, 4])], "graph_id long, atoms array<int>")
    plain = {r.graph_id: r for r in levels.motif_communities(df, matches, 0.0).collect()}
    assert plain[0].communities == [0] * 4 + [1] * 4 + [2] * 4 and plain[0].cohesion == pytest.approx(2 / 3) and plain[1].cohesion == 1.0
    pulled = {r.graph_id: r for r in levels.motif_communities(df, spark.createDataFrame([(0, [2, 3, 4, 5])], "graph_id long, atoms array<int>"), 50.0).collect()}
    assert len(set(pulled[0].communities[2:6])) == 1
    single = levels.hierarchy(df, "simple", depth=1).collect()
    assert max(len(r.path) for r in single) == 1 and sum(r.graph_id == 0 and len(r.path) == 1 for r in single) == 3
