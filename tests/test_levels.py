import pytest
from graphs import frame, labelled
from oracle import compare

from graphloom.operators import levels
from graphloom.plans.baskets import BASKET_ORACLES, BASKET_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("method", ["spectral", "affinity"])
def test_children_make_up_their_parent(spark, method):
    graphs = labelled()
    parts = levels.hierarchy(frame(spark, graphs), method).collect()
    by = {(r.graph_id, tuple(r.path)): r for r in parts}
    assert {g for g, p in by if not p} == set(graphs) and len(by) == len(parts)
    for (g, path), r in by.items():
        assert r.nodes == sorted(r.nodes)
        assert sorted((e.u, e.v, e.label) for e in r.edges) == [e for e in graphs[g][2] if e[0] in r.nodes and e[1] in r.nodes]
        children = [by[g, (*path, c)] for c in sorted(set(r.communities or []))]
        if r.communities is None:
            assert not any(p[: len(path)] == path and len(p) > len(path) for q, p in by if q == g)
        else:
            assert len(r.nodes) >= levels.MIN_SIZE and len(children) > 1
            assert sorted(x for c in children for x in c.nodes) == r.nodes
            assert [c.nodes[0] for c in children] == sorted(c.nodes[0] for c in children)
    assert max(len(p) for _, p in by) >= 2


@pytest.mark.parametrize("method", ["spectral", "affinity"])
def test_edges_come_back(spark, method):
    graphs = labelled()
    df = frame(spark, graphs)
    got = levels.named(levels.reconstruct(levels.hierarchy(df, method)), df).collect()
    assert sorted(map(tuple, got)) == sorted((g, ids[u], ids[v], k) for g, (ids, _, edges) in graphs.items() for u, v, k in edges)


def test_pairs_and_sizes(spark):
    graphs = {0: ([5, 6, 7, 8], [0] * 4, [(0, 1, 1), (0, 2, 2), (1, 3, 0), (2, 3, 3)])}
    parts = spark.createDataFrame([(0, [], [0, 1, 2, 3], graphs[0][2], [0, 1, 0, 1]), (0, [0], [0, 2], [(0, 2, 2)], None), (0, [1], [1, 3], [(1, 3, 0)], None)], f"graph_id long, path array<int>, nodes array<int>, edges {levels.EDGES}, communities array<int>")
    (pair,) = levels.bipartites(parts).collect()
    assert (pair.left, pair.right, [tuple(x) for x in pair.pairs]) == (0, 1, [(0, 0, 1), (1, 1, 3)])
    assert sorted(map(tuple, levels.reconstruct(parts).collect())) == [(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 3, 0), (0, 2, 3, 3)]
    assert sorted(map(tuple, levels.level_sizes(parts).collect())) == [(0, 0, 1, 4, 4), (0, 1, 2, 4, 2)]


def test_no_graphs(spark):
    assert levels.hierarchy(frame(spark, labelled()).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["hierarchy_spectral_edges", "hierarchy_affinity_edges", "hierarchy_cover"])
def test_queries(spark, name):
    compare(BASKET_QUERIES[name](spark, SF), BASKET_ORACLES[name], SF)


@pytest.mark.parametrize("method", ["spectral", "affinity"])
def test_parts_of_one_size_are_split_in_one_step(method):
    """Many graphs take as few steps as one, and give what each gives alone."""
    graphs = [(len(ids), edges) for ids, _, edges in labelled().values()] * 5
    steps = []

    def find(n, alike):
        steps.append(n)
        return levels.METHODS[method](n, alike)

    together = sorted(levels._parts(find, graphs, levels.MIN_SIZE, None), key=lambda x: x[:2])
    alone = [(g, *part[1:]) for g, graph in enumerate(graphs) for part in levels._parts(levels.METHODS[method], [graph], levels.MIN_SIZE, None)]
    assert together == sorted(alone, key=lambda x: x[:2])
    levels_of = {n: max((len(p[1]) for p in together if len(p[2]) == n), default=0) + 1 for n in set(steps)}
    assert all(steps.count(n) <= levels_of[n] for n in steps)


def test_edges_come_back_without_joins_of_parts(spark):
    df = frame(spark, labelled())
    plan = levels.reconstruct(levels.hierarchy(df))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
