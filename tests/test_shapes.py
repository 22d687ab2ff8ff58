"""Graphs that are written alike are counted before any of their descriptors is worked out."""

import pytest

from graphloom.operators import metrics, pairs
from graphloom.plans.moments import clustering_shapes, spectral_shapes

KIND = "side string, nodes array<string>, edges array<struct<u: string, v: string>>"


def _graphs(spark):
    """A triangle, a path and a lone node under many names."""
    rows = []
    for k in range(60):
        a, b, c = f"a{k}", f"b{k}", f"c{k}"
        edges = [[(a, b), (b, c), (a, c)], [(a, b), (b, c)], []][k % 3]
        rows.append(("gen" if k < 30 or k % 3 else "ref", [a, b, c] if edges else [a], edges))
    return spark.createDataFrame(rows, KIND)


def test_shapes_are_few_and_weigh_all_graphs(spark):
    graphs = _graphs(spark)
    shapes = metrics.graph_shapes(graphs)
    assert sorted((r.side, len(r.nodes), len(r.edges), r.c) for r in shapes.collect()) == [("gen", 1, 0, 20.0), ("gen", 3, 2, 20.0), ("gen", 3, 3, 10.0), ("ref", 3, 3, 10.0)]
    plain, weighed = ({(r.side, tuple(r.hist)): r.c for r in x.collect()} for x in (metrics.degree_shapes(graphs), metrics.degree_shapes(shapes, "c")))
    assert plain == weighed
    for every, few in ((clustering_shapes(graphs), clustering_shapes(shapes, "c")), (spectral_shapes(graphs).drop("c"), spectral_shapes(shapes, weight="c"))):
        whole = pairs.mmd(every.select("side", "v"), "tv", is_hist=True).first()[0]
        assert pairs.mmd(few.select("side", "v", "c"), "tv", is_hist=True, weight="c").first()[0] == pytest.approx(whole, abs=1e-12)
