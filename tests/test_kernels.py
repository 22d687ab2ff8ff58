import numpy as np
import pytest
from oracle import compare

from graphloom.operators import kernels
from graphloom.operators.graphs import graph_oracles, graph_queries

TRIANGLES = (6, {(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)})


@pytest.mark.parametrize("scheme", ["flat", "hdt", "hsent", "hdtc"])
def test_two_triangles(scheme):
    n, edges = TRIANGLES
    part = np.array([0, 0, 0, 1, 1, 1])
    got_n, got = kernels.decode(scheme, kernels.encode(scheme, n, edges, part))
    assert got_n == n
    if scheme == "flat":
        rename = {i: i for i in range(n)}
        got = {tuple(sorted((rename[u], rename[v]))) for u, v in got}
    assert got == edges


def test_partitions():
    n, edges = TRIANGLES
    weight = {e: 1.0 if e == (2, 3) else 2.0 for e in edges}
    for part in (kernels.spectral_partition(n, edges), kernels.affinity_partition(n, edges, weight)):
        assert len(set(part[:3])) == 1 and len(set(part[3:])) == 1 and part[0] != part[5]
    assert kernels.order(n, edges)[0] in (2, 3)
    assert abs(kernels.spectral_histogram(*TRIANGLES).sum() - 1) < 1e-6


@pytest.mark.parametrize("name", sorted(graph_queries()))
def test_invariants(spark, name):
    compare(graph_queries()[name](spark, "/root/testdata/sf0.001"), graph_oracles()[name], "/root/testdata/sf0.001")
