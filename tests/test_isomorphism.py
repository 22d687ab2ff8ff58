import itertools
import random

from graphs import PLAIN
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from graphloom.functions import canonical
from graphloom.operators import isomorphism
from graphloom.plans.baskets import BASKET_ORACLES, BASKET_QUERIES

SF = "/root/testdata/sf0.001"
KIND = "side string, labels array<int>, edges array<struct<u: int, v: int, label: int>>"


def moved(graph, rng):
    labels, edges = graph
    to = list(range(len(labels)))
    rng.shuffle(to)
    new = [0] * len(labels)
    for i, k in enumerate(to):
        new[k] = labels[i]
    return new, sorted((min(to[u], to[v]), max(to[u], to[v]), label) for u, v, label in edges)


def brute(a, b):
    if len(a[0]) != len(b[0]):
        return False
    goal = set(map(tuple, b[1]))
    return any([a[0][i] for i in p] == list(b[0]) and {(min(p.index(u), p.index(v)), max(p.index(u), p.index(v)), k) for u, v, k in a[1]} == goal for p in itertools.permutations(range(len(a[0]))))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 5), st.integers(1, 2), st.integers(1, 2))
def test_exact_test_against_all_permutations(seed, n, kinds, bonds):
    rng = random.Random(seed)
    make = lambda: ([rng.randrange(kinds) for _ in range(n)], sorted((u, v, rng.randrange(bonds)) for u, v in itertools.combinations(range(n), 2) if rng.random() < 0.5))
    a, b = make(), make()
    assert canonical.isomorphic(a, b) == brute(a, b)
    c = moved(a, rng)
    assert canonical.isomorphic(a, c) and canonical.invariant(a) == canonical.invariant(c)
    assert brute(a, canonical.form(a)) and (canonical.form(a) != canonical.form(b) or brute(a, b))


def test_equal_colours_are_told_apart(spark):
    """One ring of six and two of three, and two regular graphs of eight nodes, have one hash but are different graphs."""
    rng = random.Random(2)
    zero = lambda n, edges: ([0] * n, [(u, v, 0) for u, v in edges])
    cube = zero(8, [(a, b) for a, b in itertools.combinations(range(8), 2) if (a ^ b) in (1, 2, 4)])
    wagner = zero(8, [(min(k, (k + d) % 8), max(k, (k + d) % 8)) for k in range(8) for d in (1, 4) if d == 1 or k < 4])
    kinds = [zero(*PLAIN["six ring"]), zero(*PLAIN["two rings"]), cube, wagner]
    assert canonical.invariant(kinds[0]) == canonical.invariant(kinds[1]) and canonical.invariant(kinds[2]) == canonical.invariant(kinds[3])
    rows = [(side, *moved(g, rng)) for k, g in enumerate(kinds) for side, n in (("gen", 5 + k), ("ref", 3 * (k % 2))) for _ in range(n)]
    out = isomorphism.isomorphism_classes(spark.createDataFrame(rows, KIND).repartition(7)).collect()
    assert sorted((r.gen, r.ref) for r in out) == [(5, 0), (6, 3), (7, 0), (8, 3)]
    (one,) = isomorphism.uniqueness_novelty(spark.createDataFrame(rows, KIND)).collect()
    assert (one.graphs, one.classes, one.uniqueness, one.novelty) == (26, 4, 4 / 26, 0.5)


def test_rings_are_all_unique_and_nothing_is_nothing(spark):
    ring = lambda n: [(min(k, (k + 1) % n), max(k, (k + 1) % n), 0) for k in range(n)]
    rows = [("gen", [0] * n, ring(n)) for n in (15, 20, 25)] + [("gen", [], []), ("ref", [], [])]
    (one,) = isomorphism.uniqueness_novelty(spark.createDataFrame(rows, KIND)).collect()
    assert (one.graphs, one.uniqueness, one.novelty) == (3, 1.0, 1.0)
    (none,) = isomorphism.uniqueness_novelty(spark.createDataFrame([], KIND)).collect()
    assert (none.graphs, none.classes, none.uniqueness, none.novelty) == (0, 0, 0.0, 0.0)


def test_queries(spark):
    for name in ("iso_classes", "iso_uniqueness_novelty"):
        compare(BASKET_QUERIES[name](spark, SF), BASKET_ORACLES[name], SF)
