"""Small graphs for tests: (labels, edges)."""

import itertools
import random


KIND = "graph_id long, ids array<long>, labels array<int>, edges array<struct<u: int, v: int, label: int>>"


def clique(nodes):
    return [(a, b) for a, b in itertools.combinations(nodes, 2)]


PLAIN = {
    "triangle": (3, [(0, 1), (1, 2), (0, 2)]),
    "star": (6, [(0, k) for k in range(1, 6)]),
    "apart": (4, [(0, 1), (2, 3)]),
    "no edges": (5, []),
    "one node": (1, []),
    "nothing": (0, []),
    "two triangles": (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]),
    "six ring": (6, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)]),
    "two rings": (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]),
    "path": (5, [(0, 1), (1, 2), (2, 3), (3, 4)]),
    "four cliques of cliques": (32, [e for k in range(8) for e in clique(range(4 * k, 4 * k + 4))] + [(4 * k + 3, 4 * k + 4) for k in (0, 2, 4, 6)] + [(4 * k + 2, 4 * k + 5) for k in (0, 2, 4, 6)] + [(7, 8), (15, 16), (23, 24)]),
}


def labelled(seed=0):
    """graph_id -> (ids, labels, edges), with node labels 0 to 9, bond labels 0 to 4 and ids that are no places."""
    rng = random.Random(seed)
    out = {}
    for g, (n, edges) in enumerate(PLAIN.values()):
        out[g] = ([100 + 3 * k for k in range(n)], [rng.randrange(10) for _ in range(n)], [(u, v, rng.randrange(5)) for u, v in sorted(edges)])
    for g in range(len(out), len(out) + 6):
        n = rng.randrange(8, 25)
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(n, 3 * n))})
        out[g] = (list(range(n)), [rng.randrange(10) for _ in range(n)], [(u, v, rng.randrange(5)) for u, v in edges])
    return out


def frame(spark, graphs):
    return spark.createDataFrame([(g, ids, labels, edges) for g, (ids, labels, edges) in graphs.items()], KIND)
