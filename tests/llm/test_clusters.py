import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from graphloom.llm import clusters
from graphloom.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"


def lloyd(ids, x, k, rounds):
    """Every vector against every centroid, in whole numbers of any size."""
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), tuple(v)) for i, v in zip(ids, x, strict=True) if i is not None)
    centres = [list(v) for _, v in order[:k]]
    for t in range(rounds + 1):
        gaps = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for v in x]
        part = [min(range(len(centres)), key=lambda c: (g[c], c)) for g in gaps]
        if t < rounds:
            for c in range(len(centres)):
                held = [v for v, p in zip(x, part, strict=True) if p == c]
                if held:
                    centres[c] = [sum(col) // len(held) for col in zip(*held, strict=True)]
    return part, [g[p] for g, p in zip(gaps, part, strict=True)], centres


def test_against_duckdb(spark):
    compare(llm_queries()["op11_ball_kmeans"](spark, SF), llm_oracles()["op11_ball_kmeans"], SF)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 6), st.sampled_from([3, 1 << 24]))
def test_annuli_miss_nothing(seed, n, k, size):
    """Ties and coinciding centres, small and large components: the neighbours of an annulus hold every nearest centre."""
    rng = np.random.default_rng(seed)
    x, centres = rng.integers(-size, size + 1, (n, 2)), rng.integers(-size, size + 1, (k, 2))
    part = rng.integers(0, k, n)
    own = clusters.own_distance(x, centres, part)
    radii = np.array([own[part == c].max(initial=-1) for c in range(k)])
    best, dist, looked = clusters.reassign(x, part, centres, clusters.neighbours(centres, radii))
    every = np.array([[int(((a - c) ** 2).sum()) for c in centres] for a in x])
    assert best.tolist() == every.argmin(axis=1).tolist() and dist.tolist() == every.min(axis=1).tolist()
    assert (clusters.squared(x, centres) == every).all() and looked <= n * k


def test_far_balls_are_not_compared():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (16, 64))
    part = np.arange(1600) % 16
    x = centres[part] + rng.integers(-50, 50, (1600, 64))
    own = clusters.own_distance(x, centres, part)
    near = clusters.neighbours(centres, np.array([own[part == c].max() for c in range(16)]))
    assert clusters.reassign(x, part, centres, near)[2] == 1600


def test_odd_rows_and_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 0.1, 64)], "x", 0) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, 1), (7000, [0.0] * 64, "x", 2)]
    dropped = [(100, None, "x", 0), (101, [0.1] * 63, "x", 0), (102, [0.1] * 63 + [None], "x", 0), (103, [0.1] * 63 + [float("nan")], "x", 0), (104, [0.1] * 63 + [float("-inf")], "x", 0), (105, [], "x", 0)]
    df = spark.createDataFrame(rows + dropped, "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    got = sorted(map(tuple, clusters.cluster_vectors(df, clusters=7).collect()), key=str)
    x = [[int(np.floor(64 * float(np.float32(v)))) for v in r[1]] for r in rows]
    part, dist, centres = lloyd([r[0] for r in rows], x, 7, 3)
    total = {c: sum(d for d, p in zip(dist, part, strict=True) if p == c) for c in part}
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    assert got == sorted(((r[0], p, d, total[p], sum(dist), sha(p)) for r, p, d in zip(rows, part, dist, strict=True)), key=str)


def test_few_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert clusters.cluster_vectors(spark.createDataFrame([], kind)).collect() == []
    one = clusters.cluster_vectors(spark.createDataFrame([(3, [0.5] * 64), (4, [0.25] * 64)], kind)).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in one) == [(3, 0, 0), (4, 0, 0)]
    assert [(r.vec_id, r.cluster) for r in clusters.cluster_vectors(spark.createDataFrame([(None, [0.5] * 64)], kind)).collect()] == [(None, 0)]
    with pytest.raises(Exception, match="out of range in vec_id 9"):
        clusters.cluster_vectors(spark.createDataFrame([(9, [1e30] * 64)], kind)).collect()
