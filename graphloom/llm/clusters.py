"""Ball k-means over integer vectors: clusters are balls, and only what reaches a neighbour's half is compared again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import WRITTEN, drop_staged, staged

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components up to this size have squared distances that fit 64 bits in DIMS dimensions; larger ones raise an error.
LARGEST = 1 << 25
#: Up to this size every product and sum is a whole number that doubles hold, so the matrix product of doubles is exact.
_EXACT = 1 << 22


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors with `dims` components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    whole = F.size(x) == dims
    finite = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    scaled = F.transform(x, lambda e: F.when(F.abs(e * scale) <= LARGEST, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.concat(F.lit("component out of range in vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))).cast("int")))
    return vectors.where(whole & finite).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _exact(*arrays: np.ndarray) -> bool:
    return all(a.size == 0 or np.abs(a).max() <= _EXACT for a in arrays)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centre, as whole numbers."""
    if _exact(x, centres):
        a, b = x.astype(float), centres.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def own_distance(x: np.ndarray, centres: np.ndarray, part: np.ndarray) -> np.ndarray:
    return ((x - centres[part]) ** 2).sum(axis=1)


def neighbours(centres: np.ndarray, radii: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every ball, the centres that can be as near to a member as its own, nearest first, and their squared distances.

    A member at distance d from its centre has another centre as near only if the two centres are at most 2 d apart, so centres
    beyond twice the radius are no neighbours. radii: squared, -1 for a ball without members.
    """
    gaps = squared(centres, centres)
    out = []
    for i, radius in enumerate(radii):
        near = np.flatnonzero((gaps[i] <= 4 * int(radius)) & (np.arange(len(centres)) != i))
        near = near[np.argsort(gaps[i][near], kind="stable")]
        out.append((near, gaps[i][near]))
    return out


def reassign(x: np.ndarray, part: np.ndarray, centres: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed): the nearest centre of every row, ties to the smaller number.

    A ball's stable core lies nearer to its centre than half the way to the nearest neighbour and stays. Each annulus beyond it
    is bounded by half the way to the next neighbour; its rows meet the neighbours inside that bound and no others.
    """
    own = own_distance(x, centres, part)
    best, dist, looked = part.copy(), own.copy(), len(x)
    for i in np.unique(part):
        others, gaps = near[i]
        if not len(others):
            continue
        rows = np.flatnonzero(part == i)
        reach = np.searchsorted(gaps, 4 * own[rows], side="right")  # the annulus: how many neighbours a row can meet
        for k, j in enumerate(others):
            rows, reach = rows[reach > k], reach[reach > k]
            if not len(rows):
                break
            d = ((x[rows] - centres[j]) ** 2).sum(axis=1)
            looked += len(rows)
            better = (d < dist[rows]) | ((d == dist[rows]) & (j < best[rows]))
            best[rows[better]], dist[rows[better]] = j, d[better]
    return best, dist, looked


def _batches(run: Callable, dims: int) -> Callable:
    def over(batches):
        for b in batches:
            if b.num_rows:
                yield from run(b, _rows(b["v"], dims))

    return over


def _seeds(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose hash of `1:<vec_id>` is smallest, in that order; a null vec_id has none."""
    first = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def _move(assigned: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise exact floor(sum / count) of every non-empty cluster. One row a cluster reaches the driver."""
    dims = centres.shape[1]
    out = centres.copy()
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def _radii(assigned: DataFrame, centres: np.ndarray) -> np.ndarray:
    def run(batch, x):
        part = batch["cluster"].to_numpy()
        own = own_distance(x, centres, part)
        kinds = np.unique(part)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(kinds, pa.int32()), "far": pa.array([own[part == c].max() for c in kinds], pa.int64())})

    out = np.full(len(centres), -1, dtype=np.int64)
    for r in assigned.mapInArrow(_batches(run, centres.shape[1]), "cluster int, far long").groupBy("cluster").agg(F.max("far").alias("far")).collect():
        out[r["cluster"]] = r["far"]
    return out


def ball_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """vectors: vec_id, v (array of `dims` ints). ((vec_id, v, cluster, distance), centroids), as k-means after `rounds` moves.

    The first assignment compares every row with every centre. Each later one knows the rows' clusters: a pass takes every ball's
    radius, radii give neighbours, and rows meet the neighbours of their annulus (`reassign`). All is exact in whole numbers.
    Between rounds rows are staged with their cluster and never shuffled; shuffled are one partial sum and one radius a task and
    cluster. The driver holds clusters x dims numbers, and gaps of clusters x clusters. Fewer vectors than clusters: as many
    clusters as vectors. Centroids that coincide are neighbours at gap 0, and the smaller number wins.
    """
    spark = vectors.sparkSession
    centres = _seeds(vectors, clusters)
    if not len(centres):  # no vector has an id to start from: all are one cluster around the first, if there are any
        first = vectors.orderBy("v").limit(1).collect()
        if not first:
            return vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), dtype=np.int64)
        centres = np.array([first[0]["v"]], dtype=np.int64)
    schema = "vec_id long, v array<int>, cluster int, distance long"

    def packed(batch, part, dist):
        return pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(part.astype(np.int32)), pa.array(dist)], ["vec_id", "v", "cluster", "distance"])

    def first_run(batch, x, centres=centres):
        gaps = squared(x, centres)
        part = gaps.argmin(axis=1)
        yield packed(batch, part, gaps[np.arange(len(x)), part])

    assigned = staged(vectors.mapInArrow(_batches(first_run, dims), schema), "balls")
    for _ in range(rounds):
        before = WRITTEN[-1]
        centres = _move(assigned, centres)
        near = neighbours(centres, _radii(assigned, centres))

        def run(batch, x, centres=centres, near=near):
            part, dist, _ = reassign(x, batch["cluster"].to_numpy().astype(np.int64), centres, near)
            yield packed(batch, part, dist)

        assigned = staged(assigned.mapInArrow(_batches(run, dims), schema), "balls")
        drop_staged(spark, [before])
    return assigned, centres


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, embedding. One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dims` components, none null or non-finite; each component is floor(scale * x). Vectors out of range raise
    an error that names one (LARGEST). Repeated rows are rows like others, also among the seeds, by their hash and then their
    components; a null vec_id is clustered but no seed; a table that keeps nothing gives no rows; other columns, whatever their
    names, play no part.
    """
    assigned, centres = ball_kmeans(integer_vectors(vectors.select("vec_id", "embedding"), dims, scale), clusters, rounds, dims)
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    told = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    info = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same by comparing every vector with every centroid in every round."""
    gap = "list_sum(list_transform(range(1, {0} + 1), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT".format(dims)
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {clusters}))",
    ]
    for t in range(rounds + 1):
        steps.append(f"g{t} AS MATERIALIZED (SELECT r, min(struct_pack(d := {gap}, c := c.c)) AS best FROM k, c{t} c GROUP BY r)")
        if t < rounds:
            steps.append(f"u{t} AS (SELECT best.c AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM g{t} JOIN k USING (r))")
            steps.append(f"m{t} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM u{t} GROUP BY c, i)) GROUP BY c)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(m{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN m{t} USING (c))")
    return f"""WITH {", ".join(steps)}
      SELECT k.vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM g{rounds} JOIN k USING (r) JOIN c{rounds} f ON f.c = best.c"""
