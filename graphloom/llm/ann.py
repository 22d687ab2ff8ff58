"""Nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square stopping test."""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import partitions, small_batches, staged

DIMS = 16
SHARD, BLOCK, LEAF = 8192, 2048, 1024
#: Points that are verified between two looks at the stopping test.
STEP = 512
#: Parts into which the shards' answers to one query are dealt before they are merged.
MERGE = 64


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """x with P(chi-square of an even number of dims <= x) = p."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        x = (lo + hi) / 2
        cdf = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        lo, hi = (x, hi) if cdf < p else (lo, x)
    return lo


class Tree:
    """A kd-tree: halves at the median of the widest side until LEAF points are left. Node 0 is the root; low and high are boxes."""

    def __init__(self, points: np.ndarray):
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray | None] = []
        low, high, open_ = [], [], [(np.arange(len(points)), None)]
        while open_:
            at, above = open_.pop()
            me = len(low)
            low.append(points[at].min(axis=0))
            high.append(points[at].max(axis=0))
            if above is not None:
                first = self.children[above]
                self.children[above] = (me, me) if first is None else (first[0], me)
            self.children.append(None)
            self.members.append(at if len(at) <= LEAF else None)
            if len(at) > LEAF:
                half = len(at) // 2
                order = at[np.argpartition(points[at, (high[-1] - low[-1]).argmax()], half)]
                open_ += [(order[:half], me), (order[half:], me)]
        self.low, self.high = np.stack(low), np.stack(high)

    def nearest(self, points: np.ndarray, at: np.ndarray):
        """Points of the tree and their squared distances, nearest first, in runs of up to STEP: nodes are opened as they come up, and a
        point comes when no box that isn't opened can hold a nearer one."""
        held, gaps = np.zeros(0, np.int64), np.zeros(0)
        for bound, new in self._leaves(at):
            ready = gaps <= bound
            if ready.any():
                yield from _runs(held[ready], gaps[ready])
                held, gaps = held[~ready], gaps[~ready]
            held, gaps = np.concatenate([held, new]), np.concatenate([gaps, ((points[new] - at) ** 2).sum(axis=1)])
        yield from _runs(held, gaps)

    def _leaves(self, at: np.ndarray):
        """Leaves with the squared distance of their boxes, nearest first."""
        heap = [(0.0, 0)]
        while heap:
            gap, node = heappop(heap)
            if self.members[node] is not None:
                yield gap, self.members[node]
                continue
            two = list(self.children[node])
            far = (np.maximum(0, np.maximum(self.low[two] - at, at - self.high[two])) ** 2).sum(axis=1)
            heappush(heap, (float(far[0]), two[0]))
            heappush(heap, (float(far[1]), two[1]))


def _runs(held: np.ndarray, gaps: np.ndarray):
    order = np.argsort(gaps)
    for lo in range(0, len(order), STEP):
        part = order[lo : lo + STEP]
        yield held[part], gaps[part]


def search(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int, p: float, looked: list[int] | None = None):
    """(place of the query, neighbour, score) of each query's k best of a shard, one row of its id and vector left out as its own.

    With one more component sqrt(top**2 - norm**2), top being the shard's largest norm, the largest inner product is the nearest
    neighbour; scales of points and queries don't change the order and are taken out first, so no norm overflows. Equal vectors are
    one point; of its rows, the k + 1 of least id are all that k neighbours can need.

    Projected distances are squared distances times a chi-square of DIMS degrees. Points come in the order of their projection and
    are verified; with d the distance of the (k + 1)-th best so far, the query itself one of them, a point that is nearer has a
    projection under the p-quantile times d with probability p, so the search ends at the first projection beyond it. looked:
    gets the number of points verified, query by query.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    points, inverse = np.unique(vectors + 0.0, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    members: list[list[int]] = [[] for _ in points]
    where = {v.tobytes(): c for c, v in enumerate(points)}
    for i, c in zip(ids.tolist(), inverse.tolist(), strict=True):
        members[c].append(i)
    unit = points / np.abs(points).max()
    norms = (unit**2).sum(axis=1)
    top = float(norms.max())
    plane = np.random.default_rng(11).standard_normal((points.shape[1] + 1, DIMS))
    low = unit @ plane[:-1] + np.sqrt(top - norms)[:, None] * plane[-1]
    tree, lean = Tree(low), unit.astype(np.float32)  # five more than k are kept, and told apart in double precision at the end
    bar = chi_square_quantile(p)
    for place, (qid, q) in enumerate(zip(q_ids.tolist(), queries, strict=True)):
        own = where.get((q + 0.0).tobytes(), -1)
        q_unit = q / np.abs(q).max()
        base = top + q_unit @ q_unit
        got, scores = np.zeros(0, np.int64), np.zeros(0)
        seen, lean_q = 0, q_unit.astype(np.float32)
        for new, gaps in tree.nearest(low, q_unit @ plane[:-1]):
            if len(scores) > k and gaps[0] >= bar * max(0.0, base - 2 * scores[k]):
                break
            seen += len(new)
            got, scores = np.concatenate([got, new]), np.concatenate([scores, (lean[new] @ lean_q).astype(float)])
            best = np.argpartition(-scores, k + 5)[: k + 6] if len(scores) > k + 6 else np.arange(len(scores))
            best = best[np.argsort(-scores[best])]
            got, scores = got[best], scores[best]
        if looked is not None:
            looked.append(seen)
        rows = []
        for s, c in zip((points[got] * q).sum(axis=1).tolist(), got.tolist(), strict=True):
            held = members[c][: k + 1]
            if c == own and qid in members[c]:
                held = members[c].copy()
                held.remove(qid)
            rows += [(-s, i) for i in held[:k]]
        for s, i in sorted(rows)[:k]:
            yield place, i, -s


def _tiles(k, p):
    def run(batches):
        key, index, queries = None, ([], []), ([], [], [])

        def flush():
            if index[0] and queries[0]:
                rows = list(search(np.array(index[0]), np.array(index[1]), np.array(queries[0]), np.array(queries[1]), k, p))
                if rows:
                    asked = [queries[2][r[0]] for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64())))], names=["q", "vec_id", "score"])

        for batch in batches:
            tiles, lengths, q, ids = (batch.column(i).to_pylist() for i in range(4))
            flat, at = batch.column(4).flatten().to_numpy(zero_copy_only=False), 0
            for tile, n, ask, i in zip(tiles, lengths, q, ids, strict=True):
                if (tile, n) != key:
                    yield from flush()
                    key, index, queries = (tile, n), ([], []), ([], [], [])
                v = flat[at : at + n]
                at += n
                if ask is None:
                    index[0].append(i)
                    index[1].append(v)
                else:
                    queries[0].append(i)
                    queries[1].append(v)
                    queries[2].append(ask)
        yield from flush()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, p: float = 0.93) -> DataFrame:
    """vectors, queries: vec_id, embedding. Each query's k rows of largest inner product that the search finds, its own left out:
    query_id, rank, vec_id, score, nearest first, ties to the smaller vec_id; all rows, if there are fewer than k.

    Index and queries meet in tiles of bounded size, dealt by a hash of vec_id, so equal vectors don't gather anywhere. In a tile
    the projected neighbours come from a kd-tree one after another, nearest first, and are verified on the original vectors until the chi-square
    test says that, with probability p, none farther in the projection is nearer in truth. Vectors of one length are searched among
    themselves, as no others have an inner product. Of rows that repeat a query's id, one with its vector is its own and the others
    are candidates; queries that repeat an id each have their list. Vectors that are null, zero, hold null or non-finite components
    or have no vec_id take no part; other columns, whatever their names, play no part; no rows give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def fit(df):
        v = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        return v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))

    index, asked = fit(vectors), staged(fit(queries).withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks, shards = max(1, math.ceil(asked.count() / BLOCK)), max(1, math.ceil(index.count() / SHARD))
    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count))
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = index.select(every(blocks, "b"), part(shards).alias("s"), F.lit(None).cast("long").alias("q"), "vec_id", "v")
    right = asked.select(part(blocks).alias("b"), every(shards, "s"), "q", "vec_id", "v")
    rows = left.unionByName(right).select((F.col("s") * blocks + F.col("b")).alias("tile"), F.size("v").alias("length"), "q", "vec_id", "v")
    rows = rows.repartition(partitions(spark), "tile").sortWithinPartitions("tile", "length")
    found = rows.mapInArrow(_tiles(k, p), "q long, vec_id long, score double")
    ranked = lambda x: F.slice(F.array_sort(x), 1, k)
    some = found.groupBy("q", F.pmod(F.xxhash64("vec_id"), F.lit(MERGE)).alias("part")).agg(ranked(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    best = some.groupBy("q").agg(ranked(F.flatten(F.collect_list("best"))).alias("best"))
    best = best.join(asked.select("q", F.col("vec_id").alias("query_id")), "q")
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
