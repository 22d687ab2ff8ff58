"""Sums of a kernel over all pairs of rows, without a row for a pair: different vectors meet, with how often they occur, in tiles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different vectors that a tile holds about, at least and at most; two tiles meet in one task at a time.
TILE, MOST = 1024, 16384
#: Pairs of tiles that a core gets about, twice over.
PAIRS = 32
#: Numbers that one step of a kernel holds.
_STEP = 1 << 22
#: Kernel values that one step of a pair of tiles holds about.
_ROWS = 1 << 18


def _gaussian(x: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
    gaps = x @ y.T
    gaps *= -2
    gaps += (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    np.maximum(gaps, 0, out=gaps)
    gaps /= -2 * sigma**2
    return np.exp(gaps, out=gaps)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of absolute differences."""
    out = np.empty((len(x), len(y)))
    rows = max(1, _STEP // max(1, y.size))
    for at in range(0, len(x), rows):
        out[at : at + rows] = np.abs(x[at : at + rows, None, :] - y[None, :, :]).sum(axis=2)
    return out


def _tv(x: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-((_distance(x, y) / 2) ** 2) / (2 * sigma**2))


def _emd(x: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-(_distance(np.cumsum(x, axis=1)[:, :-1], np.cumsum(y, axis=1)[:, :-1]) ** 2) / (2 * sigma**2))


def _tanimoto(x: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
    both, either = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for a, b in zip(x.astype(np.int64).T.view(np.uint64), y.astype(np.int64).T.view(np.uint64), strict=True):
        both += np.bitwise_count(a[:, None] & b[None, :])
        either += np.bitwise_count(a[:, None] | b[None, :])
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


KERNELS = {"gaussian": _gaussian, "tv": _tv, "emd": _emd, "tanimoto": _tanimoto}


def kernel_sums(vectors: DataFrame, kernel: str, sigma: float = 1.0, tile: int = TILE, weight: str | None = None) -> DataFrame:
    """vectors: side, v (array of one length; words of bits for tanimoto), and, where a row stands for several, a column `weight`. (a, b, total, pairs): for two sides the kernel's sum over all
    ordered pairs of a row of a and a row of b, and their number.

    Equal vectors are counted first. Different ones are dealt to tiles by hash, every vector goes to the pairs of its tile with all
    tiles, and a pair of tiles adds two rows a pair of sides. There are about as many tiles as keep all cores busy, of `tile` to MOST
    vectors: n vectors make n times that few rows, and from there on n * n / MOST."""
    weighted = vectors.groupBy("side", "v").agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("c"))
    known = weighted.groupBy("v").agg(F.collect_list(F.struct("side", "c")).alias("held"))
    n = weighted.select("v").distinct().count()
    busy = math.isqrt(PAIRS * vectors.sparkSession.sparkContext.defaultParallelism) + 1
    tiles = max(1, min(-(-n // tile), max(busy, -(-n // max(tile, MOST)))))
    fn, kind = KERNELS[kernel], np.int64 if kernel == "tanimoto" else float
    at = F.pmod(F.xxhash64("v"), F.lit(tiles)).cast("int")
    dealt = known.withColumn("tile", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).select("lo", "hi", "tile", "v", "held")
    dealt = dealt.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "tile")

    def sums(lo, hi, pieces):
        met = pa.Table.from_batches(pieces).combine_chunks()
        v, held = (met.column(c).combine_chunks() for c in ("v", "held"))
        if v.null_count or len(np.unique(np.diff(v.offsets.to_numpy()))) > 1:
            raise ValueError("vectors differ in length")
        x = v.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(v), -1)
        row, told = np.repeat(np.arange(len(v)), np.diff(held.offsets.to_numpy())), held.flatten()
        named, c = np.array(told.field("side").to_pylist(), dtype=object), told.field("c").to_numpy()
        sides = sorted(set(named))
        weight = {s: np.bincount(row[named == s], c[named == s], len(v)) for s in sides}
        tile_of = met.column("tile").to_numpy()
        left, right = np.flatnonzero(tile_of == lo), np.flatnonzero(tile_of == hi)
        y, of_left, of_right = x[right], np.stack([weight[s][left] for s in sides]), np.stack([weight[s][right] for s in sides])
        total, step = np.zeros((len(sides), len(sides))), max(64, _ROWS // max(1, len(right)))
        for begin in range(0, len(left) if len(right) else 0, step):
            total += of_left[:, begin : begin + step] @ (fn(x[left[begin : begin + step]], y, sigma) @ of_right.T)
        out = []
        for i, a in enumerate(sides):
            for j, b in enumerate(sides):
                pairs = float(of_left[i].sum() * of_right[j].sum())
                out.append((a, b, float(total[i, j]), pairs))
                if lo != hi:  # the tiles the other way round
                    out.append((b, a, float(total[i, j]), pairs))
        return out

    def run(batches):
        now, pieces = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, hi = (batch.column(c).to_numpy() for c in ("lo", "hi"))
            cuts = [0, *(np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if (lo[begin], hi[begin]) != now:
                    if now is not None:
                        yield table(sums(*now, pieces))
                    now, pieces = (lo[begin], hi[begin]), []
                pieces.append(batch.slice(begin, end - begin))
        if now is not None:
            yield table(sums(*now, pieces))

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["a", "b", "total", "pairs"])

    parts = dealt.mapInArrow(run, "a string, b string, total double, pairs double")
    return parts.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def nearest(vectors: DataFrame, reference: DataFrame, kernel: str = "tanimoto", sigma: float = 1.0, tile: int = TILE) -> DataFrame:
    """vectors: v, reference: v. (v, n, best): every different vector, how many rows have it, and its largest kernel value to the
    reference. Tiles of both sides meet in pairs, and a pair gives one number a vector. No rows without a reference."""
    own, other = vectors.groupBy("v").agg(F.count("*").alias("n")), reference.select("v").distinct()
    left, right = (max(1, -(-x.count() // tile)) for x in (own, other))
    fn, kind = KERNELS[kernel], np.int64 if kernel == "tanimoto" else float
    place = lambda count: F.pmod(F.xxhash64("v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = own.select(place(left).alias("lo"), every(right).alias("hi"), F.lit(0).alias("side"), "v", "n")
    b = other.select(every(left).alias("lo"), place(right).alias("hi"), F.lit(1).alias("side"), "v", F.lit(0).cast("long").alias("n"))
    dealt = a.unionByName(b).repartition("lo", "hi").sortWithinPartitions("lo", "hi", "side")

    def best(held):
        (x, n), (y, _) = held
        if x and y:
            top = fn(np.array(x, dtype=kind), np.array(y, dtype=kind), sigma).max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64() if kind is np.int64 else pa.float64())), pa.array(n, pa.int64()), pa.array(top)], names=["v", "n", "best"])

    def run(batches):
        now, held = None, (([], []), ([], []))
        for batch in batches:
            for lo, hi, side, v, n in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "side", "v", "n")), strict=True):
                if (lo, hi) != now:
                    yield from best(held)
                    now, held = (lo, hi), (([], []), ([], []))
                held[side][0].append(v)
                held[side][1].append(n)
        yield from best(held)

    word = "long" if kind is np.int64 else "double"
    return dealt.mapInArrow(run, f"v array<{word}>, n long, best double").groupBy("v").agg(F.max("n").alias("n"), F.max("best").alias("best"))


def normalised(hist: Column) -> Column:
    """A histogram as shares of its sum and 1e-6. The sum is an array's only element, so that it isn't worked out for every place."""
    total = F.aggregate(hist, F.lit(0.0), lambda s, x: s + x) + F.lit(1e-6)
    return F.get(F.transform(F.array(total), lambda t: F.transform(hist, lambda x: x / t)), F.lit(0))


def mmd(vectors: DataFrame, kernel: str = "gaussian", sigma: float = 1.0, is_hist: bool = False, sides: tuple[str, str] = ("gen", "ref"), empty: float = 1e6, weight: str | None = None) -> DataFrame:
    """mmd2: squared maximum mean discrepancy of two sides of vectors (side, v), all pairs of a row with itself included. A mean over
    no pairs counts as `empty`. Equal histograms are counted before they become shares."""
    held = vectors
    if is_hist:
        counted = vectors.groupBy("side", "v").agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("_rows"))
        held, weight = counted.withColumn("v", normalised(F.col("v"))), "_rows"
    means = kernel_sums(held, kernel, sigma, weight=weight).select("a", "b", (F.col("total") / F.col("pairs")).alias("k"))
    of = lambda a, b: F.coalesce(F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("k"))), F.lit(empty))
    g, r = sides
    return means.agg((of(g, g) + of(r, r) - 2 * of(g, r)).alias("mmd2"))


def internal_diversity(prints: DataFrame) -> DataFrame:
    """prints: words. (rows, diversity): one less the mean similarity of two different rows; 0 for fewer than two rows. The sum over
    pairs is half of that over all ordered pairs less the rows with themselves: 1 for a row with any bit, else 0."""
    x = prints.select(F.lit("all").alias("side"), F.col("words").alias("v"))
    own = prints.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.exists("words", lambda w: w != 0), 1.0).otherwise(0.0)), F.lit(0.0)).alias("own"))
    total = kernel_sums(x, "tanimoto").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    n = F.col("rows")
    return own.crossJoin(total).select("rows", F.when(n > 1, 1 - (F.col("total") - F.col("own")) / (n * (n - 1))).otherwise(0.0).alias("diversity"))


# ---------------------------------------------------------------- moments


def _outer(dims: int, block: int):
    """Sums of a task: a row a pair of blocks of dimensions with the products of deviations from `mean`."""
    starts = range(0, dims, block)

    def run(batches):
        sums = {(i, j): np.zeros((min(block, dims - i), min(block, dims - j))) for i in starts for j in starts if i <= j}
        rows, first = 0, np.zeros(dims)
        for batch in batches:
            if batch.num_rows:
                x = batch["d"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                rows += len(x)
                first += x.sum(axis=0)
                for (i, j), s in sums.items():
                    s += x[:, i : i + block].T @ x[:, j : j + block]
        if rows:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([rows] * len(keys), pa.int64()), pa.array([sums[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["i", "j", "n", "s"])

    return run


def _added(batches):
    """One row a pair of blocks: rows that come sorted by (i, j) are added up."""
    now, n, s = None, 0, None
    for batch in batches:
        for i, j, m, more in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["n"].to_pylist(), batch["s"], strict=True):
            x = more.values.to_numpy(zero_copy_only=False)
            if (i, j) != now:
                if now is not None:
                    yield _row(now, n, s)
                now, n, s = (i, j), 0, np.zeros(len(x))
            n, s = n + m, s + x
    if now is not None:
        yield _row(now, n, s)


def _row(key, n, s):
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([s], pa.list_(pa.float64()))], names=["i", "j", "n", "s"])


_SUMS = "i int, j int, n long, s array<double>"


def moments(vectors: DataFrame, column: str = "v", block: int = 64) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, covariance with rows - 1) of vectors of one length; null vectors play no part.

    A first pass takes the means, a second the products of deviations: a task adds up its rows in blocks of dimensions and gives one
    row a pair of blocks, and those are added by pair. The driver holds dims x dims numbers."""
    held = vectors.select(F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    means = held.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.count("*").alias("n")).orderBy("at").collect()
    if not means:
        return 0, np.zeros(0), np.zeros((0, 0))
    dims, rows, mean = len(means), means[0]["n"], np.array([r["m"] for r in means])
    if any(r["n"] != rows for r in means):
        raise ValueError("vectors differ in length")
    shift = F.array(*[F.lit(float(m)) for m in mean])
    away = held.select(F.zip_with("v", shift, lambda a, b: a - b).alias("d"))
    parts = away.mapInArrow(_outer(dims, block), _SUMS).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_added, _SUMS)
    cov = np.zeros((dims, dims))
    for r in parts.collect():
        x = np.array(r["s"]).reshape(min(block, dims - r["i"]), -1)
        cov[r["i"] : r["i"] + block, r["j"] : r["j"] + block] = x
        cov[r["j"] : r["j"] + block, r["i"] : r["i"] + block] = x.T
    return rows, mean, cov / max(rows - 1, 1)


def frechet_distance(a: DataFrame, b: DataFrame, column: str = "v") -> float:
    """Squared distance of the means, plus the trace of both covariances less twice that of the root of their product. The root's
    trace is the sum of the roots of the eigenvalues of R B R, where R is the root of A, so nothing has to be inverted. NaN where a
    side has fewer than two rows."""
    (n, m, x), (k, q, y) = moments(a, column), moments(b, column)
    if n < 2 or k < 2:
        return float("nan")
    values, vectors = np.linalg.eigh(x)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    both = np.linalg.eigvalsh(root @ y @ root)
    return float(((m - q) ** 2).sum() + np.trace(x) + np.trace(y) - 2 * np.sqrt(np.maximum(both, 0)).sum())
