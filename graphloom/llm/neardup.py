"""Near-duplicates by HyperMinHash: compressed registers, banding, estimates, then exact sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import mix, partitions, shingle_hashes, signed, small_batches, staged, steps

BUCKETS, MANTISSA, BAND = 128, 10, 4
#: Members of one star that are verified against one copy of its centre.
STAR = 256
#: Members and shingles of a cluster's block, on average; two blocks make a tile.
TILE, TILE_SHINGLES = 1024, 2_000_000
#: Shingles of both sets from which registers decide whether a pair of a tile is looked at; smaller sets are always compared.
SURE = 1024
_REST = np.uint64(53)
_PROBE = np.stack([np.random.default_rng(j).permutation(BUCKETS) for j in range(BUCKETS)])
SIGNED = "doc_id long, text_hash long, set1 long, set2 long, n long, sig binary"


def alone(percent: int) -> int:
    """Sets up to this size can be linked only to equal sets: n / (n + 1) stays under the threshold; 5 at 85, 3 at 80."""
    return -(-percent // (100 - percent)) - 1 if percent < 100 else 1 << 62


def registers(x: np.ndarray) -> np.ndarray:
    """x: sorted distinct shingle hashes. A register per bucket: leading zeros and leading mantissa bits of its least hash.

    An empty bucket takes the register of the first filled one in an order of its own.
    """
    at = np.searchsorted(x, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57))
    full = np.append(at[1:], len(x)) > at
    least = (x[np.minimum(at, len(x) - 1)] << np.uint64(7)) >> np.uint64(11)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    zeros = _REST - bits
    low = ((least << (zeros + np.uint64(11) + np.uint64(1))) >> np.uint64(64 - MANTISSA)) * (bits > 0)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | low.astype(np.uint16)
    if not full.all():
        gap = np.flatnonzero(~full)
        order = _PROBE[gap]
        out[gap] = out[order[np.arange(len(gap)), full[order].argmax(axis=1)]]
    return out


def estimate(same: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the share that unequal ones collide by chance.

    Two unequal minima share the zeros with probability 1/3 and then the mantissa with about 1.5 * 2**-MANTISSA.
    """
    chance = 0.5 * 2.0**-MANTISSA
    return (same - chance) / (1 - chance)


def _sets(text: pa.Array, k: int):
    for _, _, data, offsets in steps(text):
        hashes, bounds = shingle_hashes(data, offsets, k)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(hashes[a:b])


def _sign(k):
    def run(batches):
        for batch in batches:
            one, two, n, sig = [], [], [], []
            for x in _sets(batch.column("text"), k):
                n.append(len(x))
                one.append(int(signed(x).sum()) if len(x) else 0)
                two.append(int(np.bitwise_xor.reduce(signed(mix(x)))) if len(x) else 0)
                sig.append(registers(x).tobytes() if len(x) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "set1", "set2", "n", "sig"])

    return run


def _verify(k, percent):
    def run(batches):
        centre, key = None, None
        for batch in batches:
            got = ([], [])
            for lead, part, rep, x in zip(batch.column("lead").to_pylist(), batch.column("part").to_pylist(), batch.column("rep").to_pylist(), _sets(batch.column("text"), k), strict=True):
                if (lead, part) != key:
                    key, centre = (lead, part), None
                if lead == rep:
                    centre = x
                elif centre is not None:
                    both = len(np.intersect1d(centre, x, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(x) - both):
                        got[0].append(lead)
                        got[1].append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64())], names=["lead", "rep"])

    return run


def verify(stars: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (lead, rep) of stars whose full shingle sets are similar enough. A large star is cut into parts, each with its centre."""
    spark = stars.sparkSession
    size = stars.groupBy("lead").agg(F.ceil(F.count("rep") / STAR).cast("int").alias("parts"))
    cut = stars.join(size, "lead").select("lead", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    centres = size.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("rep"))
    rows = cut.unionByName(centres).join(texts, "rep").select("lead", "part", "rep", (F.col("lead") != F.col("rep")).alias("later"), "text")
    rows = rows.repartition(partitions(spark), "lead", "part").sortWithinPartitions("lead", "part", "later", "rep")
    return rows.select("lead", "part", "rep", "text").mapInArrow(_verify(k, percent), "lead long, rep long")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root): root is the least node reachable. edges: a, b. Alternating large and small stars, staged each round, until
    every node has one link and no root has any, which is looked up on the whole table."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    while True:
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = staged(small, tag)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as products of their indicator matrices, some shingles at a time."""
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    shared = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    owner, column = owner[shared], np.cumsum(new[shared]) - 1
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    wide = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, (at, at + wide))
        x = np.zeros((len(sets), column[hi - 1] - at + 1), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def tile_links(held: list[tuple], k: int, percent: int, low: float):
    """Links that join different components of a tile, at most one less than its members, each confirmed on the full sets.
    held: (rep, root, n, sig, block, whether the tile is one block, text)."""
    n = np.array([h[2] for h in held])
    block = np.array([h[4] for h in held])
    sig = np.stack([np.frombuffer(h[3], dtype=np.uint16) for h in held])
    label = np.unique([h[1] for h in held], return_inverse=True)[1].ravel()
    across = not held[0][5]
    look = np.zeros((len(held), len(held)), dtype=bool)
    for i in range(len(held) - 1):
        rest = slice(i + 1, None)
        fit = (label[rest] != label[i]) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))
        if across:
            fit &= block[rest] != block[i]
        if n[i] >= SURE:
            fit &= (n[rest] < SURE) | (estimate((sig[rest] == sig[i]).mean(axis=1)) >= low)
        look[i, rest] = fit
    rows = np.flatnonzero(look.any(axis=0) | look.any(axis=1))
    if not len(rows):
        return
    look = look[np.ix_(rows, rows)]
    both = overlaps(list(_sets(pa.array([held[i][6] for i in rows], pa.string()), k)))
    size = n[rows].astype(np.float64)
    look &= 100 * both.astype(np.float64) >= percent * (size[:, None] + size[None, :] - both)
    look |= look.T
    label = label[rows]
    for i in range(len(rows)):
        linked = np.flatnonzero(look[i])
        while len(linked := linked[label[linked] != label[i]]):
            j = linked[0]
            yield held[rows[i]][0], held[rows[j]][0]
            label[label == label[j]] = label[i]


def _tile(k, percent, low):
    """Rows come sorted by tile; each tile's links."""

    def written(rows):
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], names=["lead", "rep"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    if len(held) > 1:
                        yield written(tile_links(held, k, percent, low))
                    key, held = row[0], []
                held.append(row[1:])
        if len(held) > 1:
            yield written(tile_links(held, k, percent, low))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, low: float | None = None) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, n_shingles, component_id, kept.

    Texts of equal shingle sets fall together first; from then on a set is a row with a number of its own. Bands of registers give
    candidates: every member of a bucket against the bucket's least set, so a bucket of any size gives as many candidates as it has
    members. Full shingle sets confirm them. Then sets of buckets that still hold several components meet in tiles, where the sizes
    of all intersections between different components are taken at once, so links between members that both differ from the least
    one aren't lost. Tiles emit only the links that join components, so their output follows the number of members.

    Two sets of a similarity s miss each other in all bands with probability (1 - s**BAND)**(BUCKETS / BAND): 6e-11 at 0.85, 5e-8
    at 0.8. In tiles, pairs of sets of SURE shingles and more are passed over if their collision-corrected estimate is under `low`,
    0.25 below the threshold unless given, which happens to a link with a probability under 1e-9.

    Null and empty texts have no shingles and are linked with nothing; texts of any length are whole; repeated rows are one text; a
    doc_id that stands with several texts is one for each of them; ties go to the least doc_id; a null doc_id keeps a row without
    component; other columns of docs, whatever their names, play no part; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    low = percent / 100 - 0.25 if low is None else low
    lean = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signs = staged(lean.mapInArrow(_sign(k), SIGNED), "signs")
    groups = signs.where("n > 0 AND doc_id IS NOT NULL").groupBy("set1", "set2", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.max("sig").alias("sig"))
    groups = staged(groups.select(F.monotonically_increasing_id().alias("rep"), "set1", "set2", "n", "one.doc_id", "one.text_hash", "sig"), "sets")
    reps = groups.where(f"n > {alone(percent)}").select("rep", "n", "sig")
    width = 2 * BAND
    bands = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // BAND - 1)), lambda j: F.xxhash64(j, F.substring("sig", j * width + 1, F.lit(width))))).alias("band"))
    full = staged(bands.groupBy("band").agg(F.min("rep").alias("lead"), F.count("rep").alias("members")).where("members > 1"), "buckets")
    bands = staged(bands.join(full.select("band", "lead"), "band"), "bands")
    stars = bands.where("lead <> rep").select("lead", "rep").distinct()
    wanted = groups.select("rep", "doc_id", "text_hash").join(bands.select("rep").distinct(), "rep")
    texts = staged(lean.join(wanted, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"]), "texts")
    links = staged(verify(staged(stars, "stars"), texts, k, percent), "links")
    roots = components(links.toDF("a", "b"))
    named = staged(bands.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("root")), "named")
    several = staged(named.groupBy("band").agg(F.min("rep").alias("first"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("band", "first"), "several")
    # sets that such buckets hold together, directly or in a chain, form a cluster; each is in one
    open_ = staged(named.join(several, "band").select("first", "rep", "root"), "open")
    chained = components(open_.select(F.col("first").alias("a"), F.col("rep").alias("b")))
    member = open_.select("rep", "root").distinct().join(chained.select(F.col("node").alias("rep"), F.col("root").alias("chain")), "rep", "left").withColumn("chain", F.coalesce("chain", "rep"))
    member = staged(member.join(reps, "rep"), "members")
    size = staged(member.groupBy("chain").agg(F.ceil(F.greatest(F.count("rep") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks")), "clusters")
    member = member.join(size, "chain").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    member = member.join(texts, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = member.select(F.xxhash64("chain", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "rep", "root", "n", "sig", "mine", (F.col("mine") == F.col("other")).alias("same"), "text")
    # a tile of two blocks gets the rows of both; a tile of one block has each row once
    more = staged(tiles.repartition(partitions(spark), "tile").sortWithinPartitions("tile", "rep").mapInArrow(_tile(k, percent, low), "lead long, rep long"), "more-links")
    roots = components(links.unionByName(more).toDF("a", "b"))
    whole = staged(groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set1", "set2", "n", "doc_id", F.coalesce("root", "rep").alias("root")), "roots")
    least = staged(whole.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("sets")).where("sets > 1").select("root", "least"), "least")
    whole = staged(whole.join(least, "root", "left").select("set1", "set2", "n", F.coalesce("least", "doc_id").alias("root")), "components")
    out = signs.join(whole, ["set1", "set2", "n"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
