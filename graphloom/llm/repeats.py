"""Exact substring dedup by bucket-pointer refinement over content-chosen positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import mix, prefix_hash, signed, small_batches, span_hash, staged, steps

LEN = 200
#: The first buckets are by strings of Q bytes; each refinement joins the bucket of a position with that of a later offset.
Q = 50
SPAN = LEN - Q + 1
#: Rows that one step of refining takes together, and the kinds of runs up to which a bucket is refined inside one task.
STEP_ROWS, KINDS = 2_000, 1_000
#: Windows that a piece of a larger bucket's run holds at most, round by round; in the last a piece is one window.
WIDTHS = (32, 8, 2, 1)
#: Windows of a document that are looked at together; the limit of a position's 28 bits is far above it.
STRETCH = 1 << 22


def buckets(data: np.ndarray) -> np.ndarray:
    """First bucket identifier of every position: a fingerprint of its Q bytes."""
    prefix = prefix_hash(data)
    start = np.arange(len(data) - Q + 1)
    return span_hash(prefix, start, start + Q)


def refine(data: np.ndarray, size: int = LEN) -> np.ndarray:
    """Bucket identifiers of every position for `size` bytes. Each level pairs the identifier of a position with that of a later
    offset, both from the level before; the last offset is such that the two strings end where `size` does."""
    ids, have = buckets(data), Q
    while have < size:
        step = min(have, size - have)
        ids = mix(ids[:-step] * np.uint64(0x9E3779B97F4A7C15) + mix(ids[step:]))
        have += step
    return ids


def owners(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of LEN bytes that share the position of their least bucket: (position, first window, windows).

    The position depends on the window's bytes alone (leftmost of equals), so equal windows have it at equal offsets.
    """
    keys = (mix(ids) & np.uint64(0xFFFFFFFFF0000000)) | np.arange(len(ids), dtype=np.uint64)
    n = len(keys) - SPAN + 1
    pad = -len(keys) % SPAN
    block = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & np.uint64(0x0FFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.diff(np.append(first, n))


def _texts(column):
    for at, _, data, offsets in steps(column):
        for r in range(len(offsets) - 1):
            yield data[offsets[r] : offsets[r + 1]]


def _anchors(batches):
    """One row per run of windows: its bucket, the fingerprint of all its bytes, and where it stands."""
    for batch in batches:
        cols = [[] for _ in range(5)]
        ids, hashes = batch.column("doc_id"), batch.column("key")
        for r, data in enumerate(_texts(batch.column("text"))):
            if len(data) < LEN:
                continue
            for begin in range(0, len(data) - LEN + 1, STRETCH):
                part = data[begin : begin + STRETCH + LEN - 1]
                b = buckets(part)
                pos, first, n = owners(b)
                whole = span_hash(prefix_hash(part), first, first + n - 1 + LEN)
                for c, v in zip(cols, ([r] * len(pos), signed(b[pos]), signed(whole ^ mix((pos - first).astype(np.uint64))), begin + first, n), strict=True):
                    c.append(np.asarray(v, dtype=np.int64))
        row = np.concatenate(cols[0]) if cols[0] else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), hashes.take(pa.array(row))] + [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols[1:]], names=["doc_id", "key", "bucket", "whole", "first", "n"])


def _contexts(kinds: int):
    """The bytes under the windows of the runs that their bucket alone doesn't settle; for large buckets, also where its string is.

    Runs stand for a text, of which one copy is enough. Rows come joined by (doc_id, key), so repeated rows follow one another; a
    copy that is looked at twice all the same changes nothing, as all its windows are repeats anyway."""

    def run_(batches):
        last = None
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), strict=True))
            again = [a == b for a, b in zip(rows, [last, *rows], strict=False)]
            last = rows[-1] if rows else last
            yield held_runs(batch, again)

    def held_runs(batch, again):
        row, runs, bytes_ = [], [], []
        held = batch.column("runs").to_pylist()
        for r, data in enumerate(_texts(batch.column("text"))):
            for run in () if again[r] else held[r]:
                row.append(r)
                held_bytes = data[run["first"] : run["first"] + run["n"] - 1 + LEN]
                # the least bucket's string is the first of its kind in the run
                at = int(np.argmax(signed(buckets(held_bytes)) == run["bucket"])) if run["kinds"] > kinds else 0
                runs.append((run["bucket"], run["first"], run["n"], at, run["kinds"]))
                bytes_.append(held_bytes.tobytes())
        took = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(took), batch.column("key").take(took), *(pa.array([x[i] for x in runs], pa.int64()) for i in range(5)), pa.array(bytes_, pa.binary())], names=["doc_id", "key", "bucket", "first", "n", "at", "kinds", "bytes"])

    return run_


def _refined(column, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, identifier of LEN bytes) of every window of rows of bytes that hold n windows each."""
    data = np.frombuffer(b"".join(column), dtype=np.uint8)
    begin = np.cumsum(n + LEN - 1) - (n + LEN - 1)
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, offset, refine(data)[begin[row] + offset]


def _settle(batches):
    """Runs of windows that recur in their bucket. Rows come sorted by bucket; whole buckets are refined together, STEP_ROWS rows or
    one bucket at a time."""
    held: list[pa.Table] = []
    rows = 0

    def settled(t: pa.Table):
        n = t.column("n").to_numpy()
        bucket = t.column("bucket").to_numpy()
        row, offset, window = _refined(t.column("bytes").to_pylist(), n)
        order = np.lexsort((window, bucket[row]))
        b, w = bucket[row][order], window[order]
        like = (b[1:] == b[:-1]) & (w[1:] == w[:-1])
        shared = np.zeros(len(row), dtype=bool)
        shared[order[1:][like]] = shared[order[:-1][like]] = True
        begin = np.flatnonzero(shared & np.concatenate([[True], ~shared[:-1] | (row[1:] != row[:-1])]))
        end = np.flatnonzero(shared & np.concatenate([~shared[1:] | (row[1:] != row[:-1]), [True]]))
        at = pa.array(row[begin])
        first = t.column("first").to_numpy()[row[begin]] + offset[begin]
        return pa.table([t.column("doc_id").take(at), t.column("key").take(at), pa.array(first), pa.array(end - begin + 1)], names=["doc_id", "key", "first", "n"]).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= STEP_ROWS:
            t = pa.concat_tables(held).combine_chunks()
            b = t.column("bucket").to_numpy()
            cut = int(np.searchsorted(b, b[-1]))
            if cut:
                yield from settled(t.slice(0, cut)).to_batches()
            held, rows = [t.slice(cut)], t.num_rows - cut
    if rows:
        yield from settled(pa.concat_tables(held).combine_chunks()).to_batches()


def _pieces(width: int):
    """Runs cut into pieces of up to `width` windows, at fixed distances before the string of the run's bucket. The bytes that all
    windows of such a piece have in common are its new bucket: equal windows stay together, as their distance is the same."""

    def run(batches):
        size = LEN - width + 1
        for batch in batches:
            row, bucket, whole, first, n, at, bytes_ = ([] for _ in range(7))
            for r, (held, begin, count, pos, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "n", "at", "bytes")), strict=True)):
                data = np.frombuffer(raw, dtype=np.uint8)
                block = np.arange((pos - count + 1) // width, pos // width + 1)
                start = pos - np.minimum(pos, block * width + width - 1)
                end = pos - np.maximum(pos - count + 1, block * width)
                old = mix(np.full(len(block), held, dtype=np.int64).view(np.uint64) + block.astype(np.uint64))
                row += [r] * len(block)
                bucket.append(mix(old ^ refine(data, size)[pos - block * width]))
                whole.append(span_hash(prefix_hash(data), start, end + LEN) ^ mix((pos - start).astype(np.uint64)))
                first += (begin + start).tolist()
                n += (end - start + 1).tolist()
                at += (pos - start).tolist()
                bytes_ += [raw[i : j + LEN] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
            took = pa.array(row, pa.int64())
            ids = [pa.array(signed(np.concatenate(x)) if x else np.zeros(0, np.int64)) for x in (bucket, whole)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(took), batch.column("key").take(took), *ids, *(pa.array(x, pa.int64()) for x in (first, n, at)), pa.array(bytes_, pa.binary())], names=["doc_id", "key", "bucket", "whole", "first", "n", "at", "bytes"])

    return run


def _cut(batches):
    for batch in batches:
        out = []
        spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
        for data, found in zip(_texts(batch.column("text")), spans, strict=True):
            gone, runs = np.zeros(len(data) + 1, dtype=np.int32), 0
            for s in found or ():
                gone[s["first"]] += 1
                gone[min(len(data), s["first"] + s["n"] - 1 + LEN)] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rounds(spark, large: DataFrame, kinds: int):
    """Spans that recur in buckets of more than `kinds` kinds of runs, round by round: runs are cut into shorter pieces, each in the
    bucket of the bytes its windows share. Pieces alone in their bucket are final, equal ones recur as a whole, one of each kind goes
    on. Buckets that have become small are refined inside tasks. Only pieces that differ at their edges alone are cut again."""
    for width in WIDTHS:
        if large.isEmpty():
            return
        pieces = staged(large.mapInArrow(_pieces(width), PIECE), "pieces")
        blocks = pieces.groupBy("bucket", "whole", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "key", "first", "at")).alias("one"), F.max("bytes").alias("bytes"))
        blocks = staged(blocks, "piece-kinds")
        shared = staged(blocks.groupBy("bucket").agg(F.sum("c").alias("rows"), F.count("*").alias("kinds")).where("rows > 1"), "piece-buckets")
        yield pieces.join(blocks.where("c > 1").select("bucket", "whole", "n"), ["bucket", "whole", "n"], "left_semi").select("doc_id", "key", "first", "n")
        left = blocks.join(shared.where("kinds > 1"), "bucket").select("one.doc_id", "one.key", "bucket", "one.first", "n", "one.at", "kinds", "bytes")
        left = staged(left, "piece-left")
        yield _inside(left.where(F.col("kinds") <= kinds))
        large = left.where(F.col("kinds") > kinds)


def _inside(runs: DataFrame) -> DataFrame:
    """Runs of small buckets, refined a few whole buckets at a time."""
    dealt = runs.select("doc_id", "key", "bucket", "first", "n", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_settle, "doc_id long, key long, first long, n long")


PIECE = "doc_id long, key long, bucket long, whole long, first long, n long, at long, bytes binary"


def drop_repeats(docs: DataFrame, kinds: int = KINDS) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every window of LEN bytes belongs to the position of its least Q-byte bucket, one position for about SPAN / 2 windows. Buckets
    with one position are final. In the others, runs of windows whose bytes are all alike are repeats as a whole; what is left of
    a shared bucket, one run of each kind with the bytes under it, is refined to LEN bytes by the identifiers of later offsets:
    buckets of up to `kinds` kinds inside a task; larger ones in rounds, each of which gives shorter pieces of runs a longer
    bucket, until buckets are small or a piece is one window. Rows are runs throughout, never windows of them, and equal runs are
    counted before any join, so a passage in any number of documents is no load for a task. Spans are kept once for a doc_id and text,
    however many rows have both. Buckets are content fingerprints in
    place of ranks, so refining needs no global sort. Identifiers of a window are its bucket's and its own, 128 bits together.

    Null and empty texts, and those under LEN bytes, keep all; a null doc_id is an id like others; texts of any length are whole;
    repeated rows, of one doc_id or not, are repeats of each other; other columns of docs, whatever their names, play no part; no
    rows give no rows.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    anchors = staged(keyed.mapInArrow(_anchors, "doc_id long, key long, bucket long, whole long, first long, n long"), "anchors")
    blocks = anchors.groupBy("bucket", "whole", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "key", "first")).alias("one"))
    shared = blocks.groupBy("bucket").agg(F.sum("c").alias("rows"), F.count("*").alias("kinds")).where("rows > 1")
    blocks = staged(blocks.join(shared, "bucket"), "blocks")
    same = anchors.join(blocks.where("c > 1").select("bucket", "whole", "n"), ["bucket", "whole", "n"], "left_semi").select("doc_id", "key", "first", "n")
    open_ = blocks.where("kinds > 1").select("one.*", "bucket", "n", "kinds")
    runs = open_.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "n", "bucket", "kinds")).alias("runs"))
    texts = keyed.alias("t").join(runs.alias("r"), F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.key") == F.col("r.key"))).select("t.doc_id", "t.key", "t.text", "r.runs")
    contexts = staged(texts.mapInArrow(_contexts(kinds), "doc_id long, key long, bucket long, first long, n long, at long, kinds long, bytes binary"), "contexts")
    found = same.unionByName(_inside(contexts.where(F.col("kinds") <= kinds)))
    for more in _rounds(docs.sparkSession, contexts.where(F.col("kinds") > kinds), kinds):
        found = found.unionByName(more)
    spans = staged(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias("spans")), "spans")
    both = keyed.alias("t").join(spans.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.key") == F.col("s.key")), "left").select("t.doc_id", "t.text", "s.spans")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
