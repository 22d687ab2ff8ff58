"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import mix, powers, shingle_hashes, small_batches, staged, steps

#: Tokens of benchmark items that one pass over the documents holds; more items make more passes.
BLOCK_TOKENS = 2_000_000
#: Seeds a word of item and document up to which a pair's are listed; with more, matches are found by their lengths.
SEEDS_PER_WORD = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def shared_starts(item: list[bytes], doc: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in item and doc where `least` equal tokens start."""
    at: dict[tuple, list[int]] = {}
    for j in range(len(doc) - least + 1):
        at.setdefault(tuple(doc[j : j + least]), []).append(j)
    pairs = [(i, j) for i in range(len(item) - least + 1) for j in at.get(tuple(item[i : i + least]), ())]
    return tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)


def tile(item: list[bytes], doc: list[bytes], least: int, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Tokens of item that tiles cover. Greedy string tiling: the longest match of unmarked tokens is marked, ties by its place in
    item, then doc, and again until none of `least` tokens or more is left. Neighbouring seeds on one diagonal are one match, so
    each match is looked at once and again only in the parts that marks have left of it.

    seeds: places in item and doc where `least` equal tokens start; looked up here if not given."""
    i, j = shared_starts(item, doc, least) if seeds is None else seeds
    if not len(i):
        return 0
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)]))
    heap = list(zip((-(np.diff(np.append(begin, len(i))) + least - 1)).tolist(), i[begin].tolist(), j[begin].tolist(), strict=True))
    heapify(heap)
    free_a, free_b, covered = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool), 0
    while heap and covered < len(item):
        n, x, y = heappop(heap)
        free = free_a[x : x - n] & free_b[y : y - n]
        if free.all():
            free_a[x : x - n] = free_b[y : y - n] = False
            covered -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo >= least:
                heappush(heap, (lo - hi, x + lo, y + lo))
    return covered


def tile_long(item: list[bytes], doc: list[bytes], least: int) -> int:
    """The same as `tile` in memory that follows the words, not the pairs of places: a word that item and doc repeat n and m times makes
    n * m seeds. The length of the longest match is searched by running Karp-Rabin fingerprints of all free windows; all matches of
    that length are marked in order, then shorter ones are looked for. Tokens are compared before they are marked."""
    ids: dict[bytes, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in x], dtype=np.int64) for x in (item, doc))
    up, down = powers(max(len(a), len(b)) + 1)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])]) for x in (a, b)]
    free = [np.ones(len(x), dtype=bool) for x in (a, b)]

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate([[0], np.cumsum(~free[side])])
        at = np.flatnonzero(taken[n:] == taken[:-n]) if n <= len(free[side]) else np.zeros(0, np.int64)
        return at, (sums[side][at + n] - sums[side][at]) * down[at]

    def common(n: int):
        (i, x), (j, y) = windows(0, n), windows(1, n)
        kept = np.isin(x, y)
        return i[kept], x[kept], j, y

    covered, high = 0, min(len(a), len(b))
    while high >= least and covered < len(a) and len(common(least)[0]):
        low = least
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        i, x, j, y = common(low)
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        ahead: dict[int, int] = {}
        for p, h in zip(i.tolist(), x, strict=True):
            if not (free[0][p] and free[0][p + low - 1]):  # tiles are as long as windows, so none lies between free ends
                continue
            at = ahead.get(int(h), -1)
            at = int(np.searchsorted(y, h)) if at < 0 else at
            while at < len(y) and y[at] == h:
                q = int(j[at])
                if free[1][q] and free[1][q + low - 1] and (a[p : p + low] == b[q : q + low]).all():
                    free[0][p : p + low] = free[1][q : q + low] = False
                    covered += low
                    break
                at += 1
            ahead[int(h)] = at
        high = low - 1
    return covered


def covered_by(item: list[bytes], doc: list[bytes], least: int, starts: dict[tuple, list[int]]) -> int:
    """Tokens of item that tiles cover; starts: the places of doc's runs of `least` tokens. Seeds are listed where there are no more of
    them than some words' worth; both ways give the same."""
    runs = [tuple(item[i : i + least]) for i in range(len(item) - least + 1)]
    if sum(len(starts.get(r, ())) for r in runs) > SEEDS_PER_WORD * (len(item) + len(doc)):
        return tile_long(item, doc, least)
    pairs = np.array([(i, j) for i, r in enumerate(runs) for j in starts.get(r, ())], dtype=np.int64).reshape(-1, 2)
    return tile(item, doc, least, (pairs[:, 0], pairs[:, 1]))


def _seeds(x, bounds, index):
    """Shingles that a step's rows and the items share, each once a row: arrays (row, item, place in item), in that order."""
    h, owner, place = index
    left = np.searchsorted(h, x)
    hit = np.flatnonzero(h[np.minimum(left, len(h) - 1)] == x)
    row = np.searchsorted(bounds, hit, side="right") - 1
    _, once = np.unique(np.stack([row, left[hit]]), axis=1, return_index=True)
    hit, row = hit[once], row[once]
    left, count = left[hit], np.searchsorted(h, x[hit], side="right") - left[hit]
    entry = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
    row = np.repeat(row, count)
    order = np.lexsort((place[entry], owner[entry], row))
    return row[order], owner[entry][order], place[entry][order]


def _groups(row, item, place, least, need):
    """(row, item) of the pairs whose seeds, overlaps included, touch as many tokens of the item as are needed: tiles consist of
    seeds, so no pair is lost."""
    if not len(row):
        return
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    ends = np.append(new[1:], True)
    step = np.where(ends, least, np.minimum(least, np.append(place[1:], 0) - place))
    touched = np.bincount(np.cumsum(new) - 1, weights=step)
    start = np.flatnonzero(new)
    for g in np.flatnonzero(touched >= need[item[start]]):
        yield int(row[start[g]]), int(item[start[g]])


def _matcher(items, k, share):
    """A function that gives (row, item_id, covered, words of the item) of the items that a column of texts holds."""
    tokens = [(i, words(t)) for i, t in items]
    need = np.array([share * len(t) for _, t in tokens])
    by_length: dict[int, list] = {}
    for n, (_, t) in enumerate(tokens):
        raw = b" ".join(t)
        x, _ = shingle_hashes(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), min(k, len(t)))
        by_length.setdefault(min(k, len(t)), []).append((x, np.full(len(x), n), np.arange(len(x))))
    indexes = {}
    for length, parts in by_length.items():
        h, owner, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        indexes[length] = h[order], owner[order], place[order]

    def found(texts):
        for at, _, data, offsets in steps(texts):
            for length, index in indexes.items():
                x, bounds = shingle_hashes(data, offsets, length)
                held, doc, starts = -1, [], {}
                for r, n in _groups(*_seeds(x, bounds, index), length, need):
                    if r != held:
                        held, doc, starts = r, words(texts[at + r].as_py()), {}
                        for j in range(len(doc) - length + 1):
                            starts.setdefault(tuple(doc[j : j + length]), []).append(j)
                    item, t = tokens[n]
                    covered = covered_by(t, doc, length, starts)
                    if covered >= share * len(t):
                        yield at + r, item, covered, len(t)

    return found


def _match(items, k, share):
    def run(batches):
        found = _matcher(items, k, share)
        for batch in batches:
            ids = batch.column("doc_id")
            out = [(ids[r].as_py(), *rest) for r, *rest in found(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "covered", "item_words"])

    return run


def _clean(items, k, share):
    def run(batches):
        found = _matcher(items, k, share)
        for batch in batches:
            fine = np.ones(batch.num_rows, dtype=bool)
            fine[[r for r, *_ in found(batch.column("text"))]] = False
            yield batch.filter(pa.array(fine))

    return run


def blocks(benchmark: DataFrame):
    """(list of (item_id, text), whether it is the last), of at most BLOCK_TOKENS words or one item each, read in order through
    the driver one block at a time."""
    held, size, ready = [], 0, None
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        n = len(words(row.text))
        if not n:
            continue
        if held and size + n > BLOCK_TOKENS:
            if ready:
                yield ready, False
            ready, held, size = held, [], 0
        held.append((row.item_id, row.text))
        size += n
    if ready:
        yield ready, not held
    if held:
        yield held, True


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, covered, item_words): items of which tiles of k words or more cover at least `share` in a document.

    Reordered passages count, as tiles stand anywhere. An item of fewer than k words is one tile. Null and empty texts and items
    match nothing; texts and items of any length are whole; repeated rows give repeated rows, repeated items repeat theirs; null
    ids are kept as they are; ties between tiles go to the first place; other columns, whatever their names, play no part; no rows
    on either side give no rows. Documents are never shuffled; items come in blocks of bounded size, each block one pass over the
    documents, written before the next is read.
    """
    small_batches(docs.sparkSession)
    lean = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, covered long, item_words long"
    out = None
    for block, last in blocks(benchmark):
        part = lean.mapInArrow(_match(block, k, share), schema)
        part = part if last and out is None else staged(part, "contaminated")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose own text holds no item of the benchmark as `contaminated` tells."""
    small_batches(docs.sparkSession)
    for block, last in blocks(benchmark):
        docs = docs.mapInArrow(_clean(block, k, share), docs.schema)
        docs = docs if last else staged(docs, "clean")
    return docs
