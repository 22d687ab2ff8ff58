"""Alignment of two tokenizers over a corpus: byte groups, links, and id-striped dense count matrices."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import small_batches, staged

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stripes that the ids of side B are dealt to by remainder. A stripe's block has a row for each of its ids and a column for each A id.
STRIPES = 1000
#: Segments of texts that a chunk of rows holds, but for a longer single text; bytes of segments that a worker remembers.
#: STEP: characters that are cut together; PART: characters of new segments that are encoded together, as an encoder holds some
#: hundred bytes a token.
CHUNK, REMEMBERED, STEP, PART = 1_000_000, 1 << 26, 1 << 19, 1 << 17
#: Cells that one task counts or answers for a stripe; a stripe with more is dealt to several tasks first.
CELLS = 1 << 28

#: Where a text may be cut for both tokenizers: before a space between two characters that no tokenizer takes for white space or
#: for a space's sign. Neither side has a token that reaches over such a place, as `Pair` checks.
_ODD = r"\s\x00-\x20\x7f-\xa0\u00ad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff"
_CUT = re.compile(rf"(?<=[^{_ODD}])(?= [^{_ODD}])")

_EMPTY = hashlib.sha256(b"").hexdigest()


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


@dataclass
class Aligned:
    """Arrays over segments: whether they tell anything, tokens on either side, groups, links; links' ids, one segment after the
    other; groups as text, each ended by a semicolon."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    groups: list[bytes]


class Pair:
    """The two tokenizers in one process, and what they make of a segment."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = _byte_letters()
        vocab = self.a.get_vocab()
        self.n_a = max(vocab.values()) + 1
        self.n_b = self.b.get_piece_size()
        special = {t["id"] for t in json.loads(byte_bpe)["added_tokens"]}
        self.bytes_a = [b""] * self.n_a
        for piece, k in vocab.items():
            self.bytes_a[k] = piece.encode() if k in special else bytes(letters[c] for c in piece)
        names = [self.b.id_to_piece(k) for k in range(self.n_b)]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece reaches over a space, so texts can't be cut at spaces")
        self.bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        self.size, self.start, self.bytes = zip(*[self._flat(t) for t in (self.bytes_a, self.bytes_b)], strict=True)
        most = max(self.n_a, self.n_b)
        self.digits = np.char.str_len(np.arange(most).astype(str)).astype(np.int64)
        self.decimal = np.frombuffer("".join(str(k).ljust(6) for k in range(most)).encode(), np.uint8)

    @staticmethod
    def _flat(table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in table], dtype=np.int64)
        return size, np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)

    def segments(self, segments: list[str]) -> Aligned:
        """What each segment, which begins with a space, tells. One without its own bytes on either side tells nothing (ok)."""
        raw = [s.encode() for s in segments]
        ids = ([e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)], self.b.encode([s[1:] for s in segments], num_threads=1))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = [np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in ids]
        of = [np.repeat(np.arange(len(raw)), np.fromiter(map(len, x), np.int64, len(raw))) for x in ids]
        ok = np.ones(len(raw), dtype=bool)
        for side in (0, 1):
            ok &= np.bincount(of[side], weights=self.size[side][flat[side]], minlength=len(raw)) == size
        text = np.frombuffer(b"".join(itertools.compress(raw, ok)), np.uint8)
        where = np.repeat(np.flatnonzero(ok), size[ok])
        right = ok.copy()
        for side in (0, 1):
            tokens = flat[side][ok[of[side]]]
            told = self.bytes[side][ragged(self.start[side][tokens], self.size[side][tokens])]
            right[where[told != text]] = False
        flat, of = zip(*[(f[right[o]], o[right[o]]) for f, o in zip(flat, of, strict=True)], strict=True)
        return self._aligned(right, size, flat, of)

    def _aligned(self, ok: np.ndarray, size: np.ndarray, flat, of) -> Aligned:
        """Both sides' token ends cut the bytes of all segments into pieces. A piece lies in one token of either side and no two
        pieces lie in the same two, so pieces are links; a piece that ends with both sides ends a group."""
        mark = np.zeros(int(size[ok].sum()) + 1, dtype=np.uint8)
        for side in (0, 1):
            mark[np.cumsum(self.size[side][flat[side]])] |= 1 + side
        kind = mark[np.flatnonzero(mark)]
        ends = kind == 3
        group = np.cumsum(ends) - ends
        at = [np.cumsum(kind & bit > 0) - (kind & bit > 0) for bit in (1, 2)]
        links = [flat[side][at[side]] for side in (0, 1)]
        seg = of[0][at[0]]
        n = [np.bincount(x, minlength=len(ok)) for x in (of[0], of[1], seg[ends], seg)]
        told = np.concatenate([group[kind & bit > 0] * 2 + side for side, bit in ((0, 1), (1, 2))])
        order = np.argsort(told, kind="stable")
        last = np.concatenate([ends[kind & bit > 0] for bit in (1, 2)])
        mark_ = np.concatenate([np.where(last[: len(flat[0])], ord("|"), ord(",")), np.where(last[len(flat[0]) :], ord(";"), ord(","))])[order]
        number = np.concatenate(flat)[order]
        width = self.digits[number]
        text = np.empty(int((width + 1).sum()), dtype=np.uint8)
        after = np.cumsum(width + 1)
        text[ragged(after - width - 1, width)] = self.decimal[ragged(number * 6, width)]
        text[after - 1] = mark_
        owner = np.concatenate(of)[order]
        cut = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=width + 1, minlength=len(ok)).astype(np.int64))]).tolist()
        text = text.tobytes()
        return Aligned(ok, *n, links[0], links[1], [text[x:y] for x, y in itertools.pairwise(cut)])


@functools.lru_cache(maxsize=2)
def _pair(byte_bpe: bytes, pieces: bytes) -> Pair:
    return Pair(byte_bpe, pieces)


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


class _Known:
    """Segments that a Python worker has met, numbered; arrays by number tell what they hold. Tasks of a worker follow one another,
    so the next one goes on with what the last has met, up to REMEMBERED bytes."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self):
        self.number_of: dict[str, int] = {}
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.groups: list[bytes] = []
        self.counts = np.zeros((5, 0), dtype=np.int64)
        self.held = 0

    def meet(self, segments: list[str]) -> None:
        # parts of at most some PART characters, or one longer segment, and of 8192 segments
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments))) // PART + np.arange(len(segments)) // 8192
        for at, to in itertools.pairwise([0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(segments)] if segments else []):
            part = segments[at:to]
            told = self.pair.segments(part)
            first = len(self.groups)
            self.groups += told.groups
            self.links.append((told.link_a.astype(np.int32), told.link_b.astype(np.int32)))
            self.counts = np.concatenate([self.counts, np.stack([told.ok, told.n_a, told.n_b, told.n_groups, told.n_links])], axis=1)
            self.number_of.update(zip(part, range(first, first + len(part)), strict=True))
            # text and groups, links of 8 bytes, and what Python keeps for a segment
            self.held += sum(map(len, part)) * 2 + sum(map(len, told.groups)) + 8 * len(told.link_a) + 400 * len(part)


@functools.lru_cache(maxsize=1)
def _known(byte_bpe: bytes, pieces: bytes) -> _Known:
    return _Known(_pair(byte_bpe, pieces))


class _Chunk:
    """Rows of a task until they hold CHUNK segments: each segment once, each cell (pair of ids) once, in the order of stripes."""

    def __init__(self, known: _Known, stripes: int):
        self.known, self.pair, self.stripes = known, known.pair, stripes
        self._clear()

    def _clear(self):
        self.rows: list[tuple] = []
        self.count = 0
        if self.known.held > REMEMBERED:
            self.known.forget()

    def add(self, ids: list, texts: list[str | None]) -> None:
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        number_of = self.known.number_of
        self.known.meet([s for s in dict.fromkeys(itertools.chain.from_iterable(cut)) if s not in number_of])
        groups = self.known.groups
        for doc, segs in zip(ids, cut, strict=True):
            place = np.fromiter(map(number_of.__getitem__, segs), np.int64, len(segs))
            ok, *n = self.known.counts[:, place]
            if not segs or not ok.all():
                self.rows.append((doc, 0, 0, 0, 0, "", place[:0]))
                continue
            digest = hashlib.sha256(b"".join(map(groups.__getitem__, place.tolist()))[:-1]).hexdigest()
            self.rows.append((doc, *[int(x.sum()) for x in n], digest, place))
            self.count += len(segs)

    def flush(self) -> Iterator[dict]:
        """One row a stripe with its cells and their counts, one row with the segments' cells, one row a document."""
        if not self.rows:
            return
        name = self.name()
        every = np.concatenate([row[6] for row in self.rows])
        used, n_used = np.unique(every, return_counts=True)
        often = np.argsort(-n_used, kind="stable")  # frequent segments get small numbers, which compress well
        used, n_used = used[often], n_used[often]
        number = np.zeros(len(self.known.groups), dtype=np.int32)
        number[used] = np.arange(len(used))
        every_size = self.known.counts[4]
        sizes = every_size[used]
        at = ragged((np.cumsum(every_size) - every_size)[used], sizes)
        a, b = (np.concatenate([x[side] for x in self.known.links] or [every])[at].astype(np.int64) for side in (0, 1))
        del at, every
        width = -(-self.pair.n_b // self.stripes)
        code = ((b % self.stripes) * width + b // self.stripes) * self.pair.n_a + a
        del a, b
        cells, where = np.unique(code, return_inverse=True)
        del code
        n = np.bincount(where, weights=np.repeat(n_used, sizes), minlength=len(cells)).astype(np.int64)
        stripe = cells // (width * self.pair.n_a)
        bounds = np.searchsorted(stripe, np.arange(self.stripes + 1))
        for s in np.unique(stripe):
            x = slice(bounds[s], bounds[s + 1])
            yield {"chunk": name, "kind": 0, "stripe": int(s), "n": int(bounds[s + 1] - bounds[s]), "cells": _pack((cells[x] - s * width * self.pair.n_a).astype(np.int32)), "counts": _pack(n[x])}
        yield {"chunk": name, "kind": 1, "n": len(cells), "cells": _pack(where.astype(np.int32)), "counts": _pack(sizes.astype(np.int32))}
        for doc, n_a, n_b, n_groups, n_links, digest, place in self.rows:
            yield {"chunk": name, "kind": 2, "cells": _pack(number[place]), "doc": (doc, n_a, n_b, n_groups, n_links, digest)}
        self._clear()

    def name(self) -> int:
        from pyspark import TaskContext

        self.number = getattr(self, "number", -1) + 1
        return (TaskContext.get().partitionId() << 32) + self.number


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string())])
_ROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("stripe", pa.int32()), ("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary()), ("doc", _DOC)])
_ROW_SQL = "chunk long, kind int, stripe int, n long, cells binary, counts binary, doc struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string>"
_NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")


def _table(rows: list[dict]) -> pa.RecordBatch:
    made = [{**r, "doc": dict(zip(_NAMES, r["doc"], strict=True)) if "doc" in r else None} for r in rows]
    return pa.RecordBatch.from_pylist(made, schema=_ROW)


def _in_parts(rows: Iterator[dict], size: int = 2000) -> Iterator[pa.RecordBatch]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield _table(part)
            part = []
    if part:
        yield _table(part)


def _links(files, stripes: int):
    def run(batches):
        chunk, waiting, size = _Chunk(_known(*files.value), stripes), [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                waiting.append((doc, text.as_py()))
                size += len(waiting[-1][1] or "")
                if size >= STEP:
                    chunk.add(*zip(*waiting, strict=True))
                    waiting, size = [], 0
                    if chunk.count >= CHUNK:
                        yield from _in_parts(chunk.flush())
        if waiting:
            chunk.add(*zip(*waiting, strict=True))
        yield from _in_parts(chunk.flush())

    return run


def _blocks(n_a: int, n_b: int, stripes: int, emit):
    """Streams rows in the order of stripes: counts go into a dense block by np.add.at; a stripe's end emits it."""
    width = -(-n_b // stripes)

    def run(batches):
        block, now = np.zeros((width, n_a), dtype=np.int64), None
        for b in batches:
            for s, cells, counts in zip(b["stripe"].to_pylist(), b["cells"], b["counts"], strict=True):
                if s != now and now is not None:
                    yield emit(now, block)
                    block[:] = 0
                now = s
                np.add.at(block.reshape(-1), np.frombuffer(cells.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int64))
        if now is not None:
            yield emit(now, block)

    return run


def _sparse(stripe: int, block: np.ndarray) -> pa.RecordBatch:
    cells = np.flatnonzero(block).astype(np.int32)
    return pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32()), "cells": pa.array([_pack(cells)], pa.binary()), "counts": pa.array([_pack(block.reshape(-1)[cells])], pa.binary())})


_COUNTED = "stripe int, cells binary, counts binary"


def count_links(links: DataFrame, n_a: int, n_b: int, stripes: int, salts: int = 1) -> DataFrame:
    """(stripe, cells, counts): the links of every pair of ids over all chunks, a row a stripe.

    Rows of a stripe meet in one task, in a block of (ids of the stripe) x n_a numbers. With several salts each stripe's chunks are
    first counted in as many tasks, whose sums then meet."""
    count = _blocks(n_a, n_b, stripes, _sparse)
    part = links.where("kind = 0").select("stripe", "chunk", "cells", "counts")
    if salts > 1:
        by = F.pmod(F.xxhash64("chunk"), F.lit(salts))
        part = part.withColumn("salt", by).repartition("stripe", "salt").sortWithinPartitions("salt", "stripe").select("stripe", "cells", "counts").mapInArrow(count, _COUNTED)
    return part.repartition("stripe").sortWithinPartitions("stripe").select("stripe", "cells", "counts").mapInArrow(count, _COUNTED)


def _answers(n_a: int, n_b: int, stripes: int):
    """Rows of a stripe in order: first its counts (kind -1), then chunks' cells, which get their count, negative where it isn't
    the highest of its B id."""
    width = -(-n_b // stripes)

    def run(batches):
        block, best = np.zeros((width, n_a), dtype=np.int64), None
        for b in batches:
            out = []
            for kind, cells, counts in zip(b["kind"].to_pylist(), b["cells"], b["counts"], strict=True):
                at = np.frombuffer(cells.as_buffer(), np.int32)
                if kind == -1:
                    block[:] = 0
                    block.reshape(-1)[at] = np.frombuffer(counts.as_buffer(), np.int64)
                    best = block.max(axis=1)
                    out.append(None)
                else:
                    n = block.reshape(-1)[at]
                    out.append(_pack(np.where(n == best[at // n_a], n, -n)))
            yield pa.RecordBatch.from_pydict({"chunk": b["chunk"], "stripe": b["stripe"], "counts": pa.array(out, pa.binary())})

    return run


def _scores(batches):
    """Rows of a chunk in order: answers by stripe (kind 0), segments' cells (kind 1), documents (kind 2)."""
    answers, now, total, best = [], None, None, None
    for b in batches:
        out = []
        for chunk, kind, cells, counts, doc in zip(b["chunk"].to_pylist(), b["kind"].to_pylist(), b["cells"], b["counts"], b["doc"].to_pylist(), strict=True):
            if chunk != now:
                now, answers = chunk, []
            if kind == 0:
                answers.append(np.frombuffer(counts.as_buffer(), np.int64))
            elif kind == 1:
                found = np.concatenate(answers) if answers else np.zeros(0, np.int64)
                sizes = np.frombuffer(counts.as_buffer(), np.int32)
                each = found[np.frombuffer(cells.as_buffer(), np.int32)]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                total, best = np.zeros(len(sizes), np.int64), np.bincount(owner[each > 0], minlength=len(sizes))
                np.add.at(total, owner, np.abs(each))
                answers = []
            else:
                place = np.frombuffer(cells.as_buffer(), np.int32)
                out.append((*[doc[k] for k in _NAMES[:-1]], int(best[place].sum()), int(total[place].sum()), doc["sha"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 7 + [pa.string()], strict=True)], _RESULT_NAMES)


_RESULT_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_RESULT = ", ".join(f"{n} long" for n in _RESULT_NAMES[:-1]) + ", groups_sha256 string"


def align_tokenizers(docs: DataFrame, folder: str = FOLDER, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, stripes: int = STRIPES) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are cut before single spaces, where both tokenizers always start a token, so whatever a segment gives, it gives in any
    text: a worker encodes and aligns each segment once and remembers it. A chunk of rows keeps each pair of ids once, with the
    number of its links. Pairs are dealt to stripes by B id; a stripe's task adds them up in a dense block of ids (np.add.at), and
    row maxima are the best counts. Pairs are then scored where their stripe's block is, and the answers go back to their chunk,
    whose documents sum them over their segments. So shuffled are pairs a chunk, never links a document; memory holds a block of
    (ids a stripe) x (A ids) numbers and a chunk. The vocabularies, some 2 MB whatever the corpus, are read by the driver from
    `folder` and sent to the tasks.

    Null and empty texts, and those whose joined bytes on either side aren't " " + text, have zeros and an empty groups_sha256, and
    take no part in counts. Repeated rows are rows like others, a null doc_id is an id like others, texts of any length are whole
    (one without such a space is one segment); no rows give no rows; other columns, whatever their names, play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    raw = tuple(open(f"{folder}/{name}", "rb").read() for name in (byte_bpe, pieces))
    pair = _pair(*raw)
    n_a, n_b = pair.n_a, pair.n_b
    links = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_links(spark.sparkContext.broadcast(raw), stripes), _ROW_SQL), "links")
    most = links.where("kind = 0").groupBy("stripe").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = -(-most // CELLS) or 1
    counts = staged(count_links(links, n_a, n_b, stripes, salts), "counts")
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    known = counts.select("stripe", salted, F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("chunk"), "cells", "counts")
    asked = links.where("kind = 0").select("stripe", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), "kind", "chunk", "cells", "counts")
    both = known.unionByName(asked).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    told = both.mapInArrow(_answers(n_a, n_b, stripes), "chunk long, stripe int, counts binary").where("chunk IS NOT NULL")
    answers = told.select("chunk", F.lit(0).alias("kind"), "stripe", F.lit(None).cast("binary").alias("cells"), "counts", F.lit(None).cast(links.schema["doc"].dataType).alias("doc"))
    rest = links.where("kind > 0").select("chunk", "kind", "stripe", "cells", "counts", "doc")
    return answers.unionByName(rest).repartition("chunk").sortWithinPartitions("chunk", "kind", "stripe").mapInArrow(_scores, _RESULT)
