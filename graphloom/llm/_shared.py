"""What the corpus operators share: staged tables, Arrow batches as numpy arrays, word shingles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGED = "graphloom-staged"
#: Rows that one Arrow batch holds. Texts are long, so Spark's default of 10,000 needs too much memory.
BATCH_ROWS = 500
#: Bytes of text that one vectorised step takes together; a longer text is a step of its own.
STEP_BYTES = 1 << 21


#: Folders that `staged` has written in this process, in order.
WRITTEN: list[str] = []


#: The folder made for sessions on a local master that name none; one a process.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on a local master (tests, a laptop) is one made where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(shutil.rmtree, _made[0], True)
    return _made[0]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{STAGED}/{tag}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that `staged` has written, and no others."""
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS; texts of any length then fit a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_text(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- bytes and words, vectorised

_MULT = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}
_INV = pow(_MULT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse modulo 2**64."""
    have = len(_POW["up"]) if "up" in _POW else 0
    if have < n:
        n = max(n, STEP_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", _INV)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _POW[name] = np.multiply.accumulate(out)
    return _POW["up"], _POW["down"]


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Sums over data[:i] from which `span_hash` gets the fingerprint of any range."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end]: equal bytes, equal value, wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + end.astype(np.uint64) - start.astype(np.uint64))


def steps(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about STEP_BYTES; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(column.type) else column.fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + STEP_BYTES, side="right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows, and the number of words before each row."""
    word = _IS_WORD[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begin[inner] = word[inner]
    start = np.flatnonzero(begin)
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:][(offsets[1:] > 0)] - 1
    last[ends] = word[ends]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the k-word shingles of lower-cased rows, in order, and the bounds of each row's.

    A row of 1 to k-1 words has one shingle, its whole sequence; a row without words has none.
    """
    start, end, first = word_bounds(data, offsets)
    words = span_hash(prefix_hash(data, _BYTE_LOWER), start, end)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(bounds[-1], dtype=np.uint64)
    if len(words) >= k:
        acc = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            acc = acc * np.uint64(_MULT) + words[i : len(words) - k + 1 + i]
        row = np.repeat(np.arange(len(counts)), np.where(counts >= k, n, 0))
        pos = np.arange(len(row)) - np.repeat(np.cumsum(np.where(counts >= k, n, 0)) - np.where(counts >= k, n, 0), np.where(counts >= k, n, 0))
        out[bounds[row] + pos] = mix(acc[first[row] + pos])
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        acc = np.array([int(counts[r])], dtype=np.uint64)
        for w in words[first[r] : first[r + 1]]:
            acc = acc * np.uint64(_MULT) + w
        out[bounds[r]] = mix(acc)[0]
    return out, bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
