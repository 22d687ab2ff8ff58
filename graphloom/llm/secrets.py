"""Secret scans with corpus-wide ownership frequencies."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import small_batches, staged

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A further candidate: a long run of key characters with both letters and digits and at least ENTROPY bits a character.
KEYLIKE = re.compile(r"[A-Za-z0-9+/_=-]{28,}")
ENTROPY = 3.5
#: Owners, and repositories, from which on a value counts as widely copied. A forked or mirrored key stands with two owners, so two are
#: not enough; a published example soon has three. Tables without a column of repositories give their owners for both.
COPIED = 3
_RUN = bytes(48 + (65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57 or b in b"+/_=-") for b in range(256))
_HEXRUN = bytes(48 + (48 <= b <= 57 or 97 <= b <= 102) for b in range(256))
KINDS = ("assign", "access", "hex", "owned")

SCANNED = "doc_id long, owner string, repository string, sha string, n_assign long, n_access long, n_hex long, base array<struct<s:int,k:int,e:int>>, found array<struct<s:int,e:int,base:boolean,h:binary>>"


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bool, bytes]]]:
    """Base spans (start, kind, end) of a text, and the candidate values with their hashes."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    spans: list[tuple[int, int, int]] = []
    values: list[tuple[int, int, bool, str]] = []
    if any(w in low for w in (b"password", b"passwd", b"secret", b"token", b"api")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end()))
                values.append((m.start(2), m.end(2), True, m[2]))
    if b"AKIA" in raw:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 20:
                spans.append((m.start(), 1, m.end()))
                values.append((m.start(), m.end(), True, m[0]))
    if b"1" * 24 in raw.translate(_HEXRUN):
        for m in HEX.finditer(text):
            spans.append((m.start(), 2, m.end()))
            values.append((m.start(), m.end(), True, m[0]))
    if b"1" * 28 in raw.translate(_RUN):
        taken = [(s, e) for s, _, e in spans]
        for m in KEYLIKE.finditer(text):
            v = m[0]
            if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not any(s < m.end() and m.start() < e for s, e in taken):
                if -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()) >= ENTROPY:
                    values.append((m.start(), m.end(), False, v))
    spans.sort()
    return spans, [(s, e, b, hashlib.sha256(v.encode()).digest()) for s, e, b, v in values]


def _scan_batches(batches):
    for batch in batches:
        rows = []
        for doc, owner, repo, sha, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans, values = scan(text or "")
            n = Counter(k for _, k, _ in spans)
            rows.append((doc, owner, repo, sha, n[0], n[1], n[2], [{"s": s, "k": k, "e": e} for s, k, e in spans], [{"s": s, "e": e, "base": b, "h": h} for s, e, b, h in values]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=["doc_id", "owner", "repository", "sha", "n_assign", "n_access", "n_hex", "base", "found"])


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_()), ("h", pa.binary())]))]


def _judged(docs: DataFrame, owner: str, repository: str, copied: int, forks: int) -> DataFrame:
    """A row per row of docs: doc_id, sha (of the text), the counts, base and all spans as arrays, n_live and n_copied."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.sha2("text", 256).alias("sha"), "text").mapInArrow(_scan_batches, SCANNED)
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = found.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    pairs = each.groupBy("h", F.coalesce("owner", F.lit("\0")).alias("o"), F.coalesce("repository", F.lit("\0")).alias("r")).agg(F.lit(1).alias("one"))
    holders = pairs.groupBy("h").agg(F.count_distinct("o").alias("owners"), F.count("r").alias("repositories"))
    public = (F.col("owners") >= copied) & (F.col("repositories") >= forks)
    judged = each.join(holders, "h").groupBy("row").agg(
        F.sum((~public).cast("long")).alias("n_live"),
        F.sum(public.cast("long")).alias("n_copied"),
        F.collect_list(F.when(~F.col("base") & ~public, F.struct("s", F.lit(3).alias("k"), "e"))).alias("more"),
    )
    out = found.join(judged, "row", "left").withColumn("more", F.coalesce("more", F.expr("array()").cast("array<struct<s:int,k:int,e:int>>")))
    return out.withColumn("every", F.array_sort(F.concat("base", "more")))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "source", copied: int = COPIED, forks: int = COPIED) -> DataFrame:
    """docs: doc_id, text and the columns of owner and repository. One row per row of docs.

    n_assign, n_access, n_hex and base_sha256 tell of the base spans; spans has those and the added ones of kind `owned`:
    key-like strings that the base patterns miss and that aren't widely copied. Widely copied, published examples for the most
    part, are values that over the whole corpus at least `copied` owners hold, in at least `forks` repositories together; a live
    key of which one copy stands elsewhere stays live. However often one owner has a value, it is that owner's. n_live and n_copied count the candidate values of the row by that rule.
    Counts are made before the shuffle, so one value in any share of all rows is no load for a task. Offsets are code points,
    end exclusive. Null and empty texts have no spans; null is an owner like others; repeated rows each have their row; no rows
    give no rows.
    """
    kinds = F.array(*map(F.lit, KINDS))
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"], x["e"])), ",")
    return _judged(docs, owner, repository, copied, forks).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("every")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", repository: str = "source", copied: int = COPIED, forks: int = COPIED) -> DataFrame:
    """docs with every span of scan_secrets in text, base and owned, replaced by mark and n_chars renewed; texts without spans
    stay as they are. Spans follow from the text and the corpus, so rows meet theirs by the text's SHA-256, whatever their doc_id."""
    columns = docs.columns
    spans = _judged(docs, owner, repository, copied, forks).where(F.size("every") > 0).select(F.col("sha").alias("_sha"), F.col("every").alias("_spans")).dropDuplicates(["_sha"])
    marked = docs.select(F.struct(*columns).alias("row"), F.sha2("text", 256).alias("_sha")).join(spans, "_sha", "left").select("row.*", "_spans")

    def clean(batches):
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            out = []
            for t, found in zip(texts, batch.column(len(columns)).to_pylist(), strict=True):
                done, at = [], 0
                for x in found or ():
                    if x["s"] >= at:
                        done += [t[at : x["s"]], mark]
                    at = max(at, x["e"])
                out.append("".join([*done, t[at:]]) if found else t)
            held = batch.column(len(columns))
            batch = batch.select(columns)
            batch = batch.set_column(columns.index("text"), "text", pa.array(out, batch.schema.field("text").type))
            if "n_chars" in columns:
                n = [len(t) if x.is_valid else old for t, x, old in zip(out, held, batch.column(columns.index("n_chars")).to_pylist(), strict=True)]
                batch = batch.set_column(columns.index("n_chars"), "n_chars", pa.array(n, batch.schema.field("n_chars").type))
            yield batch

    small_batches(docs.sparkSession)
    return marked.mapInArrow(clean, docs.schema)
