"""License scans with DataFrame functions only: MinHash bands of overlapping windows, then exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.license_texts import TEMPLATES

K, WINDOW, STRIDE, BANDS = 5, 8, 4, 6
#: Templates under so many shingles have windows of one shingle. At a containment of 0.8, edits of single words leave longer ones a
#: run of WINDOW + STRIDE shingles: of n, at most n / 25 edits take 5 each, and 0.8 * n / (n / 25 + 1) >= 12 from 38 on.
SHORT = 40
_MARKS = ".,;:!?\"'()[]{}<>#$%&*_-=+/\\|~^`@"


def shingles(text: Column) -> Column:
    """Fingerprints of K-word shingles, lower case and without marks, in order; fewer words are one shingle.

    Each word is hashed once; a shingle is the hash of its words' hashes, where a word that isn't there adds nothing."""
    words = F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKS, ""), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(K)])
    some = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - K)), lambda i: one(w, i))
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(some(w)))[0]


def _minhash(h: Column, stride: int) -> Column:
    """BANDS minima, one row each, of every window of WINDOW shingles that starts at a multiple of stride."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - WINDOW + stride), F.lit(stride))
    one = lambda seed: F.transform(F.array(F.transform(h, lambda x: F.xxhash64(x, F.lit(seed)))), lambda g: F.transform(starts, lambda s: F.xxhash64(F.lit(seed), F.array_min(F.slice(g, s, WINDOW)))))[0]
    return F.concat(*[one(seed) for seed in range(BANDS)])


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """docs: doc_id, text. (doc_id, license, containment) where at least `least` of a template's shingles stand in the text.

    A text's windows of WINDOW shingles overlap by half; a template's start at every shingle, so a copy of WINDOW + STRIDE
    shingles in a row holds a window equal to one of the template's and meets it in every band. That is certain for copies with
    words changed, put in or left out here and there, as long as they reach `least` = 0.8 (see SHORT); otherwise, at similarity s
    of two windows, one of BANDS bands of one minimum meets with probability 1 - (1 - s)**BANDS. Templates are a parameter and part
    of the plan; documents are never shuffled. Null and empty texts match nothing, texts of any length are whole, a null doc_id
    is kept, repeated rows repeat their matches, a text may match any number of templates; other columns of docs, whatever their
    names, play no part; no rows give no rows.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(templates.items()), "license string, template string").select("license", F.array_distinct(shingles(F.col("template"))).alias("want"))
    known = known.withColumn("keys", F.when(F.size("want") < SHORT, F.col("want")).otherwise(F.array_distinct(_minhash(F.col("want"), 1))))
    rows = known.collect()  # as many as templates
    longs = lambda x: F.array(*[F.lit(k) for k in x]).cast("array<bigint>")
    held = docs.select("doc_id", F.explode_outer(F.array(shingles(F.col("text")))).alias("h"))
    # windows agree in a band only if their least shingle is one of a template's: a text without any needs no bands
    held = held.where(F.arrays_overlap("h", longs(sorted({x for r in rows for x in r["want"]}))))
    bands = F.when(F.size("h") > 0, _minhash(F.col("h"), STRIDE)).otherwise(F.array().cast("array<bigint>"))
    held = held.select("doc_id", "h", F.explode_outer(F.array(F.array_distinct(F.concat("h", bands)))).alias("keys"))
    every = F.array(*[F.struct(F.lit(n).alias("number"), longs(r["keys"]).alias("keys")) for n, r in enumerate(rows)])
    met = held.select("doc_id", "h", F.explode(F.transform(F.filter(every, lambda t: F.arrays_overlap(t["keys"], F.col("keys"))), lambda t: t["number"])).alias("number"))
    numbered = spark.createDataFrame([(n, r.license, r["want"]) for n, r in enumerate(rows)], "number int, license string, want array<bigint>")
    share = F.size(F.array_intersect("want", "h")) / F.size("want")
    return met.join(F.broadcast(numbered), "number").select("doc_id", "license", share.alias("containment")).where(F.col("containment") >= least)
