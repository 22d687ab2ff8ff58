"""From raw documents to a mix: toxicity, near-duplicates, benchmark leaks, secrets, source weights."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, mixing, neardup, secrets, toxicity
from graphloom.llm._shared import WRITTEN, drop_staged, shared_dir, staged

#: What the stage before has staged. It goes when the next one begins, as each stage's result is written before.
_before: list[str] = []


def stage(run):
    @functools.wraps(run)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(spark, _before)
        begin = len(WRITTEN)
        out = run(spark, docs, sf_dir)
        _before[:] = WRITTEN[begin:]
        return out

    return wrapped


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is predicted toxic leave; null, empty and repeated texts are judged like any."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates at a similarity of 0.8. Rows are told apart by a key of their own, so
    repeated rows and null or repeated doc_ids are rows like others; rows without words are all kept."""
    row = f"row_{uuid.uuid4().hex}"
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    rows = neardup.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), percent=80)
    gone = rows.where("NOT kept").select(F.col("doc_id").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds most of a benchmark item leave; null and empty texts stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets leave the texts: base patterns, and key-like strings that the corpus doesn't show to be widely copied."""
    return secrets.redact(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix; what lies beyond the budget, and texts without words, aren't in it."""
    return mixing.mix_sources(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix),
]
#: No SQL expresses a trained score or tiling. tests/llm holds each stage's operator against a brute-force version or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, step) in enumerate(STAGES):
        step(spark, out, sf_dir).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_staged(spark, [f"{folder}/{k - 1}"])
    return out
