"""Readers and writers of molecule strings and token tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_smiles_csv(spark: SparkSession, path: str) -> DataFrame:
    """smiles from the column SMILES, else smiles, else the first; a header is expected."""
    raw = spark.read.option("header", True).csv(path)
    name = next((c for c in ("SMILES", "smiles") if c in raw.columns), raw.columns[0])
    return raw.select(F.col(f"`{name}`").alias("smiles")).where("smiles IS NOT NULL")


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """First word of each line; blank lines and comments (#) are left out."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+")[0].alias("smiles"))


def read_qm9(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """smiles of a table exported as Parquet, or as CSV with a header: rows that have one, all or the first n."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    rows = raw.select("smiles").where("smiles IS NOT NULL AND smiles <> ''")
    return rows if n is None else rows.limit(n)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of key: the same rows on every run and cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds split: train, val or test, 80/10/10 by a seeded hash, without a shuffle."""
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10))
    return df.withColumn("split", F.when(at < 8, "train").when(at == 8, "val").otherwise("test"))


def cache_name(dataset: str, part: str, scheme: str, n: int, config: dict) -> str:
    digest = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]
    return f"{dataset}_{part}_{scheme}_{n}_{digest}"


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token table (graph_id, scheme, split, tokens), one folder per scheme and split."""
    tokens.write.mode("overwrite").partitionBy("scheme", "split").parquet(path)
