"""Datasets put together: splits, samples, caches of token sequences and their parts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.molecules import cache_name, read_smi, read_smiles_csv, sample

#: Seeds of the samples that validation and test sets are.
VALIDATION_SEED, TEST_SEED = 137, 42
#: Older names of settings, and the settings that later ones default to.
RENAMED = {"spectral_n_init": "n_init", "spectral_k_min_factor": "k_min_factor", "spectral_k_max_factor": "k_max_factor"}
DEFAULTS = {"n_init": 10, "k_min_factor": 0.7, "k_max_factor": 1.3}


def moses_splits(spark: SparkSession, root: str, sizes: dict[str, int]) -> dict[str, DataFrame]:
    """train from train.csv; val and test are two seeded samples of test.csv. sizes: most rows of each."""
    train, test = read_smiles_csv(spark, f"{root}/train.csv"), read_smiles_csv(spark, f"{root}/test.csv")
    return {
        "train": sample(train, "smiles", sizes["train"], TEST_SEED),
        "val": sample(test, "smiles", sizes["val"], VALIDATION_SEED),
        "test": sample(test, "smiles", sizes["test"], TEST_SEED),
    }


def ranked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds _place (from 0) in a seeded order and _all, the number of rows. Places come from ranks within 256 slices of the hash, so no
    task holds all rows."""
    h = F.xxhash64(F.lit(seed), key)
    sliced = rows.withColumn("_h", h).withColumn("_s", F.shiftright("_h", 56))
    before = sliced.groupBy("_s").agg(F.count("*").alias("_n"))
    total = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(total), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)) - 1
    return sliced.join(F.broadcast(before.drop("_n")), "_s").withColumn("_place", at).drop("_h", "_s", "_before")


def qm9_splits(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds split: eight tenths train, one val, one test, exactly, by a seeded order."""
    part = F.floor(F.col("_place") * 10 / F.col("_all"))
    return ranked(rows, key, seed).withColumn("split", F.when(part < 8, "train").when(part == 8, "val").otherwise("test")).drop("_place", "_all")


def coconut_splits(rows: DataFrame, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """Adds split: the first rows of a seeded order are train, then val, then test; all sizes shrink in proportion where there are
    fewer rows than they ask for. Other rows leave."""
    want = sum(sizes.values())
    shrunk = F.least(F.lit(1.0), F.col("_all") / F.lit(float(max(want, 1))))
    split, last, ends = F.lit(None).cast("string"), F.lit(0.0), []
    for name in ("train", "val", "test"):
        last = last + F.lit(float(sizes[name])) * shrunk
        ends.append((name, F.floor(last + 1e-9)))
    for name, end in reversed(ends):
        split = F.when(F.col("_place") < end, name).otherwise(split)
    return ranked(rows, key, seed).withColumn("split", split).where("split IS NOT NULL").drop("_place", "_all")


def splits(spark: SparkSession, dataset: str, root: str, sizes: dict[str, int], seed: int = 42) -> dict[str, DataFrame]:
    """The three splits of a dataset by name: moses, qm9 or coconut."""
    if dataset == "moses":
        return moses_splits(spark, root, sizes)
    if dataset == "qm9":
        rows = qm9_splits(read_smi(spark, f"{root}/qm9.smi"), "smiles", seed)
        return {k: sample(rows.where(F.col("split") == k), "smiles", sizes[k], seed).drop("split") for k in ("train", "val", "test")}
    if dataset == "coconut":
        rows = coconut_splits(read_smi(spark, f"{root}/coconut.smi"), "smiles", sizes, seed)
        return {k: rows.where(F.col("split") == k).drop("split") for k in ("train", "val", "test")}
    raise ValueError(f"no dataset {dataset!r}")


# ---------------------------------------------------------------- caches


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached_tokens(spark: SparkSession, root: str, dataset: str, part: str, scheme: str, n: int | None, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Tokens (graph_id, tokens) of a split: read if they were built before with this config, else built and written, with a row of
    metadata beside them. Without n nothing is cached."""
    if n is None:
        return build()
    folder = f"{root}/{cache_name(dataset, part, scheme, n, config)}"
    if not _exists(spark, f"{folder}/about"):
        build().write.mode("overwrite").parquet(f"{folder}/tokens")
        tokens = spark.read.parquet(f"{folder}/tokens")
        about = tokens.agg(F.count("*").alias("rows"), F.max(F.array_max("tokens")).alias("largest"))
        about.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).withColumn("scheme", F.lit(scheme)).write.mode("overwrite").parquet(f"{folder}/about")
    return spark.read.parquet(f"{folder}/tokens")


def combine_chunks(chunks: list[DataFrame], about: list[dict]) -> tuple[DataFrame, dict]:
    """Chunks (global_index, tokens) as one table in order, and their metadata as one: scheme and config must agree, vocab_size and
    max_num_nodes are the largest."""
    if len({(a["scheme"], json.dumps(normal_config(a["config"]), sort_keys=True)) for a in about}) != 1:
        raise ValueError("chunks of different schemes or settings")
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out.orderBy("global_index"), {**about[0], **{k: max(a[k] for a in about) for k in ("vocab_size", "max_num_nodes")}}


def chunk(rows: DataFrame, index: str, start: int, end: int) -> DataFrame:
    """Rows whose index is in [start, end)."""
    return rows.where((F.col(index) >= start) & (F.col(index) < end))


def normal_config(config: dict) -> dict:
    """Settings under their present names, with defaults where they are missing."""
    return {**DEFAULTS, **{RENAMED.get(k, k): v for k, v in config.items()}}


def export_smiles(train: DataFrame, test: DataFrame, path: str, parts: int = 1) -> None:
    """A text: the number of training rows, then the training strings, then the test strings. One file; with more parts, files whose
    names are in the order of the text, each written by a task of its own."""
    count = train.count()
    head = train.sparkSession.createDataFrame([(0, str(count))], "part int, value string")
    body = train.select(F.lit(1).alias("part"), F.col("smiles").alias("value")).unionByName(test.select(F.lit(2).alias("part"), F.col("smiles").alias("value")))
    head.unionByName(body).repartitionByRange(parts, "part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def smiles_column(rows: DataFrame) -> DataFrame:
    """smiles: the first column whose name holds that word, without nulls and blanks."""
    name = next((c for c in rows.columns if "smiles" in c.lower()), None)
    if name is None:
        raise ValueError("no column of molecule strings")
    return rows.select(F.trim(F.col(f"`{name}`")).alias("smiles")).where("smiles <> ''")
