"""Intermediate tables: written to the folder that the cluster names in spark.checkpoint.dir, so lineage ends at each."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder made for sessions on a local master that name none; one a process.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
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
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
