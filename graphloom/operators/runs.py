"""Tables of runs: matching, merging, ranking, export and settings along a chain of checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.staging import staged


def run_info(name: Column) -> Column:
    """From a run's name: scheme, coarsening and number of samples; null where it doesn't tell."""
    found = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return F.struct(found(r"(hsent|hdtc|hdt|sent)").alias("scheme"), found(r"(spectral|hac|motif|functional)").alias("coarsening"), found(r"_n(\d+)(?:_|$)").cast("int").alias("samples"))


def latest_match(runs: DataFrame, others: DataFrame, key: str = "checkpoint", when: str = "mtime", names: tuple[str, ...] = ()) -> DataFrame:
    """runs with the columns `names` of the newest row of others that has their key; null where there is none."""
    newest = others.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(when, *names)).alias("found"))
    return runs.join(newest, key, "left").select(*runs.columns, *[F.col(f"found.{n}").alias(n) for n in names])


def best(runs: DataFrame, by: str, metric: str) -> DataFrame:
    """The row of least metric for each value of by; null, -1 and NaN count as the largest."""
    bad = F.col(metric).isNull() | F.isnan(metric) | (F.col(metric) == -1)
    ranked = runs.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(F.when(bad, float("inf")).otherwise(F.col(metric)), *sorted(runs.columns))))
    return ranked.where("_at = 1").drop("_at")


def pivot(metrics: DataFrame, names: list[str]) -> DataFrame:
    """metrics: run_id, metric, value. A row a run, a column a metric."""
    return metrics.groupBy("run_id").pivot("metric", names).agg(F.first("value"))


def export_csv(table: DataFrame, path: str, digits: int = 4) -> None:
    """Numbers to a fixed number of digits, null empty, one header."""
    shown = [F.format_number(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes]
    table.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def lineage(configs: DataFrame) -> DataFrame:
    """configs: run_id, parent, settings (map). Each run's settings over those of the runs it was resumed from, nearest first.

    Every round doubles how far a run has looked back, so a chain of any length takes the logarithm of its length in rounds, and each
    round is staged. Runs that have nowhere left to look take no part in a round's join, where they would all meet in one task. A parent that
    isn't there ends a chain; runs that resume one another in a circle raise an error."""
    kind = "map<string,string>"
    out = staged(configs.select("run_id", F.col("parent").alias("next"), F.coalesce(F.col("settings"), F.create_map().cast(kind)).alias("settings")), "lineage")
    rounds = max(out.count(), 1).bit_length() + 1
    while not out.where("next IS NOT NULL").isEmpty():
        if not rounds:
            raise ValueError("runs resume one another in a circle")
        rounds -= 1
        further = out.select(F.col("run_id").alias("next"), F.col("next").alias("_next"), F.col("settings").alias("_more"))
        fresh = F.map_filter(F.coalesce("_more", F.create_map().cast(kind)), lambda k, v: ~F.map_contains_key("settings", k))
        met = out.where("next IS NOT NULL").join(further, "next", "left").select("run_id", F.col("_next").alias("next"), F.map_concat("settings", fresh).alias("settings"))
        out = staged(out.where("next IS NULL").unionByName(met), "lineage")
    return out.select("run_id", "settings")
