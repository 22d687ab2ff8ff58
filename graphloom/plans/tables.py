"""Queries through table functions, and the classifier bound over user-day graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import tables
from graphloom.operators import classifier
from graphloom.operators import metrics as m
from graphloom.plans.baskets import _read
from graphloom.plans.collections import _events
from graphloom.plans.derived import _chain, on_chains
from graphloom.plans.moments import clustering_shapes, spectral_shapes
from graphloom.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]


def udtf_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    text = "SELECT mol_id, count(*) AS n, sum(size(m.atoms)) AS atoms FROM {mols}, LATERAL motif_matches(smiles, 'c1ccccc1') m GROUP BY mol_id"
    return on_chains(lambda x: spark.sql(text, mols=x))(spark, sf_dir)


def udtf_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    rows = _read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return spark.sql("SELECT t.graph_id AS user_id, t.src, t.dst, t.n FROM transitions(TABLE(SELECT user_id, event_type, ts, event_id FROM {rows}) PARTITION BY user_id ORDER BY (ts, event_id)) t", rows=rows)


def day_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a family of descriptors of user-day graphs, and pgd, the largest."""
    days = staged(m.sequence_graphs(_events(spark, sf_dir), ["user_id", "d", "side"], ["ts", "event_id"], "event_type"), "days")
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.col("d").cast("string")).alias("key")
    degree = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.size(F.filter(m.degrees(F.col("nodes"), F.col("edges")), lambda x: F.least(x, F.lit(8)) == k)).cast("double"))
    sizes = F.array(F.size("nodes").cast("double"), F.size("edges").cast("double"))
    keyed = days.select("side", "nodes", "edges", key)
    clustered = clustering_shapes(keyed.withColumn("side", F.concat_ws("|", "side", "key"))).select(F.split("side", "\\|")[0].alias("side"), F.split("side", "\\|")[1].alias("key"), "v")
    spectral = spectral_shapes(keyed.withColumn("side", F.concat_ws("|", "side", "key"))).select(F.split("side", "\\|")[0].alias("side"), F.split("side", "\\|")[1].alias("key"), F.array("sum1", "sum2").alias("v"))
    coarse = clustered.select("side", "key", F.array(F.col("v")[0], F.aggregate(F.slice("v", 2, 98), F.lit(0.0), lambda s, x: s + x), F.col("v")[99]).alias("v"))
    told = classifier.graph_discrepancy({"degree": keyed.select("side", "key", degree.alias("v")), "sizes": keyed.select("side", "key", sizes.alias("v")), "clustering": coarse, "spectral": spectral})
    return spark.createDataFrame(sorted(told.items()), "family string, bound double")


TABLES: dict[str, tuple[Query, str | None]] = {
    "udtf_motif_matches": (udtf_motifs, _chain("SELECT mol_id, p AS n, 6 * p AS atoms FROM mol WHERE p > 0")),
    "udtf_transitions": (
        udtf_transitions,
        """WITH s AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
          SELECT user_id, least(a, b) AS src, greatest(a, b) AS dst, count(*) AS n FROM s WHERE b IS NOT NULL AND a <> b GROUP BY ALL""",
    ),
    "graph_discrepancy": (day_discrepancy, None),
}
TABLE_QUERIES: dict[str, Query] = {k: q for k, (q, _) in TABLES.items()}
TABLE_ORACLES: dict[str, str] = {k: o for k, (_, o) in TABLES.items() if o is not None}
