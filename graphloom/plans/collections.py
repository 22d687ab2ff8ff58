"""The operators of graphloom.operators.metrics and .edges over collections made from the tables. Their oracles are the SQL texts of
graphloom.plans.registry, which DuckDB alone runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import edges as e
from graphloom.operators import metrics as m
from graphloom.operators.levels import BOND_WEIGHT


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    side = F.when(day < F.lit("2024-01-16").cast("date"), "ref").otherwise("gen")
    return _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", day.alias("d"), side.alias("side"))


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.sequence_graphs(_events(spark, sf_dir), ["user_id", "d", "side"], ["ts", "event_id"], "event_type")


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.two_sided(_events(spark, sf_dir).groupBy("side", F.col("event_type").alias("key")).agg(F.count("*").alias("n")))


def _cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cooccurrence(_graphs(spark, sf_dir).select("side", F.col("nodes").alias("motifs")))


def _mmd(kernel: str):
    return lambda s, d: m.mmd(m.degree_shapes(_graphs(s, d)), kernel).select(F.round("mmd2", 9).alias("mmd2"))


def _modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = m.sequence_graphs(_events(spark, sf_dir), ["user_id", "d"], ["ts", "event_id"], "event_type")
    edges = days.select(F.col("user_id").alias("graph_id"), F.inline("edges")).distinct()
    community = lambda c: F.length(c) % 3
    return m.modularity(edges.select("graph_id", "u", "v", community("u").alias("cu"), community("v").alias("cv"))).select(F.col("graph_id").alias("user_id"), F.round("q", 9).alias("q"))


def _user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a user's event types, over days."""
    events = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.to_date("ts").alias("d"))
    return e.transitions(events, "user_id", [F.col("d")], ["ts", "event_id"], "event_type")


def _on_users(fn):
    """fn of the users' edges, graph_id named user_id again."""
    return lambda s, d: _rounded(fn(_user(s, d)).withColumnRenamed("graph_id", "user_id"))


def _third(c):
    """Three communities of event types, by the length of their name."""
    return F.length(c) % 3


def _hist_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _events(spark, sf_dir).groupBy("user_id", "d", "side", "event_type").agg(F.count("*").alias("c"))
    side = lambda x: F.sum(F.when(F.col("side") == x, 1).otherwise(0)).alias(x[0])
    return _rounded(e.histogram_gap(c.groupBy(F.least("c", F.lit(10)).alias("bin")).agg(side("gen"), side("ref"))))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("o_orderkey") * 2654435761) % 10
    name = F.when(at < 8, "train").when(at == 8, "val").otherwise("test")
    return _read(spark, sf_dir, "orders").groupBy(name.alias("split")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.asc_nulls_last("l_extendedprice"), "l_orderkey", "l_linenumber")
    ranked = _read(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(by))
    return ranked.where("place = 1").select("l_suppkey", "l_returnflag", "l_partkey", F.col("l_extendedprice").alias("price"))


def _rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    place = F.dense_rank().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"))).cast("long")
    return n.select("l_returnflag", "l_suppkey", "n", place.alias("place"), F.count("*").over(Window.partitionBy("l_returnflag", "n")).alias("tied"))


def _order_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("k"))
    return parts.where("k > 1").select("l_orderkey", F.expr("k * (k - 1) div 2").alias("pairs"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


COLLECTIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "degree_mmd": _mmd("tv"),
    "gaussian_mmd": _mmd("gaussian"),
    "emd_mmd": _mmd("emd"),
    "degree_histogram": lambda s, d: m.degree_histogram(_graphs(s, d)),
    "graph_sizes": lambda s, d: m.graph_sizes(_graphs(s, d)),
    "compare_tv_kl": lambda s, d: _rounded(_two(s, d).agg(m.total_variation().alias("tv"), m.kl_smoothed().alias("kl"))),
    "addone_kl": lambda s, d: _rounded(_two(s, d).agg(m.kl_add_one().alias("kl"))),
    "freq_cosine": lambda s, d: _rounded(_two(s, d).agg(m.count_cosine().alias("cosine"))),
    "freq_l2": lambda s, d: _rounded(_two(s, d).agg(m.share_l2().alias("l2"))),
    "motif_histogram": lambda s, d: m.clipped_histogram(_events(s, d).groupBy("user_id", "d", "side", F.col("event_type").alias("motif")).agg(F.count("*").alias("n"))),
    "cooccurrence": lambda s, d: _rounded(_cooccurrence(s, d)),
    "cooccur_distance": lambda s, d: _rounded(m.cooccurrence_distance(_cooccurrence(s, d))),
    "cooccur_topk": lambda s, d: _rounded(_cooccurrence(s, d).where("side = 'ref' AND i <> j AND p > 0").select("i", "j", "p")).orderBy(F.desc("p"), "i", "j").limit(10),
    "modularity": _modularity,
    "clustering_histogram": lambda s, d: e.bins(e.clustering(_user(s, d)), "c", 100),
    "pattern_edge": _on_users(lambda x: x.groupBy("graph_id").agg(F.count("*").alias("matches"), F.sum("w").alias("weight"))),
    "pattern_path2": _on_users(lambda x: e.stars(x, 2)),
    "pattern_star3": _on_users(lambda x: e.stars(x, 3)),
    "pattern_triangle": _on_users(lambda x: e.triangles(x).groupBy("graph_id").agg(F.count("*").alias("matches"))),
    "motif_containment": _on_users(lambda x: e.triangles(x).select("graph_id").distinct()),
    "affinity_matrix": _on_users(lambda x: e.together(e.triangles(x), ["x", "y", "z"])),
    "motif_cohesion": _on_users(lambda x: e.cohesion(e.triangles(x), ["x", "y", "z"], _third)),
    "induced_edges": _on_users(lambda x: x.where(_third(F.col("u")) == _third(F.col("v"))).groupBy("graph_id", _third(F.col("u")).alias("community")).agg(F.count("*").alias("edges"))),
    "super_edges": _on_users(lambda x: x.select("graph_id", F.least(_third(F.col("u")), _third(F.col("v"))).alias("c1"), F.greatest(_third(F.col("u")), _third(F.col("v"))).alias("c2")).where("c1 <> c2").distinct()),
    "bipartite_edges": _on_users(lambda x: e.ends(x).select("graph_id", _third(F.col("v")).alias("ci"), _third(F.col("to")).alias("cj"), F.col("v").alias("u"), F.col("to").alias("v")).where("ci < cj")),
    "weighted_adjacency": _on_users(lambda x: x.select("graph_id", "u", "v", F.get(F.array(*map(F.lit, BOND_WEIGHT)), (F.col("w") % 5).cast("int")).alias("weight"))),
    "spectral_moments": _on_users(e.moments),
    "back_edges": _on_users(e.back_edges),
    "valence_rollup": lambda s, d: e.degrees(_user(s, d)).select(F.col("v").alias("node"), F.when(F.col("deg") > 6, "over").otherwise("ok").alias("role")).rollup("role", "node").agg(F.count("*").alias("n")),
    "hist_kl_w1": _hist_gap,
    "motif_summary_topk": lambda s, d: _read(s, d, "events").groupBy(F.col("event_type").alias("motif")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "motif").limit(20),
    "split_80_10_10": _split,
    "best_run": _best_run,
    "rank_ties": _rank_ties,
    "order_cliques": _order_cliques,
    "token_loss_perplexity": lambda s, d: _rounded(e.bigram_loss(_read(s, d, "events"), "user_id", ["ts", "event_id"], "event_type")),
    "token_length_stats": lambda s, d: m.length_stats(_read(s, d, "conversations").select(F.length("text").cast("long").alias("n")).where("n IS NOT NULL")),
    "validity_uniqueness": lambda s, d: _rounded(m.filled_and_distinct(_read(s, d, "documents"), "text")),
    "novelty": lambda s, d: _rounded(m.share_of_new(_read(s, d, "documents").where("lang <> 'en' OR lang IS NULL"), _read(s, d, "documents").where("lang = 'en'"), "text")),
}
