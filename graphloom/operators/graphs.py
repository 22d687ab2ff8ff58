"""Kernels over a collection of graphs: one row per graph, Arrow batches in and out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import kernels
from graphloom.operators.edges import transitions

_EDGES = """WITH step AS (SELECT user_id, event_type AS a, LEAD(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM {ev}),
e AS (SELECT DISTINCT user_id, least(a, b) AS u, greatest(a, b) AS v FROM step WHERE b IS NOT NULL AND a <> b)"""


def user_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, nodes (sorted labels), edges (pairs of places in nodes): transitions between event types of a user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", F.to_date("ts").alias("d"))
    pairs = transitions(events, "user_id", [F.col("d")], ["ts", "event_id"], "event_type")
    held = pairs.groupBy("graph_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("u", "v"))))).alias("nodes"), F.array_sort(F.collect_list(F.struct("u", "v"))).alias("pairs"))
    place = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    return held.select("graph_id", "nodes", F.transform("pairs", lambda p: F.array(place(p["u"]), place(p["v"]))).alias("edges"))


def per_graph(graphs: DataFrame, fn, schema: str) -> DataFrame:
    """fn(graph_id, nodes, edges) gives rows; graphs are independent, so there is no shuffle."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames):
        for frame in frames:
            rows = [r for g, nodes, edges in zip(frame.graph_id, frame.nodes, frame.edges, strict=True) for r in fn(g, list(nodes), {(int(u), int(v)) for u, v in edges})]
            yield pd.DataFrame(rows, columns=names)

    return graphs.mapInPandas(run, schema)


def node_order(graphs: DataFrame, method: str) -> DataFrame:
    return per_graph(graphs, lambda g, nodes, edges: [(g, k + 1, nodes[i]) for k, i in enumerate(kernels.order(len(nodes), edges, method))], "graph_id long, pos long, node string")


def partition(graphs: DataFrame, method: str) -> DataFrame:
    find = {"spectral": kernels.spectral_partition, "affinity": kernels.affinity_partition}[method]
    return per_graph(graphs, lambda g, nodes, edges: [(g, nodes[i], int(c)) for i, c in enumerate(find(len(nodes), edges))], "graph_id long, node string, community long")


def tokens(graphs: DataFrame, scheme: str) -> DataFrame:
    return per_graph(graphs, lambda g, nodes, edges: [(g, kernels.encode(scheme, len(nodes), edges, kernels.spectral_partition(len(nodes), edges)))], "graph_id long, tokens array<int>")


def round_trip(graphs: DataFrame, scheme: str) -> DataFrame:
    """The edges that decoding an encoded graph gives back."""

    def run(g, nodes, edges):
        code = kernels.encode(scheme, len(nodes), edges, kernels.spectral_partition(len(nodes), edges))
        return [(g, nodes[u], nodes[v]) for u, v in sorted(kernels.decode(scheme, code)[1])]

    return per_graph(graphs, run, "graph_id long, u string, v string")


def graph_queries():
    graph = lambda fn, *a: lambda spark, sf_dir: fn(user_graphs(spark, sf_dir), *a)
    out = {f"roundtrip_{s}": graph(round_trip, s) for s in ("flat", "hdt", "hsent", "hdtc")}
    return out


def graph_oracles() -> dict[str, str]:
    """Decoding gives the edges back."""
    return dict.fromkeys(graph_queries(), _EDGES.format(ev="events") + " SELECT user_id AS graph_id, u, v FROM e")
