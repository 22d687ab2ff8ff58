"""Partitions of graphs as tables. parts: graph_id, part_id, nodes (array of node ids in order). edges: graph_id, src, dst and, where
a function says so, label; each edge once. What needs a graph's edges and parts together meets in one row a graph, by one shuffle of
each, so graphs of any number are dealt by key; a graph has to fit a row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_to_global(nodes: Column, local: Column) -> Column:
    return F.get(nodes, local)


def global_to_local(nodes: Column, node: Column) -> Column:
    """Null for a node that isn't there."""
    return F.nullif(F.array_position(nodes, node), F.lit(0)) - 1


def members(parts: DataFrame) -> DataFrame:
    """(graph_id, part_id, node, local)."""
    return parts.select("graph_id", "part_id", F.posexplode("nodes").alias("local", "node"))


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(*rest, F.col("dst").alias("src"), F.col("src").alias("dst")))


def _met(left: DataFrame, right: DataFrame, how: str, schema: str, fn: Callable[[list, list], list[tuple]]) -> DataFrame:
    """(graph_id, schema): what fn tells of each graph from its rows of both tables, each row a tuple of the columns but graph_id."""
    held = [t.groupBy("graph_id").agg(F.collect_list(F.struct(*[c for c in t.columns if c != "graph_id"])).alias(name)) for t, name in ((left, "_left"), (right, "_right"))]
    names = [c.split()[0] for c in schema.split(", ")]
    kind = left.schema["graph_id"].dataType.simpleString()
    out = [pa.type_for_alias({"int": "int32", "long": "int64"}[c.split()[1]]) for c in schema.split(", ")]

    def tuples(c: pa.ListArray) -> list[list[tuple]]:
        rows = list(zip(*(x.to_pylist() for x in c.flatten().flatten()), strict=True))
        ends = [0, *pa.compute.cumulative_sum(pa.compute.coalesce(pa.compute.list_value_length(c), 0)).to_pylist()]
        return [rows[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                b = batch.slice(begin, 1024)
                told = [fn(x, y) for x, y in zip(*(tuples(b.column(c)) for c in ("_left", "_right")), strict=True)]
                at = pa.array([k for k, rows in enumerate(told) for _ in rows], pa.int32())
                columns = list(zip(*(r for rows in told for r in rows), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([b.column("graph_id").take(at), *(pa.array(c, t) for c, t in zip(columns, out, strict=True))], names=["graph_id", *names])

    return held[0].join(held[1], "graph_id", how).mapInArrow(run, f"graph_id {kind}, {schema}")


def _kind(df: DataFrame, column: str) -> str:
    return "int" if df.schema[column].dataType.simpleString() == "int" else "long"


def _kind_of_items(df: DataFrame, column: str) -> str:
    return "int" if df.schema[column].dataType.elementType.simpleString() == "int" else "long"


def _sites(parts: list[tuple]) -> dict[int, list[tuple[int, int]]]:
    """Node to its parts, each with the node's place there."""
    out: dict[int, list[tuple[int, int]]] = {}
    for part, nodes in parts:
        for local, x in enumerate(nodes or ()):
            out.setdefault(x, []).append((part, local))
    return out


def _placed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst, further numbers) with each end's part and place in it; a row for each pair of parts."""
    more = [c for c in edges.columns if c not in ("graph_id", "src", "dst")]
    part, at = _kind(parts, "part_id"), "int"
    schema = [f"src {_kind(edges, 'src')}", f"dst {_kind(edges, 'dst')}", *(f"{c} {_kind(edges, c)}" for c in more), f"src_part {part}", f"src_local {at}", f"dst_part {part}", f"dst_local {at}"]

    def one(rows, held):
        sites = _sites(held)
        return [(*e, *x, *y) for e in rows for x in sites.get(e[0], ()) for y in sites.get(e[1], ())]

    return _met(edges.select("graph_id", "src", "dst", *more), parts.select("graph_id", "part_id", "nodes"), "inner", ", ".join(schema), one)


def internal_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with both ends in a part: graph_id, part_id, src, dst, src_local, dst_local."""
    x = _placed(edges.select("graph_id", "src", "dst"), parts).where("src_part = dst_part")
    return x.select("graph_id", F.col("src_part").alias("part_id"), "src", "dst", "src_local", "dst_local")


def bipartites(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between parts, as places in them: graph_id, left_part, right_part, left_local, right_local; left_part < right_part."""
    part = _kind(parts, "part_id")

    def across(rows, held):
        sites = _sites(held)
        return list({min((x, y), (y, x))[0] + min((x, y), (y, x))[1] for u, v in rows for x in sites.get(u, ()) for y in sites.get(v, ()) if x[0] != y[0]})

    met = _met(edges.select("graph_id", "src", "dst"), parts.select("graph_id", "part_id", "nodes"), "inner", f"left_part {part}, left_local int, right_part {part}, right_local int", across)
    return met.select("graph_id", "left_part", "right_part", "left_local", "right_local")


def super_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(graph_id, left_part, right_part, left, right, label): edges between parts with their ends and label, each once."""
    x = _placed(edges, parts).where("src_part <> dst_part")
    first = F.col("src_part") < F.col("dst_part")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return x.groupBy("graph_id", pick("src_part", "dst_part").alias("left_part"), pick("dst_part", "src_part").alias("right_part"), pick("src", "dst").alias("left"), pick("dst", "src").alias("right")).agg(F.coalesce(F.max("label"), F.lit(0)).alias("label"))


def reconstruct(inner: DataFrame, across: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges (graph_id, src, dst; src < dst, each once) that internal_edges, by their places, and bipartites stand for. Places or
    parts that aren't there are left out."""
    one = inner.select("graph_id", F.col("part_id").alias("left_part"), F.col("src_local").alias("left_local"), F.col("part_id").alias("right_part"), F.col("dst_local").alias("right_local"))
    every = one.unionByName(across.select("graph_id", "left_part", "left_local", "right_part", "right_local"))
    node = _kind_of_items(parts, "nodes")

    def edges(rows, held):
        at: dict[tuple[int, int], list[int]] = {}
        for part, nodes in held:
            for local, x in enumerate(nodes or ()):
                at.setdefault((part, local), []).append(x)
        return list({(min(u, v), max(u, v)) for a, i, b, j in rows for u in at.get((a, i), ()) for v in at.get((b, j), ()) if u != v})

    return _met(every, parts.select("graph_id", "part_id", "nodes"), "inner", f"src {node}, dst {node}", edges)


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with the label that labels (graph_id, src, dst, label, either way round) has for them; 0 where there is none."""
    known = labels.groupBy("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("label").alias("label"))
    return edges.join(known, ["graph_id", "src", "dst"], "left").select("graph_id", "src", "dst", F.coalesce("label", F.lit(0)).alias("label"))


def infer_bipartites(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(graph_id, left_part, right_part, pairs): the edges between each pair of parts, by places, in order."""
    pairs = bipartites(edges, parts).groupBy("graph_id", "left_part", "right_part")
    return pairs.agg(F.array_sort(F.collect_set(F.struct("left_local", "right_local"))).alias("pairs"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph_id, node, neighbours): in order, from edges at all levels together."""
    return both_ways(edges.select("graph_id", "src", "dst")).where("src <> dst").groupBy("graph_id", F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def empty_hierarchy(graphs: DataFrame) -> DataFrame:
    """graphs: graph_id, num_nodes. One part of all nodes each."""
    nodes = F.when(F.col("num_nodes") > 0, F.sequence(F.lit(0), F.col("num_nodes").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return graphs.select("graph_id", F.lit(0).alias("part_id"), nodes.alias("nodes"))


def level_info(levels: DataFrame) -> DataFrame:
    """levels: graph_id, path (array of part ids from the top), nodes. (graph_id, level, parts, sizes): parts a level and their sizes."""
    return levels.groupBy("graph_id", (F.size("path") - 1).alias("level")).agg(F.count("*").alias("parts"), F.transform(F.array_sort(F.collect_list(F.struct("path", F.size("nodes").alias("n")))), lambda x: x["n"]).alias("sizes"))


def depth(levels: DataFrame) -> DataFrame:
    """(graph_id, depth): the longest path."""
    return levels.groupBy("graph_id").agg(F.max(F.size("path")).alias("depth"))


def community_info(communities: DataFrame) -> DataFrame:
    """communities: graph_id, ctype, atoms. (graph_id, ctype, n, atoms)."""
    return communities.groupBy("graph_id", "ctype").agg(F.count("*").alias("n"), F.sum(F.size("atoms")).alias("atoms"))


def motif_communities(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """nodes: graph_id, node. matches: graph_id, atoms. (graph_id, node, community): nodes that a chain of matches joins are one
    community, others one each; communities are numbered by their least node. A graph's matches are joined in one task, as graphs are small."""
    node = _kind(nodes, "node")

    def joined(rows, held):
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for (atoms,) in held:
            for x in atoms or ():
                a, b = find(x), find(atoms[0])
                root[max(a, b)] = min(a, b)
        least = [find(x) for (x,) in rows]
        number = {x: k for k, x in enumerate(sorted(set(least)))}
        return [(x, number[y]) for (x,), y in zip(rows, least, strict=True)]

    return _met(nodes.select("graph_id", "node"), matches.select("graph_id", "atoms"), "left", f"node {node}, community int", joined)


def merge_singletons(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, community): a community of one node joins that of its least neighbour whose community has more."""

    def merged(rows, held):
        size = Counter(c for _, c in rows)
        alone, into = {x for x, c in rows if size[c] == 1}, {x: c for x, c in rows if size[c] > 1}
        best: dict[int, int] = {}
        for u, v in held:
            for x, y in ((u, v), (v, u)):
                if x in alone and y in into and y <= best.get(x, y):
                    best[x] = y
        return [(x, into[best[x]] if x in best else c) for x, c in rows]

    schema = f"node {_kind(communities, 'node')}, community {_kind(communities, 'community')}"
    return _met(communities.select("graph_id", "node", "community"), edges.select("graph_id", "src", "dst"), "left", schema, merged)


def as_parts(communities: DataFrame) -> DataFrame:
    """(graph_id, part_id, nodes), parts numbered by their least node."""
    held = communities.groupBy("graph_id", "community").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return held.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy(F.array_min("nodes"))) - 1).alias("part_id"), "nodes")
