"""Hierarchies of any depth as one table, each built where its graph's row is.

graphs: graph_id, ids (array of node ids in order), labels (array of int, alike), edges (array of struct u, v, label: places in
ids, u < v, each once). parts: graph_id, path (array of part numbers from the top; [] is the whole graph), nodes (array of places),
edges (those with both ends in nodes), communities (the child of each node, null in a leaf). A graph has to fit a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import kernels
from graphloom.sources.staging import staged

#: Parts of fewer nodes stay whole.
MIN_SIZE = 4
#: Numbers of adjacencies that are split in one step, and nodes and edges of the graphs that are split together.
STEP, HELD = 1 << 20, 1 << 18
EDGES = "array<struct<u: int, v: int, label: int>>"
#: Weights of the bond types 0 to 4 when parts are merged by affinity. Fixed values.
BOND_WEIGHT = (1.0, 2.0, 3.0, 1.5, 1.0)


def _plain(n: int, graphs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Adjacencies of graphs of n nodes, one upon the other."""
    a = np.zeros((len(graphs), n, n))
    for at, edges in zip(a, graphs, strict=True):
        if edges:
            u, v, _ = zip(*edges, strict=True)
            at[u, v] = at[v, u] = 1
    return a


def _bonds(n: int, graphs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    a = np.zeros((len(graphs), n, n))
    for at, edges in zip(a, graphs, strict=True):
        if edges:
            u, v, label = zip(*edges, strict=True)
            at[u, v] = at[v, u] = [BOND_WEIGHT[k] if 0 <= k < len(BOND_WEIGHT) else 1.0 for k in label]
    return a


#: Communities of graphs of one size, given as lists of edges.
METHODS = {
    "spectral": lambda n, graphs: kernels.spectral_partitions(_plain(n, graphs)),
    "simple": lambda n, graphs: kernels.spectral_partitions(_plain(n, graphs), 0.9, 1.1),
    "affinity": lambda n, graphs: kernels.affinity_partitions(_bonds(n, graphs)),
}


def _parts(find, graphs: list[tuple[int, list[tuple[int, int, int]]]], min_size: int, depth: int | None):
    """(place in graphs, path, nodes, edges, communities) of every part of some graphs, level by level; parts of one level and size are
    split together. Children are numbered by their first node."""
    open_ = [(g, (), list(range(n)), edges) for g, (n, edges) in enumerate(graphs)]
    while open_:
        sizes: dict[int, list] = {}
        for part in open_:
            n = len(part[2])
            whole = n < min_size or (depth is not None and len(part[1]) >= depth)
            sizes.setdefault(0 if whole else n, []).append(part)
        for g, path, nodes, held in sizes.pop(0, ()):
            yield g, path, nodes, held, None
        open_ = []
        for n, alike in sizes.items():
            step = max(1, STEP // (n * n))
            for begin in range(0, len(alike), step):
                some, local = alike[begin : begin + step], []
                for _, _, nodes, held in some:
                    at = {x: i for i, x in enumerate(nodes)}
                    local.append([(at[u], at[v], k) for u, v, k in held])
                for (g, path, nodes, held), found in zip(some, find(n, local).tolist(), strict=True):
                    first: dict[int, int] = {}
                    found = [first.setdefault(c, len(first)) for c in found]
                    if len(first) > 1:
                        child = dict(zip(nodes, found, strict=True))
                        groups, inside = [[] for _ in first], [[] for _ in first]
                        for x, c in child.items():
                            groups[c].append(x)
                        for e in held:
                            if (c := child[e[0]]) == child[e[1]]:
                                inside[c].append(e)
                        open_ += [(g, (*path, c), groups[c], inside[c]) for c in range(len(first))]
                    yield g, path, nodes, held, found if len(first) > 1 else None


def _hierarchies(method: str, min_size: int, depth: int | None):
    find, numbers = METHODS[method], pa.list_(pa.int32())

    def table(ids, begin, rows) -> pa.RecordBatch:
        at, path, nodes, edges, communities = zip(*rows, strict=True)
        u, v, label = (pa.array([e[k] for held in edges for e in held], pa.int32()) for k in range(3))
        ends = pa.array(np.cumsum([0, *map(len, edges)]), pa.int32())
        told = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([u, v, label], names=["u", "v", "label"]))
        columns = [ids.take(pa.array(np.array(at) + begin)), pa.array(path, numbers), pa.array(nodes, numbers), told, pa.array(communities, numbers)]
        return pa.RecordBatch.from_arrays(columns, names=["graph_id", "path", "nodes", "edges", "communities"])

    def run(batches):
        for b in batches:
            held, sizes = b.column("edges"), b.column("n").to_numpy()
            ends = held.offsets.to_numpy()
            u, v, label = (held.values.field(k).to_pylist() for k in range(3))
            # graphs of about HELD nodes and edges are split together
            load = np.cumsum(sizes + np.diff(ends)) // HELD
            cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(sizes)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                links = [list(zip(*(x[i:j] for x in (u, v, label)), strict=True)) for i, j in zip(ends[begin:end], ends[begin + 1 : end + 1], strict=True)]
                rows = []
                for row in _parts(find, list(zip(sizes[begin:end].tolist(), links, strict=True)), min_size, depth):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield table(b.column("graph_id"), begin, rows)
                        rows = []
                if rows:
                    yield table(b.column("graph_id"), begin, rows)

    return run


def hierarchy(graphs: DataFrame, method: str = "spectral", min_size: int = MIN_SIZE, depth: int | None = None) -> DataFrame:
    """parts of all levels, or of no more than `depth` below the whole graph. Parts of min_size nodes or more are split; a part that its
    method doesn't split stays a leaf. Children are numbered by their first node. A graph's parts follow from its row alone, so all
    its levels are found where the row is, once, and staged; graphs are dealt to tasks by their id."""
    lean = graphs.select("graph_id", F.greatest(F.size("ids"), F.lit(0)).alias("n"), F.col("edges").cast(EDGES).alias("edges"))
    kind = graphs.schema["graph_id"].dataType.simpleString()
    schema = f"graph_id {kind}, path array<int>, nodes array<int>, edges {EDGES}, communities array<int>"
    tasks = 4 * graphs.sparkSession.sparkContext.defaultParallelism
    return staged(lean.repartition(tasks, "graph_id").mapInArrow(_hierarchies(method, min_size, depth), schema), "parts")


def leaves(parts: DataFrame) -> DataFrame:
    return parts.where("communities IS NULL")


def _across(batches):
    """What _pairs gives of a batch of inner parts, each node and edge found by arrays over the whole batch."""
    for b in batches:
        sizes, at = (np.diff(b.column(c).offsets.to_numpy()) for c in ("nodes", "edges"))
        node, child = b.column("nodes").flatten().to_numpy(), b.column("communities").flatten().to_numpy().astype(np.int64)
        u, v, told = b.column("edges").flatten().flatten()
        u, v, label = u.to_numpy(), v.to_numpy(), told.fill_null(-(1 << 31)).to_numpy()
        row, held = np.repeat(np.arange(b.num_rows), sizes), np.repeat(np.arange(b.num_rows), at)
        # nodes by part and child, each in order, and where each child begins
        order = np.lexsort((child, row))
        sorted_nodes = pa.array(node[order])
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[order][1:] != row[order][:-1]) | (child[order][1:] != child[order][:-1])
        begins = np.flatnonzero(fresh)
        group = np.empty(len(row), dtype=np.int64)
        group[order] = np.cumsum(fresh) - 1
        place = np.empty(len(row), dtype=np.int64)
        place[order] = np.arange(len(row)) - begins[group[order]]
        # nodes of a part are found by their number; their order in it may be any
        span = int(max(node.max(initial=0), u.max(initial=0), v.max(initial=0))) + 1
        known = row * span + node
        by = np.argsort(known)
        x, y = (by[np.searchsorted(known, held * span + e, sorter=by)] for e in (u, v))
        cross = child[x] != child[y]
        x, y, label, told = x[cross], y[cross], label[cross], told.filter(pa.array(cross))
        x, y = np.where(child[x] < child[y], x, y), np.where(child[x] < child[y], y, x)
        order = np.lexsort((label, place[y], place[x], group[y], group[x]))
        x, y, told = x[order], y[order], told.take(pa.array(order))
        first = np.ones(len(x), dtype=bool)
        first[1:] = (group[x][1:] != group[x][:-1]) | (group[y][1:] != group[y][:-1])
        first = np.flatnonzero(first)
        pairs = pa.StructArray.from_arrays([*(pa.array(c.astype(np.int32)) for c in (place[x], place[y])), told], names=["a", "b", "label"])
        pairs = pa.ListArray.from_arrays(pa.array(np.append(first, len(x)).astype(np.int32)), pairs)
        child_nodes = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)).astype(np.int32)), sorted_nodes)
        own = pa.array(row[x[first]])
        columns = [b.column("graph_id").take(own), b.column("path").take(own), *(pa.array(child[e[first]].astype(np.int32)) for e in (x, y)), *(child_nodes.take(pa.array(group[e[first]])) for e in (x, y)), pairs]
        yield pa.RecordBatch.from_arrays(columns, names=["graph_id", "path", "left", "right", "left_nodes", "right_nodes", "pairs"])


def _pairs(parts: DataFrame) -> DataFrame:
    """bipartites with left_nodes and right_nodes, the children's nodes. They follow from the parent's row alone."""
    inner = parts.where("communities IS NOT NULL").select("graph_id", "path", "nodes", F.col("edges").cast(EDGES).alias("edges"), "communities")
    kind = parts.schema["graph_id"].dataType.simpleString()
    return inner.mapInArrow(_across, f"graph_id {kind}, path array<int>, left int, right int, left_nodes array<int>, right_nodes array<int>, pairs array<struct<a: int, b: int, label: int>>")


def bipartites(parts: DataFrame) -> DataFrame:
    """(graph_id, path, left, right, pairs): of each inner part, for children left < right, the edges between them as struct
    (a, b, label): places in the children's nodes, in order."""
    return _pairs(parts).select("graph_id", "path", "left", "right", "pairs")


def reconstruct(parts: DataFrame) -> DataFrame:
    """(graph_id, u, v, label): the edges inside leaves and, of all inner parts, those between children, as places in the graph."""
    inside = leaves(parts).select("graph_id", F.inline("edges"))
    across = _pairs(parts).select("graph_id", "left_nodes", "right_nodes", F.inline("pairs")).select("graph_id", F.get("left_nodes", "a").alias("x"), F.get("right_nodes", "b").alias("y"), "label")
    return inside.unionByName(across.select("graph_id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "label"))


def named(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph_id, src, dst, label): places become node ids."""
    met = edges.join(graphs.select("graph_id", "ids"), "graph_id")
    return met.select("graph_id", F.get("ids", "u").alias("src"), F.get("ids", "v").alias("dst"), "label")


def level_sizes(parts: DataFrame) -> DataFrame:
    """(graph_id, level, parts, nodes, largest)."""
    n = F.size("nodes").cast("long")
    return parts.groupBy("graph_id", F.size("path").cast("long").alias("level")).agg(F.count("*").alias("parts"), F.sum(n).alias("nodes"), F.max(n).alias("largest"))


# ---------------------------------------------------------------- motifs


def motif_communities(graphs: DataFrame, matches: DataFrame, alpha: float = 1.0) -> DataFrame:
    """matches: graph_id, atoms (places). (graph_id, communities, cohesion): spectral communities of the adjacency and alpha times the
    affinities, how many matches two nodes share, while modularity judges the plain graph; and the share of matches that lie in one
    community, 1 where there are none."""
    held = matches.groupBy("graph_id").agg(F.collect_list("atoms").alias("motifs"))
    lean = graphs.select("graph_id", F.size("ids").alias("n"), "edges").join(held, "graph_id", "left")

    def run(frames):
        for f in frames:
            parts, shares = [], []
            for n, edges, motifs in zip(f.n, f.edges, f.motifs, strict=True):
                motifs = [[int(x) for x in a] for a in motifs] if motifs is not None else []
                more = np.zeros((n, n))
                for a in motifs:
                    more[np.ix_(a, a)] += 1
                np.fill_diagonal(more, 0)
                found = [int(c) for c in kernels.spectral_partition(int(n), {(int(e["u"]), int(e["v"])) for e in edges}, more=more, alpha=alpha)]
                first: dict[int, int] = {}
                parts.append([first.setdefault(c, len(first)) for c in found])
                shares.append(float(np.mean([len({found[x] for x in a}) <= 1 for a in motifs])) if motifs else 1.0)
            yield pd.DataFrame({"graph_id": f.graph_id, "communities": parts, "cohesion": shares})

    return lean.mapInPandas(run, f"graph_id {graphs.schema['graph_id'].dataType.simpleString()}, communities array<int>, cohesion double")
