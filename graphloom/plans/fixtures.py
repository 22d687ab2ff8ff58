"""Queries over small graphs and molecules whose results are known by hand. The oracles are those results, written out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.tokens import render, vocab_size
from graphloom.operators import hierarchy as h
from graphloom.operators import kernels
from graphloom.operators import molecules as m
from graphloom.operators import runs as r

GRAPHS = {
    "triangle": (3, "0-1 1-2 0-2"),
    "square": (4, "0-1 1-2 2-3 0-3"),
    "star5": (6, "0-1 0-2 0-3 0-4 0-5"),
    "two_triangles": (6, "0-1 1-2 0-2 3-4 4-5 3-5 2-3"),
    "path5": (5, "0-1 1-2 2-3 3-4"),
    "disconnected": (4, "0-1 2-3"),
    "empty5": (5, ""),
}
CLIQUES = {
    "two_triangles": (6, "0-1 1-2 0-2 3-4 4-5 3-5 2-3"),
    "three_cliques": (12, "0-1 0-2 0-3 1-2 1-3 2-3 4-5 4-6 4-7 5-6 5-7 6-7 8-9 8-10 8-11 9-10 9-11 10-11 3-4 7-8 0-11"),
}
MOLECULES = {
    "aspirin": "CC(=O)OC1=CC=CC=C1C(=O)O",
    "benzene": "c1ccccc1",
    "toluene": "Cc1ccccc1",
    "p_xylene": "Cc1ccc(C)cc1",
    "o_xylene": "Cc1ccccc1C",
    "m_xylene": "Cc1cccc(C)c1",
    "phenol": "Oc1ccccc1",
    "ethanol": "CCO",
    "ethanol_2": "OCC",
    "ethanol_3": "C(C)O",
    "naphthalene": "c1ccc2ccccc2c1",
    "cyclohexane": "C1CCCCC1",
    "open_ring": "C1CC",
    "empty": "",
}


def _edges(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, e.split("-"))) for e in text.split()]


def graphs(spark: SparkSession, table: dict) -> DataFrame:
    return spark.createDataFrame([(g, n, _edges(e)) for g, (n, e) in table.items()], "graph_id string, num_nodes int, edges array<struct<u:int,v:int>>")


def edges(spark: SparkSession, table: dict) -> DataFrame:
    return spark.createDataFrame([(g, u, v) for g, (_, e) in table.items() for u, v in _edges(e)], "graph_id string, src int, dst int")


def molecules(spark: SparkSession, names=None) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, s in MOLECULES.items() if names is None or k in names], "mol_id string, smiles string")


def _lists(df: DataFrame, fn: Callable[[int, set], list[int]]) -> DataFrame:
    """(graph_id, found): fn of each graph as text."""

    def run(frames):
        for frame in frames:
            yield frame.assign(found=[" ".join(map(str, fn(n, {(int(e["u"]), int(e["v"])) for e in held}))) for n, held in zip(frame.num_nodes, frame.edges, strict=True)])[["graph_id", "found"]]

    return df.mapInPandas(run, "graph_id string, found string")


def _least_names(part) -> list[int]:
    part = list(part)
    return [part.index(c) for c in part]


def _parts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("two_triangles", 0, [2, 0, 1]), ("two_triangles", 1, [3, 4, 5]), ("path5", 0, [0, 1]), ("path5", 1, [2]), ("path5", 2, [4, 3])], "graph_id string, part_id int, nodes array<int>")


def _table(names: list[str], rows: list[tuple], types: dict[str, str] | None = None) -> str:
    """SQL of a table of given rows."""

    def say(x):
        if x is None:
            return "NULL"
        return str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    shown = ", ".join(f'"{n}"::{types[n]} AS "{n}"' if types and n in types else f'"{n}"' for n in names)
    quoted = ", ".join(f'"{n}"' for n in names)
    return f"SELECT {shown} FROM (VALUES {', '.join('(' + ', '.join(map(say, row)) + ')' for row in rows)}) AS t({quoted})"


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


_ORDERS = {
    "BFS": ["0 1 2", "0 1 3 2", "0 1 2 3 4 5", "2 0 1 3 4 5", "1 0 2 3 4", "0 1 2 3", "0 1 2 3 4"],
    "DFS": ["0 1 2", "0 1 2 3", "0 1 2 3 4 5", "2 0 1 3 4 5", "1 0 2 3 4", "0 1 2 3", "0 1 2 3 4"],
    "BFSAC": ["0 1 2", "0 1 3 2", "0 1 2 3 4 5", "2 3 0 4 1 5", "1 2 3 0 4", "0 1 2 3", "0 1 2 3 4"],
    "BFSDC": ["0 1 2", "0 1 3 2", "1 0 2 3 4 5", "0 1 2 3 4 5", "0 1 2 3 4", "0 1 2 3", "0 1 2 3 4"],
}
_COMMUNITIES = [("two_triangles", "0 0 0 3 3 3"), ("three_cliques", "0 0 0 0 4 4 4 4 8 8 8 8")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def _add(name: str, query: Query, oracle: str) -> None:
    QUERIES[name] = (query, oracle)


for _m, _found in _ORDERS.items():
    _add(f"order_{_m.lower()}", lambda s, d, k=_m: _lists(graphs(s, GRAPHS), lambda n, e: kernels.order(n, e, k)), _table(["graph_id", "found"], list(zip(GRAPHS, _found, strict=True))))
def _by_weight(n: int, e: set):
    """Edges between the cliques weigh 1, those inside 2."""
    size = 3 if n == 6 else 4
    return kernels.affinity_partition(n, e, {(u, v): 2.0 if u // size == v // size else 1.0 for u, v in e})


for _m, _fn in (("spectral", kernels.spectral_partition), ("affinity", _by_weight)):
    _add(f"{_m}_communities", lambda s, d, f=_fn: _lists(graphs(s, CLIQUES), lambda n, e: _least_names(f(n, e))), _table(["graph_id", "found"], _COMMUNITIES))

_add(
    "part_internal_edges",
    lambda s, d: h.internal_edges(edges(s, GRAPHS), _parts(s)).select("graph_id", "part_id", "src", "dst", "src_local", "dst_local"),
    _table(["graph_id", "part_id", "src", "dst", "src_local", "dst_local"], [("two_triangles", 0, 0, 1, 1, 2), ("two_triangles", 0, 1, 2, 2, 0), ("two_triangles", 0, 0, 2, 1, 0), ("two_triangles", 1, 3, 4, 0, 1), ("two_triangles", 1, 4, 5, 1, 2), ("two_triangles", 1, 3, 5, 0, 2), ("path5", 0, 0, 1, 0, 1), ("path5", 2, 3, 4, 1, 0)]),
)
_add("part_bipartites", lambda s, d: h.bipartites(edges(s, GRAPHS), _parts(s)), _table(["graph_id", "left_part", "right_part", "left_local", "right_local"], [("two_triangles", 0, 1, 0, 0), ("path5", 0, 1, 1, 0), ("path5", 1, 2, 0, 1)]))
_add(
    "part_reconstruct",
    lambda s, d: h.reconstruct(h.internal_edges(edges(s, GRAPHS), _parts(s)), h.bipartites(edges(s, GRAPHS), _parts(s)), _parts(s)),
    _table(["graph_id", "src", "dst"], [(g, u, v) for g in ("two_triangles", "path5") for u, v in _edges(GRAPHS[g][1])]),
)
_add(
    "part_super_edges",
    lambda s, d: h.super_edges(edges(s, GRAPHS).withColumn("label", F.col("src") % 3), _parts(s)),
    _table(["graph_id", "left_part", "right_part", "left", "right", "label"], [("two_triangles", 0, 1, 2, 3, 2), ("path5", 0, 1, 1, 2, 1), ("path5", 1, 2, 2, 3, 2)]),
)
_add("graph_adjacency", lambda s, d: h.adjacency(edges(s, GRAPHS)).where("graph_id in ('path5', 'square')").select("graph_id", "node", _text("neighbours").alias("neighbours")), _table(["graph_id", "node", "neighbours"], [("path5", 0, "1"), ("path5", 1, "0 2"), ("path5", 2, "1 3"), ("path5", 3, "2 4"), ("path5", 4, "3"), ("square", 0, "1 3"), ("square", 1, "0 2"), ("square", 2, "1 3"), ("square", 3, "0 2")]))
_add("graph_empty_hierarchy", lambda s, d: h.empty_hierarchy(graphs(s, GRAPHS)).select("graph_id", "part_id", F.size("nodes").alias("n"), _text("nodes").alias("nodes")).where("n < 4"), _table(["graph_id", "part_id", "n", "nodes"], [("triangle", 0, 3, "0 1 2")]))


def _levels(spark):
    return spark.createDataFrame([("g", [0], [0, 1, 2]), ("g", [1], [3, 4]), ("g", [0, 0], [0]), ("g", [0, 1], [1, 2]), ("k", [0], [0])], "graph_id string, path array<int>, nodes array<int>")


_add("hierarchy_levels", lambda s, d: h.level_info(_levels(s)).select("graph_id", "level", "parts", _text("sizes").alias("sizes")), _table(["graph_id", "level", "parts", "sizes"], [("g", 0, 2, "3 2"), ("g", 1, 2, "1 2"), ("k", 0, 1, "1")]))
_add("hierarchy_depth", lambda s, d: h.depth(_levels(s)), _table(["graph_id", "depth"], [("g", 2), ("k", 1)]))


def _motif_communities(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(9)] + [("k", i) for i in range(3)], "graph_id string, node long")
    matches = spark.createDataFrame([("g", [0, 1, 2]), ("g", [2, 3]), ("g", [5, 6]), ("k", [1, 2])], "graph_id string, atoms array<long>")
    return h.motif_communities(nodes, matches)


_add("motif_communities", lambda s, d: _motif_communities(s), _table(["graph_id", "node", "community"], [("g", n, c) for n, c in enumerate([0, 0, 0, 0, 1, 2, 2, 3, 4])] + [("k", 0, 0), ("k", 1, 1), ("k", 2, 1)]))
_add(
    "singleton_merge",
    lambda s, d: h.merge_singletons(_motif_communities(s), s.createDataFrame([("g", 3, 4), ("g", 4, 5), ("g", 7, 4), ("g", 8, 6), ("k", 0, 2)], "graph_id string, src long, dst long")),
    _table(["graph_id", "node", "community"], [("g", n, c) for n, c in enumerate([0, 0, 0, 0, 0, 2, 2, 3, 2])] + [("k", 0, 1), ("k", 1, 1), ("k", 2, 1)]),
)

# molecules
_add("mol_atoms", lambda s, d: m.atoms(molecules(s, ["phenol"])), _table(["mol_id", "idx", "label", "number", "charge", "hydrogens", "aromatic", "in_ring", "degree"], [("phenol", 0, 2, 8, 0, 1, False, False, 1), ("phenol", 1, 0, 6, 0, 0, True, True, 3), *[("phenol", i, 0, 6, 0, 1, True, True, 2) for i in range(2, 7)]]))
_add("mol_bonds", lambda s, d: m.bonds(molecules(s, ["ethanol", "toluene"])), _table(["mol_id", "src", "dst", "label", "in_ring"], [("ethanol", 0, 1, 0, False), ("ethanol", 1, 2, 0, False), ("toluene", 0, 1, 0, False), ("toluene", 1, 2, 3, True), ("toluene", 2, 3, 3, True), ("toluene", 3, 4, 3, True), ("toluene", 4, 5, 3, True), ("toluene", 5, 6, 3, True), ("toluene", 1, 6, 3, True)]))
_add("mol_quality", lambda s, d: m.quality(molecules(s), molecules(s, ["ethanol", "phenol"])).select(*[F.round(c, 6).alias(c) for c in ("validity", "uniqueness", "novelty")]), "SELECT round(12 / 14.0, 6)::DOUBLE AS validity, round(10 / 12.0, 6)::DOUBLE AS uniqueness, round(8 / 12.0, 6)::DOUBLE AS novelty")
_add("mol_functional_groups", lambda s, d: m.functional_groups(molecules(s, ["aspirin", "phenol", "naphthalene"])).select("mol_id", "motif", "ptype", _text("atoms").alias("atoms")), _table(["mol_id", "motif", "ptype", "atoms"], [("aspirin", "benzene", "ring", "4 5 6 7 8 9"), ("aspirin", "carboxyl", "multi_atom", "10 11 12"), ("aspirin", "methyl", "single_atom", "0"), ("phenol", "benzene", "ring", "1 2 3 4 5 6"), ("phenol", "hydroxyl", "single_atom", "0"), ("naphthalene", "naphthalene", "ring", "0 1 2 3 4 5 6 7 8 9")]))
_add("mol_communities", lambda s, d: m.functional_communities(molecules(s, ["aspirin"])).select("mol_id", "community", "ctype", "name", _text("atoms").alias("atoms")), _table(["mol_id", "community", "ctype", "name", "atoms"], [("aspirin", 0, "ring", "benzene", "4 5 6 7 8 9"), ("aspirin", 1, "functional", "carboxyl", "10 11 12"), ("aspirin", 2, "functional", "methyl", "0"), ("aspirin", 3, "singleton", "singleton", "1"), ("aspirin", 4, "singleton", "singleton", "2"), ("aspirin", 5, "singleton", "singleton", "3")]))
_add("mol_motif_filter", lambda s, d: m.containing(molecules(s), "[OX2H]").select("mol_id"), _table(["mol_id"], [(x,) for x in ("aspirin", "phenol", "ethanol", "ethanol_2", "ethanol_3")]))
_add("mol_motif_vectors", lambda s, d: m.vectors(m.motif_counts(molecules(s, ["p_xylene", "phenol"]), {"methyl": "[CH3]", "ring": "c1ccccc1", "oh": "[OX2H]"}), ["methyl", "oh", "ring"]).select("mol_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), " ").alias("v")), _table(["mol_id", "v"], [("p_xylene", "2 0 1"), ("phenol", "0 1 1")]))
_add("mol_substitution", lambda s, d: m.substitution(molecules(s)), _table(["mol_id", "substituents", "pattern"], [("aspirin", 2, "ortho"), ("benzene", 0, None), ("toluene", 1, None), ("p_xylene", 2, "para"), ("o_xylene", 2, "ortho"), ("m_xylene", 2, "meta"), ("phenol", 1, None), ("naphthalene", 2, "ortho")]))
_add("mol_substitution_histogram", lambda s, d: m.substitution_histogram(molecules(s)), _table(["substituents", "pattern", "n"], [(0, None, 1), (1, None, 2), (2, "ortho", 3), (2, "meta", 1), (2, "para", 1)]))
_add("mol_ring_info", lambda s, d: m.ring_info(molecules(s, ["naphthalene", "cyclohexane", "ethanol"])).select("mol_id", "rings", "aromatic_rings", _text("sizes").alias("sizes")), _table(["mol_id", "rings", "aromatic_rings", "sizes"], [("naphthalene", 2, 2, "6 6"), ("cyclohexane", 1, 0, "6"), ("ethanol", 0, 0, "")]))
_add("mol_complexity", lambda s, d: m.complexity(molecules(s, ["aspirin", "ethanol", "naphthalene"])), _table(["mol_id", "atoms", "bonds", "rings", "aromatic_rings", "rotatable", "scaffold_atoms"], [("aspirin", 13, 13, 1, 1, 3, 6), ("ethanol", 3, 2, 0, 0, 0, 0), ("naphthalene", 10, 11, 2, 2, 0, 10)]))
_add("mol_atom_roles", lambda s, d: m.atom_roles(molecules(s, ["toluene", "ethanol"])), _table(["mol_id", "idx", "role"], [("toluene", 0, "chain_boundary"), ("toluene", 1, "ring_boundary"), *[("toluene", i, "ring_interior") for i in range(2, 7)], *[("ethanol", i, "chain_interior") for i in range(3)]]))
_add("mol_scaffold_groups", lambda s, d: m.scaffolds(molecules(s)).groupBy("scaffold").agg(F.array_join(F.array_sort(F.collect_list("mol_id")), " ").alias("mols")).select("mols"), _table(["mols"], [("aspirin benzene m_xylene o_xylene p_xylene phenol toluene",), ("naphthalene",), ("cyclohexane",)]))
_add("mol_scaffold_cosine", lambda s, d: m.cosine(m.scaffolds(molecules(s)), m.scaffolds(molecules(s, ["benzene", "naphthalene"])), "scaffold").select(F.round("cosine", 6).alias("cosine")), "SELECT round(8 / (sqrt(51.0) * sqrt(2.0)), 6)::DOUBLE AS cosine")
_add("mol_snn", lambda s, d: m.snn(molecules(s, ["ethanol", "phenol"]), molecules(s)), "SELECT 1.0::DOUBLE AS snn")
_add(
    "mol_valence",
    lambda s, d: m.valence_violations(s.createDataFrame([("x", i, l) for i, l in enumerate([0, 2, 2, 2, 2, 1])], "mol_id string, idx int, label int"), s.createDataFrame([("x", 0, 1, 1), ("x", 0, 2, 1), ("x", 0, 3, 0), ("x", 3, 4, 0), ("x", 4, 5, 0)], "mol_id string, src int, dst int, label int")),
    _table(["mol_id", "idx", "label", "used", "allowed"], [("x", 0, 0, 5.0, 4)], {"used": "DOUBLE"}),
)
_add("graph_to_smiles", lambda s, d: m.graphs_to_smiles(m.atoms(molecules(s, ["p_xylene", "ethanol_2", "aspirin"])), m.bonds(molecules(s, ["p_xylene", "ethanol_2", "aspirin"]))).join(molecules(s).select("mol_id", m.canonical("smiles").alias("direct")), "mol_id").select("mol_id", (F.col("smiles") == F.col("direct")).alias("same")), _table(["mol_id", "same"], [("p_xylene", True), ("ethanol_2", True), ("aspirin", True)]))
_add(
    "frechet_moments",
    lambda s, d: m.frechet(*[s.read.parquet(f"{d}/embeddings.parquet").where(f"vec_id % 2 = {k}").select(F.col("embedding").cast("array<double>").alias("v")) for k in (0, 1)]).select(*[F.round(c, 9).alias(c) for c in ("means", "deviations", "distance")]),
    """WITH x AS (SELECT vec_id % 2 AS side, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), y AS (SELECT side, pos, avg(x) AS m, stddev_pop(x) AS d FROM x GROUP BY side, pos)
    SELECT round(sum((a.m - b.m) ** 2), 9) AS means, round(sum((a.d - b.d) ** 2), 9) AS deviations, round(sum((a.m - b.m) ** 2 + (a.d - b.d) ** 2), 9) AS distance FROM y a JOIN y b ON a.pos = b.pos AND a.side = 0 AND b.side = 1""",
)

# runs and tokens
_add(
    "run_latest_match",
    lambda s, d: r.latest_match(s.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "checkpoint string, test int"), s.createDataFrame([("a", 5, 0.5), ("a", 9, 0.25), ("b", 1, None)], "checkpoint string, mtime int, score double"), names=("score",)),
    _table(["checkpoint", "test", "score"], [("a", 1, 0.25), ("b", 2, None), ("c", 3, None)], {"score": "DOUBLE"}),
)
_add("run_best", lambda s, d: r.best(s.createDataFrame([("x", "r1", 0.5), ("x", "r2", -1.0), ("x", "r3", 0.25), ("y", "r4", None), ("y", "r5", 3.0)], "scheme string, run string, fcd double"), "scheme", "fcd"), _table(["scheme", "run", "fcd"], [("x", "r3", 0.25), ("y", "r5", 3.0)], {"fcd": "DOUBLE"}))
_add("run_pivot", lambda s, d: r.pivot(s.createDataFrame([("a", "fcd", 1.5), ("a", "snn", 0.5), ("b", "snn", 0.75)], "run_id string, metric string, value double"), ["fcd", "snn"]), _table(["run_id", "fcd", "snn"], [("a", 1.5, 0.5), ("b", None, 0.75)], {"fcd": "DOUBLE", "snn": "DOUBLE"}))
_add("run_info", lambda s, d: s.createDataFrame([("moses_hsent_spectral_n1000_x",), ("qm9_sent",)], "name string").select("name", r.run_info(F.col("name")).alias("i")).select("name", "i.*"), _table(["name", "scheme", "coarsening", "samples"], [("moses_hsent_spectral_n1000_x", "hsent", "spectral", 1000), ("qm9_sent", "sent", None, None)]))
_add(
    "run_lineage",
    lambda s, d: r.lineage(s.createDataFrame([("a", None, {"lr": "1", "k": "2"}), ("b", "a", {"lr": "3"}), ("c", "b", {"seed": "4"})], "run_id string, parent string, settings map<string,string>")).select("run_id", F.array_join(F.transform(F.array_sort(F.map_entries("settings")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ").alias("settings")),
    _table(["run_id", "settings"], [("a", "k=2 lr=1"), ("b", "k=2 lr=3"), ("c", "k=2 lr=3 seed=4")]),
)
_add("token_render", lambda s, d: s.createDataFrame([("hdt", [0, 3, 7, 7, 3, 8, 9, 7, 8, 5, 7, 6, 4, 4, 1])], "scheme string, tokens array<int>").select("scheme", render(F.col("tokens"), "hdt").alias("shown")), _table(["scheme", "shown"], [("hdt", "[SOS] [ENTER] L0:0 [ENTER] L1:2 0 1 [LEDGE] 0 [REDGE] [EXIT] [EXIT] [EOS]")]))
_add("token_vocab", lambda s, d: s.range(1).select(vocab_size(F.lit(38), "flat").alias("flat"), vocab_size(F.lit(38), "hdt", True).alias("hdt"), vocab_size(F.lit(38), "hsent", True).alias("hsent"), vocab_size(F.lit(38), "hdtc", True).alias("hdtc")), "SELECT 44 AS flat, 60 AS hdt, 64 AS hsent, 65 AS hdtc")


def fixture_queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in QUERIES.items()}


def fixture_oracles() -> dict[str, str]:
    return {k: o for k, (_, o) in QUERIES.items()}
