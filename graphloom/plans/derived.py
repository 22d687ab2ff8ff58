"""Molecules, partitions, runs and token sequences that follow from the sales tables, so that their queries grow with them.

Molecules: a chain an order. Each line adds a piece by its part's kind: ECONOMY C, LARGE a ring with places para and C, MEDIUM N, PROMO
a carbonyl, SMALL O, STANDARD CC. Orders of status P begin with a ring that doesn't close and are no molecules; F orders are the
reference side. A chain read backwards is the same molecule, so what a query tells of it follows from the letters (C, P, N, K, O) of its
pieces: the oracles count letters. Graphs are those of graphloom.plans.baskets, with parts of one kind as partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.tokens import render, vocab_size
from graphloom.operators import graphs as g
from graphloom.operators import hierarchy as h
from graphloom.operators import levels
from graphloom.operators import molecules as m
from graphloom.operators import runs as r
from graphloom.plans.baskets import _BASKETS, _read, basket_graphs
from graphloom.sources.staging import staged

PIECES = {"ECONOMY": "C", "LARGE": "c1ccc(cc1)C", "MEDIUM": "N", "PROMO": "C(=O)", "SMALL": "O", "STANDARD": "CC"}
LETTERS = {"ECONOMY": "C", "LARGE": "PC", "MEDIUM": "N", "PROMO": "K", "SMALL": "O", "STANDARD": "CC"}

Query = Callable[[SparkSession, str], DataFrame]


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# ---------------------------------------------------------------- molecules


def chains(spark: SparkSession, sf_dir: str, status: str = "OF") -> DataFrame:
    """mol_id, smiles of the orders of some status, staged."""
    return sides(spark, sf_dir, status)[0]


def sides(spark: SparkSession, sf_dir: str, *statuses: str) -> list[DataFrame]:
    """mol_id, smiles of the orders of some status, for each of several; staged once, all together."""
    piece = F.create_map(*[x for k, v in PIECES.items() for x in (F.lit(k), F.lit(v))])
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), piece[F.col("p_type")].alias("piece"))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey")
    told = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "piece"))), lambda x: x["piece"]), "").alias("chain"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").where(F.col("o_orderstatus").isin(*"".join(statuses)))
    every = staged(told.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("mol_id"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("C1"), "chain")).otherwise(F.col("chain")).alias("smiles"), "o_orderstatus"), "chains")
    return [every.where(F.col("o_orderstatus").isin(*x)).select("mol_id", "smiles") for x in statuses]


def on_chains(work: Callable[[DataFrame], DataFrame]) -> Query:
    """work on the molecules, once for each different string."""
    return lambda s, d: m.once_a_string(work)(chains(s, d))


_LETTER = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LETTERS.items()) + " END"
_CHAINS = f"""w AS (SELECT l_orderkey AS mol_id, o_orderstatus AS status, string_agg({_LETTER}, '' ORDER BY l_linenumber, l_partkey) AS w FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
  x AS (SELECT mol_id, status, w, least(w, reverse(w)) AS canon, len(w) AS n, len(w) - len(replace(w, 'P', '')) AS p, len(w) - len(replace(w, 'K', '')) AS k, len(w) - len(replace(w, 'N', '')) AS nn, len(w) - len(replace(w, 'O', '')) AS o,
    len(w) - len(replace(w, 'C', '')) AS c, strpos(w, 'P') AS first, len(w) + 1 - strpos(reverse(w), 'P') AS last FROM w),
  mol AS (SELECT * FROM x WHERE status IN ('O', 'F')),
  side AS (SELECT mol_id, status, replace(w[first:last], 'K', 'C') AS s FROM mol WHERE p > 0),
  scaffold AS (SELECT status, least(s, reverse(s)) AS s, count(*) AS n FROM side GROUP BY ALL)"""


def _chain(text: str) -> str:
    return f"WITH {_CHAINS} {text}"


#: How many letters other than P stand next to one.
_BESIDE = "len(list_filter(range(1, n + 1), lambda i: w[i] <> 'P' AND (w[i - 1:i - 1] = 'P' AND i > 1 OR w[i + 1:i + 1] = 'P')))"
#: Whether the bond next to an end can turn: the end has other neighbours.
_ENDS = "(CASE WHEN w[1] IN ('K', 'P') THEN 0 ELSE 1 END), (CASE WHEN w[n:n] IN ('K', 'P') THEN 0 ELSE 1 END)"

MOLECULES: dict[str, tuple[Query, str]] = {
    "mol_quality": (
        lambda s, d: m.quality(chains(s, d, "OP"), chains(s, d, "F")).select(*[F.round(c, 9).alias(c) for c in ("validity", "uniqueness", "novelty")]),
        _chain("""SELECT round(avg(CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS validity, round(count(DISTINCT CASE WHEN status = 'O' THEN canon END) / count(*) FILTER (status = 'O')::DOUBLE, 9) AS uniqueness,
          round(count(*) FILTER (status = 'O' AND canon NOT IN (SELECT canon FROM x WHERE status = 'F')) / count(*) FILTER (status = 'O')::DOUBLE, 9) AS novelty FROM x WHERE status IN ('O', 'P')"""),
    ),
    "mol_atoms": (
        on_chains(lambda x: m.atoms(x).groupBy("mol_id").agg(F.count("*").alias("atoms"), F.sum("hydrogens").alias("hydrogens"), F.sum(F.col("aromatic").cast("long")).alias("aromatic"), F.sum(F.col("in_ring").cast("long")).alias("in_ring"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("carbon"), F.sum("charge").alias("charge"))),
        _chain("SELECT mol_id, n + k + 5 * p AS atoms, 2 + 2 * c + nn + 4 * p AS hydrogens, 6 * p AS aromatic, 6 * p AS in_ring, c + k + 6 * p AS carbon, 0::BIGINT AS charge FROM mol"),
    ),
    "mol_bonds": (
        on_chains(lambda x: m.bonds(x).groupBy("mol_id").agg(F.count("*").alias("bonds"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("double"), F.sum(F.when(F.col("label") == 3, 1).otherwise(0)).cast("long").alias("aromatic"), F.sum(F.col("in_ring").cast("long")).alias("in_ring"))),
        _chain("SELECT mol_id, n - 1 + k + 6 * p AS bonds, k AS double, 6 * p AS aromatic, 6 * p AS in_ring FROM mol WHERE n - 1 + k + 6 * p > 0"),
    ),
    "mol_functional_groups": (
        on_chains(lambda x: m.functional_groups(x).where("ptype = 'ring'").groupBy("mol_id", "motif").agg(F.count("*").alias("n"), F.sum(F.size("atoms")).alias("atoms"))),
        _chain("SELECT mol_id, 'benzene' AS motif, p AS n, 6 * p AS atoms FROM mol WHERE p > 0"),
    ),
    "mol_communities": (
        on_chains(lambda x: m.functional_communities(x).select("mol_id", "community", F.explode("atoms").alias("a")).groupBy("mol_id").agg(F.count("*").alias("atoms"), F.countDistinct("a").alias("distinct_atoms"))),
        _chain("SELECT mol_id, n + k + 5 * p AS atoms, n + k + 5 * p AS distinct_atoms FROM mol"),
    ),
    "mol_motif_filter": (
        lambda s, d: m.containing(chains(s, d), "[OX2H]").select("mol_id"),
        _chain("SELECT mol_id FROM mol WHERE n > 1 AND (w[1] = 'O' OR w[n:n] = 'O')"),
    ),
    "mol_motif_vectors": (
        on_chains(lambda x: m.vectors(m.motif_counts(x, {"carbonyl": "C=O", "nitrogen": "[#7]", "ring": "c1ccccc1"}), ["carbonyl", "nitrogen", "ring"]).select("mol_id", *[F.get("v", F.lit(i)).cast("long").alias(n) for i, n in enumerate(["carbonyl", "nitrogen", "ring"])])),
        _chain("SELECT mol_id, k AS carbonyl, nn AS nitrogen, p AS ring FROM mol WHERE k + nn + p > 0"),
    ),
    "mol_substitution": (
        lambda s, d: m.substitution(chains(s, d)),
        _chain("SELECT mol_id, (CASE WHEN first > 1 THEN 2 ELSE 1 END)::INTEGER AS substituents, CASE WHEN first > 1 THEN 'para' END AS pattern FROM mol WHERE p > 0"),
    ),
    "mol_substitution_histogram": (
        lambda s, d: m.substitution_histogram(chains(s, d)),
        _chain("SELECT (CASE WHEN first > 1 THEN 2 ELSE 1 END)::INTEGER AS substituents, CASE WHEN first > 1 THEN 'para' END AS pattern, count(*) AS n FROM mol WHERE p > 0 GROUP BY ALL"),
    ),
    "mol_ring_info": (
        lambda s, d: m.ring_info(chains(s, d)).select("mol_id", F.col("rings").cast("long").alias("rings"), F.col("aromatic_rings").cast("long").alias("aromatic_rings"), _text("sizes").alias("sizes")),
        _chain("SELECT mol_id, p AS rings, p AS aromatic_rings, rtrim(repeat('6 ', p)) AS sizes FROM mol"),
    ),
    "mol_complexity": (
        lambda s, d: m.complexity(chains(s, d)).select("mol_id", *[F.col(c).cast("long").alias(c) for c in ("atoms", "bonds", "rings", "aromatic_rings", "rotatable", "scaffold_atoms")]),
        _chain(f"""SELECT mol_id, n + k + 5 * p AS atoms, n - 1 + k + 6 * p AS bonds, p AS rings, p AS aromatic_rings, (CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 - greatest({_ENDS}) ELSE n - 1 - {_ENDS.replace("), (", ") - (")} END)::BIGINT AS rotatable,
          (CASE WHEN p = 0 THEN 0 ELSE last - first + 1 + 5 * p END)::BIGINT AS scaffold_atoms FROM mol"""),
    ),
    "mol_atom_roles": (
        on_chains(lambda x: m.atom_roles(x).groupBy("mol_id", "role").agg(F.count("*").alias("n"))),
        _chain(f"""SELECT mol_id, role, n::BIGINT AS n FROM (SELECT mol_id, unnest(['ring_boundary', 'ring_interior', 'chain_boundary', 'chain_interior']) AS role,
          unnest([2 * p - (w[1] = 'P')::INT, 4 * p + (w[1] = 'P')::INT, {_BESIDE}, n - p + k - {_BESIDE}]) AS n FROM mol) WHERE n > 0"""),
    ),
    "mol_scaffold_groups": (
        lambda s, d: m.scaffolds(chains(s, d)).groupBy("scaffold").agg(F.count("*").alias("mols")).select("mols"),
        _chain("SELECT sum(n)::BIGINT AS mols FROM scaffold GROUP BY s"),
    ),
    "mol_scaffold_cosine": (
        lambda s, d: m.cosine(m.scaffolds(chains(s, d, "O")), m.scaffolds(chains(s, d, "F")), "scaffold").select(F.round("cosine", 9).alias("cosine")),
        _chain("SELECT round(sum(a * b) / ((sqrt(sum(a * a)) + 1e-10) * (sqrt(sum(b * b)) + 1e-10)), 9)::DOUBLE AS cosine FROM (SELECT s, coalesce(sum(n) FILTER (status = 'O'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (status = 'F'), 0)::DOUBLE AS b FROM scaffold GROUP BY s)"),
    ),
    "graph_to_smiles": (
        on_chains(lambda x: m.graphs_to_smiles(m.atoms(x), m.bonds(x)).join(x.select("mol_id", m.canonical("smiles").alias("direct")), "mol_id").select("mol_id", (F.col("smiles") == F.col("direct")).alias("same"))),
        _chain("SELECT mol_id, true AS same FROM mol"),
    ),
}

# ---------------------------------------------------------------- graphs


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(basket_graphs(spark, sf_dir), "baskets")


def _edges(graphs: DataFrame) -> DataFrame:
    """graph_id, src, dst, label, each from its graph's row."""
    return graphs.select("graph_id", "ids", F.inline("edges")).select("graph_id", F.get("ids", "u").alias("src"), F.get("ids", "v").alias("dst"), "label")


def _kinds(graphs: DataFrame) -> DataFrame:
    """graph_id, part_id, nodes: parts of a kind."""
    at = graphs.select("graph_id", F.explode(F.arrays_zip("ids", "labels")).alias("x")).select("graph_id", "x.ids", F.col("x.labels").alias("part_id"))
    return at.groupBy("graph_id", "part_id").agg(F.array_sort(F.collect_list("ids")).alias("nodes"))


def _on_baskets(fn) -> Query:
    def run(spark, sf_dir):
        graphs = _graphs(spark, sf_dir)
        return fn(_edges(graphs), _kinds(graphs), graphs)

    return run


def _paths(parts: DataFrame) -> DataFrame:
    """Parts of a kind, and of four nodes or more their halves by even and odd places, as a hierarchy."""
    half = lambda k: F.filter("nodes", lambda x, i: i % 2 == k)
    top = parts.select("graph_id", F.array(F.col("part_id")).alias("path"), "nodes")
    inner = parts.where("size(nodes) >= 4").select("graph_id", "part_id", F.posexplode(F.array(half(0), half(1))).alias("k", "half"))
    return top.unionByName(inner.select("graph_id", F.array(F.col("part_id"), F.col("k")).alias("path"), F.col("half").alias("nodes")))


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of orders that share parts: each order is a match."""
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("atoms"))
    matches = lines.join(_read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("graph_id")), "o_orderkey").select("graph_id", "atoms")
    return staged(h.motif_communities(matches.select("graph_id", F.explode("atoms").alias("node")).distinct(), matches), "communities")


def _covered(method: str) -> Query:
    """Nodes in the graph's communities, and those counted once."""

    def run(spark, sf_dir):
        parts = levels.hierarchy(_graphs(spark, sf_dir), method, depth=1).where("size(path) = 0").withColumn("communities", F.coalesce("communities", F.transform("nodes", lambda _: F.lit(0))))
        n = F.size("nodes").cast("long")
        held = F.filter("communities", lambda c: (c >= 0) & (c <= F.array_max("communities")))
        return parts.select("graph_id", n.alias("nodes"), F.coalesce(F.size(held).cast("long"), n).alias("assigned"))

    return run


_SIDE = f"{_BASKETS}, sits AS (SELECT DISTINCT graph_id, p AS node, kind, row_number() OVER (PARTITION BY graph_id, kind ORDER BY p) - 1 AS place FROM (SELECT DISTINCT graph_id, p FROM l) JOIN kinds ON id = p)"
_ENDS_AT = f"{_SIDE}, e AS (SELECT e.*, x.kind AS sk, x.place::BIGINT AS sp, y.kind AS dk, y.place::BIGINT AS dp FROM edges e JOIN sits x ON x.graph_id = e.graph_id AND x.node = e.src JOIN sits y ON y.graph_id = e.graph_id AND y.node = e.dst)"
_CLOSURE = f"""{_BASKETS}, hubs AS (SELECT graph_id, o_orderkey, min(p) AS hub FROM l GROUP BY ALL), ways AS (SELECT DISTINCT l.graph_id, l.p AS a, hub AS b FROM l JOIN hubs USING (graph_id, o_orderkey)),
  both_ways AS (SELECT * FROM ways UNION SELECT graph_id, b, a FROM ways),
  reach AS (SELECT DISTINCT graph_id, a AS node, a AS root FROM both_ways UNION SELECT r.graph_id, r.node, w.b FROM reach r JOIN both_ways w ON w.graph_id = r.graph_id AND w.a = r.root),
  least_of AS (SELECT graph_id, node, min(root) AS root FROM reach GROUP BY graph_id, node),
  found AS (SELECT graph_id, node, (dense_rank() OVER (PARTITION BY graph_id ORDER BY root) - 1)::INTEGER AS community FROM least_of)"""
_SIZES = "(SELECT graph_id, kind, count(*) AS n FROM sits GROUP BY graph_id, kind)"

GRAPHS: dict[str, tuple[Query, str]] = {
    "part_internal_edges": (_on_baskets(lambda e, p, _: h.internal_edges(e, p)), f"WITH {_ENDS_AT} SELECT graph_id, sk AS part_id, src, dst, sp AS src_local, dp AS dst_local FROM e WHERE sk = dk"),
    "part_bipartites": (
        _on_baskets(lambda e, p, _: h.bipartites(e, p)),
        f"WITH {_ENDS_AT} SELECT DISTINCT graph_id, least(sk, dk) AS left_part, greatest(sk, dk) AS right_part, CASE WHEN sk < dk THEN sp ELSE dp END AS left_local, CASE WHEN sk < dk THEN dp ELSE sp END AS right_local FROM e WHERE sk <> dk",
    ),
    "part_reconstruct": (_on_baskets(lambda e, p, _: h.reconstruct(h.internal_edges(e, p), h.bipartites(e, p), p)), f"WITH {_BASKETS} SELECT graph_id, src, dst FROM edges"),
    "part_super_edges": (
        _on_baskets(lambda e, p, _: h.super_edges(e, p)),
        f'WITH {_ENDS_AT} SELECT graph_id, least(sk, dk) AS left_part, greatest(sk, dk) AS right_part, CASE WHEN sk < dk THEN src ELSE dst END AS "left", CASE WHEN sk < dk THEN dst ELSE src END AS "right", label FROM e WHERE sk <> dk',
    ),
    "graph_adjacency": (
        _on_baskets(lambda e, p, _: h.adjacency(e).select("graph_id", "node", _text("neighbours").alias("neighbours"))),
        f"WITH {_BASKETS}, b AS (SELECT graph_id, src AS a, dst AS b FROM edges UNION SELECT graph_id, dst, src FROM edges) SELECT graph_id, a AS node, string_agg(b::VARCHAR, ' ' ORDER BY b) AS neighbours FROM b GROUP BY graph_id, a",
    ),
    "graph_empty_hierarchy": (
        _on_baskets(lambda e, p, graphs: h.empty_hierarchy(graphs.select("graph_id", F.size("ids").alias("num_nodes"))).select("graph_id", "part_id", F.size("nodes").cast("long").alias("n"), _text("nodes").alias("nodes"))),
        f"WITH {_BASKETS}, n AS (SELECT graph_id, count(DISTINCT p) AS n FROM l GROUP BY graph_id) SELECT graph_id, 0 AS part_id, n, array_to_string(range(n), ' ') AS nodes FROM n",
    ),
    "hierarchy_levels": (
        _on_baskets(lambda e, p, _: h.level_info(_paths(p)).select("graph_id", F.col("level").cast("long").alias("level"), "parts", _text("sizes").alias("sizes"))),
        f"""WITH {_SIDE}, t AS (SELECT graph_id, 0 AS level, kind AS a, 0 AS b, n FROM {_SIZES} UNION ALL SELECT graph_id, 1, kind, k, CASE WHEN k = 0 THEN (n + 1) // 2 ELSE n // 2 END FROM {_SIZES} s, (SELECT unnest([0, 1]) AS k) WHERE n >= 4)
          SELECT graph_id, level::BIGINT AS level, count(*) AS parts, string_agg(n::VARCHAR, ' ' ORDER BY a, b) AS sizes FROM t GROUP BY graph_id, level""",
    ),
    "hierarchy_depth": (_on_baskets(lambda e, p, _: h.depth(_paths(p))), f"WITH {_SIDE} SELECT graph_id, CASE WHEN max(n) >= 4 THEN 2 ELSE 1 END AS depth FROM {_SIZES} GROUP BY graph_id"),
    "motif_communities": (lambda s, d: _communities(s, d), f"WITH RECURSIVE {_CLOSURE} SELECT graph_id, node, community FROM found"),
    "singleton_merge": (
        lambda s, d: h.merge_singletons(_communities(s, d), _edges(_graphs(s, d))),
        f"""WITH RECURSIVE {_CLOSURE}, sized AS (SELECT *, count(*) OVER (PARTITION BY graph_id, community) AS n FROM found), b AS (SELECT graph_id, src AS a, dst AS b FROM edges UNION SELECT graph_id, dst, src FROM edges),
          best AS (SELECT b.graph_id, b.a, arg_min(s.community, b.b) AS into_ FROM b JOIN sized s ON s.graph_id = b.graph_id AND s.node = b.b AND s.n > 1 GROUP BY b.graph_id, b.a)
          SELECT s.graph_id, s.node, CASE WHEN s.n = 1 THEN coalesce(into_, community) ELSE community END AS community FROM sized s LEFT JOIN best ON best.graph_id = s.graph_id AND best.a = s.node""",
    ),
    "spectral_communities": (_covered("spectral"), f"WITH {_BASKETS} SELECT graph_id, count(DISTINCT p) AS nodes, count(DISTINCT p) AS assigned FROM l GROUP BY graph_id"),
    "affinity_communities": (_covered("affinity"), f"WITH {_BASKETS} SELECT graph_id, count(DISTINCT p) AS nodes, count(DISTINCT p) AS assigned FROM l GROUP BY graph_id"),
    "mol_valence": (
        _on_baskets(lambda e, p, graphs: m.valence_violations(
            graphs.select(F.col("graph_id").alias("mol_id"), F.posexplode("labels").alias("idx", "label")),
            graphs.select(F.col("graph_id").alias("mol_id"), F.inline("edges")).withColumnsRenamed({"u": "src", "v": "dst"}),
        ).select("mol_id", F.col("idx").cast("long").alias("idx"), "label", "used", F.col("allowed").cast("double").alias("allowed"))),
        f"""WITH {_BASKETS}, sits AS (SELECT graph_id, p AS node, kind, row_number() OVER (PARTITION BY graph_id ORDER BY p) - 1 AS idx FROM (SELECT DISTINCT graph_id, p FROM l) JOIN kinds ON id = p),
          ends AS (SELECT graph_id, src AS node, label FROM edges UNION ALL SELECT graph_id, dst, label FROM edges),
          used AS (SELECT graph_id, node, sum([1.0, 2.0, 3.0, 1.5, 1.0][label + 1])::DOUBLE AS used FROM ends GROUP BY graph_id, node)
          SELECT a.graph_id AS mol_id, idx, kind AS label, used, [4.0, 3.0, 2.0, 1.0, 5.0, 6.0][kind + 1]::DOUBLE AS allowed FROM sits a JOIN used u ON u.graph_id = a.graph_id AND u.node = a.node WHERE used > [4.0, 3.0, 2.0, 1.0, 5.0, 6.0][kind + 1]""",
    ),
}

# ---------------------------------------------------------------- traversals, held against recursive SQL

_USERS = """ev AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, event_id, ts FROM events),
  step AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS b FROM ev),
  e AS (SELECT DISTINCT user_id, a, b FROM (SELECT user_id, a, b FROM step UNION ALL SELECT user_id, b, a FROM step) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
  node AS (SELECT user_id, a AS v, (row_number() OVER (PARTITION BY user_id ORDER BY a) - 1)::INTEGER AS i FROM (SELECT DISTINCT user_id, a FROM e)),
  row_ AS (SELECT x.user_id, x.i, list(y.i ORDER BY y.i) AS near FROM e JOIN node x ON x.user_id = e.user_id AND x.v = e.a JOIN node y ON y.user_id = e.user_id AND y.v = e.b GROUP BY x.user_id, x.i),
  g AS (SELECT user_id, count(*) AS n, list(near ORDER BY i) AS adj, arg_min(i, struct_pack(a := -len(near), b := i)) AS s FROM row_ GROUP BY user_id)"""
_SEEN = "SELECT t.user_id AS graph_id, t.pos, node.v AS node FROM (SELECT user_id, generate_subscripts(o, 1)::BIGINT AS pos, unnest(o) AS i FROM whole) t JOIN node ON node.user_id = t.user_id AND node.i = t.i"
_REST = "whole AS (SELECT user_id, o || list_filter(range(n)::INTEGER[], lambda x: NOT list_contains(o, x)) AS o FROM done)"


def _cut_order(sign: int) -> str:
    """The next node of the frontier: by cut edges, then degree, then arrival; an empty frontier gets the best node left."""
    start = f"list_sort(list_transform(list_filter(range(n)::INTEGER[], lambda x: NOT list_contains(o, x)), lambda x: struct_pack(a := {-sign} * len(adj[x + 1]), b := x)))[1].b"
    pick = f"list_sort(list_transform(range(1, len(fr) + 1), lambda k: struct_pack(a := {sign} * len(list_intersect(adj[fr[k] + 1], o)), b := {-sign} * len(adj[fr[k] + 1]), c := k)))[1].c"
    return f"""WITH RECURSIVE {_USERS},
      r(user_id, n, adj, o, fr) AS (SELECT user_id, n, adj, CAST([] AS INTEGER[]), [s] FROM (SELECT user_id, n, adj, {start.replace("NOT list_contains(o, x)", "true")} AS s FROM g)
        UNION ALL SELECT user_id, n, adj, CASE WHEN x IS NULL THEN o ELSE o || [x] END,
          CASE WHEN x IS NULL THEN [{start}] ELSE list_filter(fr, lambda y: y <> x) || list_filter(adj[x + 1], lambda y: NOT list_contains(o, y) AND NOT list_contains(fr, y)) END
        FROM (SELECT *, CASE WHEN len(fr) > 0 THEN fr[{pick}] END AS x FROM r WHERE len(o) < n)),
      whole AS (SELECT user_id, o FROM r WHERE len(o) = n) {_SEEN}"""


TRAVERSALS: dict[str, tuple[Query, str]] = {
    "order_bfs": (
        lambda s, d: g.node_order(g.user_graphs(s, d), "BFS"),
        f"""WITH RECURSIVE {_USERS}, r(user_id, n, adj, i, o) AS (SELECT user_id, n, adj, 1, [s] FROM g UNION ALL SELECT user_id, n, adj, i + 1, o || list_filter(adj[o[i] + 1], lambda x: NOT list_contains(o, x)) FROM r WHERE i <= len(o)),
          done AS (SELECT user_id, n, o FROM r WHERE i = len(o) + 1), {_REST} {_SEEN}""",
    ),
    "order_dfs": (
        lambda s, d: g.node_order(g.user_graphs(s, d), "DFS"),
        f"""WITH RECURSIVE {_USERS}, r(user_id, n, adj, st, o) AS (SELECT user_id, n, adj, [s], CAST([] AS INTEGER[]) FROM g
          UNION ALL SELECT user_id, n, adj, CASE WHEN list_contains(o, x) THEN st[1:len(st) - 1] ELSE st[1:len(st) - 1] || list_reverse_sort(list_filter(adj[x + 1], lambda y: NOT list_contains(o, y))) END, CASE WHEN list_contains(o, x) THEN o ELSE o || [x] END
          FROM (SELECT *, st[len(st)] AS x FROM r WHERE len(st) > 0)),
          done AS (SELECT user_id, n, o FROM r WHERE len(st) = 0), {_REST} {_SEEN}""",
    ),
    "order_bfsac": (lambda s, d: g.node_order(g.user_graphs(s, d), "BFSAC"), _cut_order(1)),
    "order_bfsdc": (lambda s, d: g.node_order(g.user_graphs(s, d), "BFSDC"), _cut_order(-1)),
}

# ---------------------------------------------------------------- runs and tokens


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders")


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order resumes its customer's order before; it sets its priority, and orders of status F their status too."""
    o = _orders(spark, sf_dir)
    parent = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    held = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("priority"), "o_orderpriority", F.lit("finished"), F.col("o_orderkey").cast("string"))).otherwise(F.create_map(F.lit("priority"), "o_orderpriority"))
    out = r.lineage(o.select(F.col("o_orderkey").alias("run_id"), parent.alias("parent"), held.alias("settings")))
    return out.select("run_id", F.col("settings")["priority"].alias("priority"), F.try_element_at("settings", F.lit("finished")).alias("finished"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat sequence an order: its lines as nodes; lines of more than 25 pieces point back to the line before."""
    line = F.concat(F.array((F.col("l_linenumber") + 5).cast("int")), F.when((F.col("l_quantity") > 25) & (F.col("l_linenumber") > 1), F.array(F.lit(4), (F.col("l_linenumber") + 4).cast("int"), F.lit(5))).otherwise(F.array().cast("array<int>")))
    held = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t")))).alias("x"))
    return held.select("l_orderkey", F.concat(F.array(F.lit(0)), F.flatten(F.transform("x", lambda e: e["t"])), F.array(F.lit(1))).alias("tokens"))


_NAME = "concat('moses_', {0}, '_', {1}, '_n', o_custkey, CASE WHEN o_orderstatus = 'F' THEN '_x' ELSE '' END)"
_SCHEME = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'hsent' WHEN '2' THEN 'hdtc' WHEN '3' THEN 'hdt' WHEN '4' THEN 'sent' ELSE 'plain' END"
_COARSE = "CASE o_orderstatus WHEN 'F' THEN 'spectral' WHEN 'O' THEN 'hac' ELSE 'none' END"

RUNS: dict[str, tuple[Query, str]] = {
    "run_latest_match": (
        lambda s, d: r.latest_match(_read(s, d, "customer").select(F.col("c_custkey").alias("checkpoint"), "c_acctbal"), _orders(s, d).select(F.col("o_custkey").alias("checkpoint"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("score")), names=("score",)),
        "SELECT c_custkey AS checkpoint, c_acctbal, score FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_totalprice)) AS score FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    ),
    "run_best": (
        lambda s, d: r.best(_orders(s, d).select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice"),
        "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1",
    ),
    "run_pivot": (
        lambda s, d: r.pivot(_read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("metric")).agg(F.sum("l_quantity").alias("value")), ["A", "N", "R"]),
        "SELECT l_suppkey AS run_id, sum(l_quantity) FILTER (l_returnflag = 'A') AS \"A\", sum(l_quantity) FILTER (l_returnflag = 'N') AS \"N\", sum(l_quantity) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY l_suppkey",
    ),
    "run_info": (
        lambda s, d: _orders(s, d).select("o_orderkey", F.expr(_NAME.format(_SCHEME, _COARSE)).alias("name")).select("o_orderkey", r.run_info(F.col("name")).alias("i")).select("o_orderkey", "i.*"),
        f"SELECT o_orderkey, nullif({_SCHEME}, 'plain') AS scheme, nullif({_COARSE}, 'none') AS coarsening, o_custkey::INTEGER AS samples FROM orders",
    ),
    "run_lineage": (
        _lineage,
        "SELECT o_orderkey AS run_id, o_orderpriority AS priority, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS finished FROM orders",
    ),
    "token_render": (
        lambda s, d: _tokens(s, d).select("l_orderkey", render(F.col("tokens"), "flat").alias("shown")),
        "SELECT l_orderkey, '[SOS] ' || string_agg((l_linenumber - 1)::VARCHAR || CASE WHEN l_quantity > 25 AND l_linenumber > 1 THEN ' [LADJ] ' || (l_linenumber - 2)::VARCHAR || ' [RADJ]' ELSE '' END, ' ' ORDER BY l_linenumber, l_partkey, l_quantity > 25) || ' [EOS]' AS shown FROM lineitem GROUP BY l_orderkey",
    ),
    "token_vocab": (
        lambda s, d: _orders(s, d).groupBy("o_custkey").agg(F.count("*").cast("int").alias("n")).select("o_custkey", *[vocab_size(F.col("n"), k, more).cast("long").alias(k) for k, more in (("flat", False), ("hdt", True), ("hsent", True), ("hdtc", True))]),
        "SELECT o_custkey, 6 + count(*) AS flat, 7 + count(*) + 15 AS hdt, 11 + count(*) + 15 AS hsent, 12 + count(*) + 15 AS hdtc FROM orders GROUP BY o_custkey",
    ),
}

DERIVED = {**MOLECULES, **GRAPHS, **TRAVERSALS, **RUNS}
DERIVED_QUERIES: dict[str, Query] = {k: q for k, (q, _) in DERIVED.items()}
DERIVED_ORACLES: dict[str, str] = {k: o for k, (_, o) in DERIVED.items()}
