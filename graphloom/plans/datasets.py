"""A collection from its rows to batches of tokens as one plan, and two sets of molecules through all their metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.distances import pad_tokens
from graphloom.functions.grammars import EDGE_LABELS, NODE_LABELS, SCHEMES
from graphloom.operators import codecs, levels, molmetrics
from graphloom.operators import molecules as m
from graphloom.plans.baskets import _BASKETS, basket_graphs
from graphloom.plans.derived import _CHAINS, on_chains, sides
from graphloom.plans.moments import _FRAGMENTS
from graphloom.sources.datasets import _exists, cached_tokens
from graphloom.sources.molecules import sample
from graphloom.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]


@m.once_a_string
def molecule_graphs(mols: DataFrame) -> DataFrame:
    """graph_id, ids, labels, edges of molecules (mol_id, smiles): atoms by their place, atom and bond types; what isn't one leaves."""
    return m.graphs(mols).withColumnRenamed("mol_id", "graph_id")


def reference_graphs(spark: SparkSession, mols: DataFrame, path: str, n: int) -> DataFrame:
    """Graphs of n molecules, the same on every run, written to path unless they are there."""
    if not _exists(spark, path):
        molecule_graphs(sample(mols, "mol_id", n)).write.parquet(path)
    return spark.read.parquet(path)


def export_json(mols: DataFrame, tokens: DataFrame, path: str) -> None:
    """A JSON line a molecule: its string, atoms, bonds and tokens."""
    held = molecule_graphs(mols).select(F.col("graph_id").alias("mol_id"), F.col("labels").alias("atoms"), F.col("edges").alias("bonds"))
    told = mols.select("mol_id", "smiles").join(held, "mol_id").join(tokens.select(F.col("graph_id").alias("mol_id"), "tokens"), "mol_id", "left")
    told.write.mode("overwrite").json(path)


def tokenise(graphs: DataFrame, scheme: str, method: str = "spectral", nodes: int | None = None, seed: int = 0) -> DataFrame:
    """(graph_id, tokens) of graphs under a scheme: hsent, hdt and hdtc over the hierarchy that `method` finds, flat as seeded walks."""
    graphs = staged(graphs, "graphs")
    nodes = codecs.vocabulary(graphs) if nodes is None else nodes
    if scheme == "flat":
        return codecs.encode_walks(graphs, nodes, seed).select("graph_id", "tokens")
    return codecs.tokens_of(graphs, levels.hierarchy(graphs, method), scheme, nodes)


def token_set(spark: SparkSession, root: str, dataset: str, part: str, scheme: str, graphs: DataFrame, n: int | None, config: dict) -> tuple[DataFrame, int]:
    """(tokens, vocabulary) of a split: read from the cache under root if they were built with this config, else built and written. The
    vocabulary has special tokens, node numbers, atom and bond types."""
    graphs = staged(graphs, "graphs")
    nodes = config.get("nodes") or codecs.vocabulary(graphs)
    tokens = cached_tokens(spark, root, dataset, part, scheme, n, {**config, "nodes": nodes}, lambda: tokenise(graphs, scheme, config.get("method", "spectral"), nodes, config.get("seed", 0)))
    return tokens, SCHEMES[scheme]["offset"] + nodes + NODE_LABELS + EDGE_LABELS


def batches(tokens: DataFrame, size: int, most: int | None = None, pad: int = 2, eos: int = 1) -> DataFrame:
    """(batch, rows): sequences of like length in batches of about `size`, each padded to its longest, and cut to `most`. Batches come
    from slices of the hash within lengths, so no task orders all sequences."""
    n = F.size("tokens") if most is None else F.least(F.size("tokens"), F.lit(most))
    counted = tokens.withColumn("length", n)
    often = counted.groupBy("length").agg(F.greatest(F.ceil(F.count("*") / F.lit(size)), F.lit(1)).alias("slices"))
    dealt = counted.join(F.broadcast(often), "length").withColumn("slice", F.pmod(F.xxhash64("graph_id"), F.col("slices")))
    padded = dealt.select("length", "slice", "graph_id", pad_tokens(F.col("tokens"), F.col("length"), pad, eos).alias("tokens"))
    return padded.groupBy("length", "slice").agg(F.collect_list(F.struct("graph_id", "tokens")).alias("rows")).select(F.struct("length", "slice").alias("batch"), "rows")


def _chain_round_trip(scheme: str) -> Query:
    """Molecules to tokens and back: atoms and bonds that the tokens tell, by kind. A walk follows from its molecule's string."""

    def read_back(mols):
        graphs = staged(molecule_graphs(mols), "molecules")
        nodes = codecs.vocabulary(graphs)
        read = codecs.decode(tokenise(graphs, scheme, "affinity", nodes), scheme, nodes)
        kind = lambda c, k: F.size(F.filter(c, lambda x: x["label"] == k)).cast("long")
        return read.select(F.col("graph_id").alias("mol_id"), kind("labels", 0).alias("carbon"), kind("labels", 1).alias("nitrogen"), kind("labels", 2).alias("oxygen"), kind("edges", 0).alias("single"), kind("edges", 1).alias("double"), kind("edges", 3).alias("aromatic"))

    return on_chains(read_back)


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences and nodes in padded batches, and whether all rows of a batch are of one length."""
    tokens = tokenise(basket_graphs(spark, sf_dir), "flat")
    rows = batches(tokens, 64).select("batch.length", F.explode("rows").alias("r"))
    return rows.agg(F.count("*").alias("graphs"), F.bool_and(F.size("r.tokens") == F.col("length")).alias("even"))


def _order_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket graphs with orders of three parts or more as motifs: nodes, communities and cohesion."""
    graphs = staged(basket_graphs(spark, sf_dir), "baskets")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("graph_id"))
    held = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts")).where("size(parts) > 2")
    places = F.transform("parts", lambda x: (F.array_position("ids", x) - 1).cast("int"))
    matches = held.join(orders, "o_orderkey").join(graphs.select("graph_id", "ids"), "graph_id").select("graph_id", places.alias("atoms"))
    out = levels.motif_communities(graphs, matches)
    return out.select("graph_id", F.size("communities").cast("long").alias("nodes"), F.col("cohesion").between(0, 1).alias("bounded"))


_ATOMS = f"""WITH {_CHAINS} SELECT mol_id, c + k + 6 * p AS carbon, nn AS nitrogen, o + k AS oxygen, n - 1 AS single, k AS double, 6 * p AS aromatic FROM mol"""

DATASETS: dict[str, tuple[Query, str | None]] = {
    "molecule_tokens_hdt": (_chain_round_trip("hdt"), _ATOMS),
    "molecule_tokens_hsent": (_chain_round_trip("hsent"), _ATOMS),
    "molecule_tokens_flat": (_chain_round_trip("flat"), _ATOMS),
    "token_batches": (_batched, f"WITH {_BASKETS} SELECT count(DISTINCT graph_id) AS graphs, true AS even FROM l"),
    "motif_aware_communities": (_order_cohesion, f"WITH {_BASKETS} SELECT graph_id, count(DISTINCT p) AS nodes, true AS bounded FROM l GROUP BY graph_id"),
    "evaluation": (
        lambda s, d: molmetrics.evaluation(*sides(s, d, "OP", "F"), similarities=False).withColumn("value", F.round("value", 9)),
        f"""WITH {_FRAGMENTS}, q AS (SELECT avg(CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END)::DOUBLE AS validity, count(DISTINCT CASE WHEN status = 'O' THEN canon END) / count(*) FILTER (status = 'O')::DOUBLE AS uniqueness,
          count(*) FILTER (status = 'O' AND canon NOT IN (SELECT canon FROM x WHERE status = 'F')) / count(*) FILTER (status = 'O')::DOUBLE AS novelty FROM x WHERE status IN ('O', 'P')),
          fc AS (SELECT f, count(DISTINCT CASE WHEN status = 'O' THEN mol_id END)::DOUBLE AS a, count(DISTINCT CASE WHEN status = 'F' THEN mol_id END)::DOUBLE AS b FROM frag GROUP BY f),
          sc AS (SELECT s, coalesce(sum(n) FILTER (status = 'O'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (status = 'F'), 0)::DOUBLE AS b FROM scaffold GROUP BY s)
          SELECT metric, round(value, 9)::DOUBLE AS value FROM (SELECT 'validity' AS metric, validity AS value FROM q UNION ALL SELECT 'uniqueness', uniqueness FROM q UNION ALL SELECT 'novelty', novelty FROM q
          UNION ALL SELECT 'fragment_cosine', sum(a * b) / ((sqrt(sum(a * a)) + 1e-10) * (sqrt(sum(b * b)) + 1e-10)) FROM fc UNION ALL SELECT 'scaffold_cosine', sum(a * b) / ((sqrt(sum(a * a)) + 1e-10) * (sqrt(sum(b * b)) + 1e-10)) FROM sc
          UNION ALL SELECT 'scaffold_retention', count(*) FILTER (a > 0 AND b > 0) / count(*) FILTER (b > 0)::DOUBLE FROM sc)""",
    ),
}
DATASET_QUERIES: dict[str, Query] = {k: q for k, (q, _) in DATASETS.items()}
DATASET_ORACLES: dict[str, str] = {k: o for k, (_, o) in DATASETS.items() if o is not None}
