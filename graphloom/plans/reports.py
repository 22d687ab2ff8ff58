"""Reports over the chains of graphloom.plans.derived, as molecules, as graphs with bonds that don't fit, and as tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import codecs, levels, reports
from graphloom.operators import metrics as mt
from graphloom.operators import molecules as m
from graphloom.plans.datasets import molecule_graphs
from graphloom.plans.derived import _CHAINS, _chain, chains, on_chains, sides
from graphloom.plans.moments import _EVAL, _EVALUATED
from graphloom.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histograms' distances of the motifs that the oracle counts."""
    found = reports.histogram_metric(chains(spark, sf_dir, "O"), chains(spark, sf_dir, "F"), "kl")
    wanted = found.where(F.col("metric").isin(*[f"motif_hist_{n}" for n in _EVALUATED]))
    return wanted.withColumn("value", F.round("value", 9))


@m.once_a_string
def _strained(mols: DataFrame, doubled: bool) -> DataFrame:
    """What is wrong with the molecules as graphs, if the bonds between pieces are doubled."""
    graphs = molecule_graphs(mols)
    if doubled:
        twice = F.transform("edges", lambda e: F.struct(e["u"].alias("u"), e["v"].alias("v"), F.when(e["label"] == 0, 1).otherwise(e["label"]).alias("label")))
        graphs = graphs.withColumn("edges", twice.cast(levels.EDGES))
    return reports.analyse(graphs)


def _all_analysed(o: DataFrame, f: DataFrame) -> DataFrame:
    """Chains as graphs; in those of reference orders the bonds between pieces are doubled."""
    return _strained(o, False).unionByName(_strained(f, True))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules are counted by string; the counts stand where their keys would."""
    found = _all_analysed(*map(m.counted_strings, sides(spark, sf_dir, "O", "F")))
    return reports.batch_report(found, "graph_id").withColumn("boundary_ratio", F.round("boundary_ratio", 9))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_analysed(*sides(spark, sf_dir, "O", "F")).select("graph_id", "valid", F.col("num_atoms").cast("long").alias("num_atoms"), F.size("violations").cast("long").alias("violations"))


@on_chains
def _lengths(mols: DataFrame) -> DataFrame:
    """Tokens of whole molecules: one part each."""
    graphs = staged(molecule_graphs(mols), "molecules")
    tokens = codecs.tokens_of(graphs, levels.hierarchy(graphs, "affinity", min_size=1 << 30), "hdt")
    return reports.token_stats(graphs, tokens)


#: Letters whose bonds are too many when those between pieces are doubled: inner O, N and K; a ring's atom with a neighbour outside.
_STRAIN = f"""{_CHAINS}, s AS (SELECT *, CASE WHEN status = 'F' THEN len(list_filter(range(2, n), lambda i: w[i:i] IN ('O', 'N', 'K'))) ELSE 0 END AS chain_bad,
    CASE WHEN status = 'F' THEN len(list_filter(range(2, n), lambda i: w[i:i] IN ('O', 'N', 'K') AND (w[i - 1:i - 1] = 'P' OR w[i + 1:i + 1] = 'P'))) ELSE 0 END AS beside,
    CASE WHEN status = 'F' AND n > 1 THEN 2 * p - (w[1] = 'P')::INT ELSE 0 END AS ring_bad FROM mol)"""

REPORTS: dict[str, tuple[Query, str]] = {
    "motif_histogram_metric": (
        _histograms,
        f"""WITH {_EVAL}, e AS (UNPIVOT (SELECT mol_id, {', '.join(f'{n}::BIGINT AS {n}' for n in _EVALUATED)} FROM v) ON {', '.join(_EVALUATED)} INTO NAME motif VALUE c),
          h AS (SELECT motif, status, least(e.c, 10) AS b, count(*)::DOUBLE AS n FROM e JOIN mol USING (mol_id) GROUP BY ALL), tot AS (SELECT status, count(*)::DOUBLE AS t FROM mol GROUP BY status),
          g AS (SELECT motif, b FROM (SELECT DISTINCT motif FROM e), (SELECT unnest(range(11)) AS b)),
          pq AS (SELECT g.motif, g.b, greatest(least(coalesce(x.n, 0) / (SELECT t FROM tot WHERE status = 'O'), 1), 1e-10) AS p, greatest(least(coalesce(y.n, 0) / (SELECT t FROM tot WHERE status = 'F'), 1), 1e-10) AS q FROM g
            LEFT JOIN h x ON x.motif = g.motif AND x.b = g.b AND x.status = 'O' LEFT JOIN h y ON y.motif = g.motif AND y.b = g.b AND y.status = 'F'),
          z AS (SELECT *, p / sum(p) OVER (PARTITION BY motif) AS a, q / sum(q) OVER (PARTITION BY motif) AS c FROM pq) SELECT 'motif_hist_' || motif AS metric, round(sum(a * ln(a / c)), 9) AS value FROM z GROUP BY motif""",
    ),
    "substituent_presence": (
        lambda s, d: reports.substituent_presence(chains(s, d)),
        _chain("""SELECT motif, count(*) AS mols FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(w, 'OP') THEN 'Hydroxyl (-OH)' END, CASE WHEN regexp_matches(w, 'NP') THEN 'Amino (-NH2)' END, CASE WHEN regexp_matches(w, 'PC$|^CP') THEN 'Methyl (-CH3)' END,
          CASE WHEN regexp_matches(w, 'KP') THEN 'Carbonyl (C=O)' END, CASE WHEN regexp_matches(w, 'OKP') THEN 'Carboxyl (-COOH)' END, CASE WHEN regexp_matches(w, '[CK]OP') THEN 'Ether (-OR)' END, CASE WHEN regexp_matches(w, '[CONKP]CP|PC[CONKP]') THEN 'Alkyl chain' END], lambda x: x IS NOT NULL)) AS motif FROM mol WHERE p > 0) GROUP BY motif"""),
    ),
    "substitution_category": (
        lambda s, d: reports.substitution_category(chains(s, d)),
        _chain("SELECT mol_id, CASE WHEN first > 1 THEN 'di-para' ELSE 'mono' END AS category FROM mol WHERE p > 0"),
    ),
    "molecule_analysis": (_analysed, f"WITH {_STRAIN} SELECT mol_id AS graph_id, chain_bad + ring_bad = 0 AS valid, n + k + 5 * p AS num_atoms, (chain_bad + ring_bad)::BIGINT AS violations FROM s"),
    "molecule_report": (
        _report,
        f"""WITH {_STRAIN} SELECT count(*) AS total, count(*) FILTER (chain_bad + ring_bad = 0) AS num_valid, count(*) FILTER (chain_bad + ring_bad > 0) AS num_invalid, 0::BIGINT AS num_decode_failures, count(*) FILTER (chain_bad + ring_bad > 0) AS with_valence, 0::BIGINT AS other,
          0::BIGINT AS ring_interior, sum(ring_bad)::BIGINT AS ring_boundary, sum(beside)::BIGINT AS chain_boundary, sum(chain_bad - beside)::BIGINT AS chain_interior, round(sum(ring_bad + beside) / sum(chain_bad + ring_bad)::DOUBLE, 9) AS boundary_ratio FROM s""",
    ),
    "token_stats": (
        lambda s, d: _lengths(s, d).select(F.col("graph_id").alias("mol_id"), "seq_len", "num_nodes", "num_edges", F.round("compression_ratio", 9).alias("compression_ratio"), F.round("tokens_per_edge", 9).alias("tokens_per_edge")),
        _chain("""SELECT mol_id, seq_len, a AS num_nodes, 2 * b AS num_edges, round(seq_len / a::DOUBLE, 9) AS compression_ratio, CASE WHEN b = 0 THEN 0 ELSE round(seq_len / (2 * b)::DOUBLE, 9) END AS tokens_per_edge
          FROM (SELECT mol_id, n + k + 5 * p AS a, n - 1 + k + 6 * p AS b, 10 + 2 * (n + k + 5 * p) + 2 * (n - 1 + k + 6 * p) + 2 * (n + k + 5 * p - 1) AS seq_len FROM mol)"""),
    ),
    "token_stat_rollup": (
        lambda s, d: mt.length_stats(_lengths(s, d).select(F.col("seq_len").alias("n"))),
        _chain("""SELECT round(avg(z), 6) AS mean_len, min(z) AS min_len, max(z) AS max_len, round(stddev_pop(z), 6) AS std_len, max(CASE WHEN i = least(floor(c * 0.95)::BIGINT, c - 1) + 1 THEN z END) AS p95, max(CASE WHEN i = least(floor(c * 0.99)::BIGINT, c - 1) + 1 THEN z END) AS p99
          FROM (SELECT z, row_number() OVER (ORDER BY z) AS i, count(*) OVER () AS c FROM (SELECT 6 + 4 * (n + k + 5 * p) + 2 * (n + k + 6 * p) AS z FROM mol))"""),
    ),
}
REPORT_QUERIES: dict[str, Query] = {k: q for k, (q, _) in REPORTS.items()}
REPORT_ORACLES: dict[str, str] = {k: o for k, (_, o) in REPORTS.items()}
